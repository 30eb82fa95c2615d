"""Queries for repair and suggestion datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import repair as RP
from lintlake.plans.catalog import code_query
from lintlake.plans.oracle import _lit, with_facts
from lintlake.plans.q_facts import _rules_sql
from lintlake.plans.q_critics import CRITIC_CTES
from lintlake.plans.substrate import for_corpus
from lintlake.operators import rules as R


def _route_sql(t: str, d: str) -> str:
    parts = []
    for kind, tw, dw, _ in RP.ROUTES:
        conds = [f"contains(lower({t}), {_lit(w)})" for w in tw] + [f"contains(lower(coalesce({d}, '')), {_lit(w)})" for w in dw]
        parts.append(f"WHEN {' OR '.join(conds)} THEN {_lit(kind)}")
    return "CASE " + " ".join(parts) + " END"


def _rewrite_sql(k: str, line: str) -> str:
    sql1 = f"""replace(replace({line}, ' f"', '", params)  # Use parameterized query'), '" % ', '", % (params))  # Use parameterized query')"""
    res1 = f"replace({line}, 'open(', 'with open(')"
    return f"""CASE
      WHEN {k} = 'sql_injection' THEN CASE WHEN {sql1} = {line} AND contains({line}, ' + ') AND contains(upper({line}), 'SELECT')
                                         THEN '# TODO: Rewrite using parameterized query' ELSE {sql1} END
      WHEN {k} = 'xss' THEN replace({line}, ' + ', ' + html.escape(') || '  # Add: import html; html.escape(user_input)'
      WHEN {k} = 'command_injection' THEN {_lit(RP.COMMAND_FIX)}
      WHEN {k} = 'path_traversal' THEN {_lit(RP.PATH_FIX)}
      WHEN {k} = 'division_by_zero' THEN {_lit(RP.DIVISION_PREFIX)} || {line}
      WHEN {k} = 'none_check' THEN {_lit(RP.NONE_PREFIX)} || {line}
      WHEN {k} = 'extract_function' THEN {_lit(RP.EXTRACT_FIX)}
      WHEN {k} = 'guard_clauses' THEN {_lit(RP.GUARD_FIX)}
      WHEN {k} = 'parameter_grouping' THEN {_lit(RP.GROUP_FIX)}
      WHEN {k} = 'resource_leak' THEN CASE WHEN contains({res1}, 'with open(') AND NOT contains({res1}, ' as ')
                                           THEN replace({res1}, ') ', ') as f: ') ELSE {res1} END END"""


_KMETA = " ".join(f"WHEN {_lit(k)} THEN {_lit(c)}" for k, (_d, c, _r) in RP.KINDS.items())
_KDESC = " ".join(f"WHEN {_lit(k)} THEN {_lit(d)}" for k, (d, _c, _r) in RP.KINDS.items())
_KREV = " ".join(f"WHEN {_lit(k)} THEN {'true' if r else 'false'}" for k, (_d, _c, r) in RP.KINDS.items())

REPAIR_CTES = CRITIC_CTES.rstrip() + f""",
t_find AS ({_rules_sql()}),
rep_in AS (
  SELECT file_id, issue_id, category, title, '' AS description, location FROM t_find
  UNION ALL
  SELECT file_id, function || ':' || issue_type || ':' || CAST(ln AS VARCHAR), category, replace(issue_type, '_', ' '), '',
         function || ':' || CAST(ln AS VARCHAR) FROM critic_all),
rep_routed AS (
  SELECT file_id, issue_id, category, {_route_sql('title', 'description')} AS kind,
         CASE WHEN contains(location, ':') THEN TRY_CAST(split_part(location, ':', -1) AS INTEGER) END AS ln FROM rep_in),
fixes AS (
  SELECT r.file_id, r.issue_id, r.category AS issue_type, r.kind, CAST(r.ln AS BIGINT) AS line_start, l.line AS original_code,
         {_rewrite_sql('r.kind', 'l.line')} AS fixed_code,
         CASE r.kind {_KDESC} END AS description, CASE r.kind {_KMETA} END AS confidence, CASE r.kind {_KREV} END AS requires_review
  FROM rep_routed r JOIN lines l ON l.file_id = r.file_id AND l.ln = r.ln WHERE r.kind IS NOT NULL AND r.ln IS NOT NULL)
"""


def _f(sql):
    return with_facts(sql, REPAIR_CTES)


def _fixes(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    t = R.run_rules(sub.facts).select("file_id", "issue_id", "category", "title", F.lit("").alias("description"), "location")
    c = sub.critic_issues.select(
        "file_id", F.concat_ws(":", "function", "issue_type", F.col("ln").cast("string")).alias("issue_id"), "category",
        F.replace(F.col("issue_type"), F.lit("_"), F.lit(" ")).alias("title"), F.lit("").alias("description"),
        F.concat_ws(":", "function", F.col("ln").cast("string")).alias("location"))
    return RP.fixes(t.unionByName(c), sub.lines)


@code_query("f01_f02_routed_findings", _f("SELECT file_id, issue_id, kind, CAST(ln AS BIGINT) AS ln FROM rep_routed"))
def f01_f02_routed_findings(spark, sf_dir):
    """F01 line from location and F02 routing of every finding to a fix kind."""
    sub = for_corpus(spark, sf_dir)
    t = R.run_rules(sub.facts).select("file_id", "issue_id", "title", F.lit("").alias("description"), "location")
    c = sub.critic_issues.select(
        "file_id", F.concat_ws(":", "function", "issue_type", F.col("ln").cast("string")).alias("issue_id"),
        F.replace(F.col("issue_type"), F.lit("_"), F.lit(" ")).alias("title"), F.lit("").alias("description"),
        F.concat_ws(":", "function", F.col("ln").cast("string")).alias("location"))
    u = t.unionByName(c)
    return u.select("file_id", "issue_id", RP.route(F.col("title"), F.col("description")).alias("kind"),
                    RP.line_of(F.col("location")).cast("bigint").alias("ln"))


@code_query("f03_fixes", _f("SELECT * FROM fixes"))
def f03_fixes(spark, sf_dir):
    return _fixes(spark, sf_dir)


@code_query("f04_applied_fixes", _f("""
SELECT file_id, sha256(string_agg(coalesce(fixed_code, line), chr(10) ORDER BY ln)) AS content_hash,
       CAST(count(fixed_code) AS BIGINT) AS n_changed
FROM (SELECT l.file_id, l.ln, l.line, x.fixed_code FROM lines l LEFT JOIN (
        SELECT file_id, line_start, arg_max(fixed_code, issue_id) AS fixed_code FROM fixes WHERE line_start > 0 GROUP BY file_id, line_start) x
      ON x.file_id = l.file_id AND x.line_start = l.ln)
GROUP BY file_id
"""))
def f04_applied_fixes(spark, sf_dir):
    """the corpus with every fix applied (hash of the new text and the count of changed lines)."""
    out = RP.apply_fixes(for_corpus(spark, sf_dir).lines, _fixes(spark, sf_dir))
    return out.select("file_id", F.sha2("content", 256).alias("content_hash"), F.col("n_changed").cast("bigint").alias("n_changed"))


@code_query("f05_fix_report", _f("""
SELECT CASE WHEN grouping(issue_type) = 0 THEN 'by_issue_type' ELSE 'total' END AS dimension, coalesce(issue_type, 'all') AS key,
       CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE requires_review) AS BIGINT) AS needs_review
FROM fixes GROUP BY GROUPING SETS ((issue_type), ())
"""))
def f05_fix_report(spark, sf_dir):
    return RP.fix_report(_fixes(spark, sf_dir))


@code_query("f05_fix_previews", _f("SELECT file_id, issue_id, substr(original_code, 1, 100) AS original, substr(fixed_code, 1, 100) AS fixed FROM fixes"))
def f05_fix_previews(spark, sf_dir):
    fx = _fixes(spark, sf_dir)
    return fx.select("file_id", "issue_id", F.substring("original_code", 1, 100).alias("original"), F.substring("fixed_code", 1, 100).alias("fixed"))


_REFACTOR = f"""
SELECT file_id, qualified_name AS function, 'extract_method' AS suggestion_type, CAST(ln_start AS BIGINT) AS ln, 'medium' AS effort
FROM functions WHERE ln_end - ln_start > 30
UNION ALL
SELECT f.file_id, f.qualified_name, 'parameter_object', CAST(f.ln_start AS BIGINT), 'high' FROM functions f
WHERE (SELECT count(*) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start AND NOT starts_with(p.name, '*')
       AND p.name NOT IN ('self', 'cls')) > 5
UNION ALL
SELECT file_id, qualified_name, 'simplify_conditional', CAST(prev_ln AS BIGINT), 'low' FROM (
  SELECT *, lag(ln) OVER (PARTITION BY file_id, fn_ln, indent ORDER BY ln) AS prev_ln,
            lag(kind) OVER (PARTITION BY file_id, fn_ln, indent ORDER BY ln) AS prev_kind FROM fst)
WHERE kind = 'elif' AND prev_kind IN ('if', 'elif')
UNION ALL
SELECT file_id, qualified_name, 'replace_magic_number', CAST(ln AS BIGINT), 'low' FROM (
  SELECT file_id, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(__import__('lintlake.functions.patterns', fromlist=['NUMBER']).NUMBER)}, 2)) AS num
  FROM fst WHERE kind <> 'docstring')
WHERE CAST(num AS DOUBLE) NOT IN ({", ".join(str(float(x)) for x in RP.MAGIC_ALLOWED)})
"""


@code_query("f06_f09_refactorings", _f(_REFACTOR))
def f06_f09_refactorings(spark, sf_dir):
    """F06 extract method, F07 parameter object, F08 else-if chains, F09 named constants."""
    sub = for_corpus(spark, sf_dir)
    return RP.refactorings(sub.functions, sub.fn_stmts)


@code_query("f10_refactoring_report", _f(f"""
SELECT CASE WHEN grouping(suggestion_type) = 0 THEN 'by_type' ELSE 'by_effort' END AS dimension,
       coalesce(suggestion_type, effort) AS key, CAST(count(*) AS BIGINT) AS n
FROM ({_REFACTOR}) GROUP BY GROUPING SETS ((suggestion_type), (effort))
"""))
def f10_refactoring_report(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    r = RP.refactorings(sub.functions, sub.fn_stmts)
    g = r.groupingSets([["suggestion_type"], ["effort"]], "suggestion_type", "effort").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("suggestion_type").alias("g"))
    return g.select(F.when(F.col("g") == 0, "by_type").otherwise("by_effort").alias("dimension"),
                    F.coalesce("suggestion_type", "effort").alias("key"), "n")


_TESTS = """
SELECT file_id, qualified_name AS function, 'test_' || name AS test_name, 'unit' AS test_type FROM functions
UNION ALL
SELECT file_id, qualified_name, 'test_' || function_name || '_with_none_' || name, 'edge_case' FROM params
WHERE name NOT IN ('self', 'cls') AND regexp_matches(coalesce(type_hint, ''), 'Optional|Union|\\|')
UNION ALL
SELECT file_id, qualified_name, 'test_' || function_name || '_with_empty_' || name, 'edge_case' FROM params
WHERE name NOT IN ('self', 'cls') AND (contains(coalesce(type_hint, ''), 'List') OR contains(coalesce(type_hint, ''), 'list'))
UNION ALL
SELECT file_id, qualified_name, 'test_' || name || '_returns_list', 'property' FROM functions
WHERE contains(coalesce(return_type, ''), 'List') OR contains(coalesce(return_type, ''), 'list')
"""


@code_query("f11_generated_tests", _f(_TESTS))
def f11_generated_tests(spark, sf_dir):
    return RP.generated_tests(for_corpus(spark, sf_dir).functions)


@code_query("f12_test_report", _f(f"""
SELECT t.test_type, CAST(count(x.test_type) AS BIGINT) AS n FROM (VALUES ('unit'), ('edge_case'), ('property'), ('integration')) t(test_type)
LEFT JOIN ({_TESTS}) x ON x.test_type = t.test_type GROUP BY t.test_type
"""))
def f12_test_report(spark, sf_dir):
    """generated tests counted by type; types without tests are kept with zero."""
    g = RP.generated_tests(for_corpus(spark, sf_dir).functions).groupBy("test_type").agg(F.count(F.lit(1)).alias("c"))
    types = spark.createDataFrame([("unit",), ("edge_case",), ("property",), ("integration",)], "test_type string")
    return types.join(g, "test_type", "left").select("test_type", F.coalesce("c", F.lit(0)).cast("bigint").alias("n"))
