"""Queries for the four critics (L01-L08, V01-V06, P01-P07, Q01-Q07) and R01."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.operators import critics as CR
from lintlake.operators import facts as FX
from lintlake.plans.catalog import code_query
from lintlake.plans.oracle import _lit, _list, with_facts
from lintlake.plans.substrate import for_corpus


def _ul(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_lit(p)})" for p in CR.USER_INPUT) + ")"


def _any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_lit(w)})" for w in words) + ")"


_ISSUE = "file_id, qualified_name AS function, '{t}' AS issue_type, CAST({ln} AS BIGINT) AS ln, '{sev}' AS severity, '{cat}' AS category"


def _i(t, ln, sev, cat):
    return _ISSUE.format(t=t, ln=ln, sev=sev, cat=cat)


_ALLOWED = "(" + ", ".join(str(float(x)) for x in CR.ALLOWED_NUMBERS) + ")"
_BAD = "(NOT regexp_matches({c}, {g}) OR (length({c}) = 1 AND {c} NOT IN {ok}))"


def _bad(c):
    return _BAD.format(c=c, g=_lit(CR.GOOD_NAME), ok=_list(CR.ONE_LETTER_OK))


CRITIC_CTES = f"""
fnd AS (SELECT * FROM fst WHERE kind <> 'docstring'),
l_checked AS (SELECT DISTINCT file_id, fn_ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(FX.NONE_CHECK)}, 2)) AS var FROM fnd),
l_names AS (SELECT DISTINCT file_id, fn_ln, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(CR.FREE_NAME)}, 2)) AS var,
                   regexp_matches(coalesce(bare, ''), {_lit(CR.COMPARE)}) AS is_cmp FROM fnd),
l_opt AS (SELECT file_id, ln_start AS fn_ln, name AS var FROM params WHERE regexp_matches(coalesce(type_hint, ''), 'Optional|Union|\\|')),
l01 AS (SELECT {_i('missing_precondition_check', 'first_use', 'medium', 'logic')} FROM (
  SELECT n.file_id, n.fn_ln, n.qualified_name, n.var, min(n.ln) AS first_use, min(n.ln) FILTER (WHERE n.is_cmp) AS first_check
  FROM l_names n SEMI JOIN l_opt o ON o.file_id = n.file_id AND o.fn_ln = n.fn_ln AND o.var = n.var
  GROUP BY n.file_id, n.fn_ln, n.qualified_name, n.var) WHERE first_check > first_use),
l_assigned AS (SELECT DISTINCT file_id, fn_ln, regexp_extract(code, {_lit(CR.SIMPLE_TARGET)}, 1) AS var FROM fnd
               WHERE kind = 'assign' AND regexp_extract(code, {_lit(CR.SIMPLE_TARGET)}, 1) <> ''),
l_access AS (SELECT DISTINCT file_id, fn_ln, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(CR.ATTR_BASE)}, 2)) AS var FROM fnd),
l02 AS (SELECT {_i('potential_none_dereference', 'ln', 'low', 'logic')} FROM l_access a
  WHERE EXISTS (SELECT 1 FROM l_assigned s WHERE s.file_id = a.file_id AND s.fn_ln = a.fn_ln AND s.var = a.var)
    AND NOT EXISTS (SELECT 1 FROM l_checked c WHERE c.file_id = a.file_id AND c.fn_ln = a.fn_ln AND c.var = a.var)),
l_div AS (SELECT DISTINCT file_id, fn_ln, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(CR.DIVISOR)}, 1)) AS var FROM fnd),
l03 AS (SELECT {_i('division_by_zero_risk', 'ln', 'medium', 'logic')} FROM l_div a
  WHERE NOT EXISTS (SELECT 1 FROM l_checked c WHERE c.file_id = a.file_id AND c.fn_ln = a.fn_ln AND c.var = a.var)),
l_sub AS (SELECT file_id, fn_ln, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(CR.SUBSCRIPT)}, 1)) AS inner_txt FROM fnd),
l04a AS (SELECT DISTINCT {_i('array_index_risk', 'ln', 'low', 'logic')} FROM (SELECT *, trim(inner_txt) AS var FROM l_sub
  WHERE regexp_matches(inner_txt, '^\\s*[A-Za-z_][A-Za-z0-9_]*\\s*$')) a
  WHERE NOT EXISTS (SELECT 1 FROM l_checked c WHERE c.file_id = a.file_id AND c.fn_ln = a.fn_ln AND c.var = a.var)),
l04b AS (SELECT {_i('slice_risk', 'ln', 'low', 'logic')} FROM l_sub WHERE contains(inner_txt, ':') AND NOT regexp_matches(inner_txt, ':.*:')),
l_top AS (SELECT *, max(CASE WHEN kind = 'return' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, fn_ln ORDER BY ln
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_return FROM fnd WHERE parent_ln = fn_ln),
l05 AS (SELECT {_i('unreachable_code', 'ln', 'low', 'logic')} FROM l_top WHERE after_return = 1 AND kind NOT IN ('def', 'class', 'decorator')),
l07 AS (SELECT {_i('multiple_return_paths', 'fn_ln', 'low', 'logic')} FROM (
  SELECT file_id, fn_ln, qualified_name, count(*) FILTER (WHERE kind = 'return') AS n FROM fnd GROUP BY file_id, fn_ln, qualified_name) WHERE n > 1),
logic_all AS (SELECT * FROM l01 UNION ALL SELECT * FROM l02 UNION ALL SELECT * FROM l03 UNION ALL SELECT * FROM l04a
              UNION ALL SELECT * FROM l04b UNION ALL SELECT * FROM l05 UNION ALL SELECT * FROM l07),
v_fmt AS (SELECT file_id, qualified_name, ln,
                 regexp_extract(code, '("[^"]*"|''[^'']*'')\\s*%\\s*(.+)$', 1) AS lft, regexp_extract(code, '("[^"]*"|''[^'']*'')\\s*%\\s*(.+)$', 2) AS rgt FROM fst),
v01a AS (SELECT {_i('sql_injection', 'ln', 'critical', 'security')} FROM v_fmt
         WHERE lft <> '' AND {_any_contains('lower(lft)', [k.lower() for k in CR.SQL_KEYWORDS])} AND {_ul('rgt')}),
v01b AS (SELECT {_i('sql_injection', 'ln', 'critical', 'security')} FROM (
  SELECT DISTINCT file_id, qualified_name, ln, regexp_extract(code, 'execute\\s*\\((.*)\\)', 1) AS args FROM fcalls WHERE contains(lower(call), 'execute'))
  WHERE NOT regexp_matches(args, '^[^,]+,\\s*[(\\[]') AND {_ul('args')}),
v02 AS (SELECT DISTINCT {_i('command_injection', 'ln', 'critical', 'security')} FROM (
  SELECT file_id, qualified_name, ln, string_split(regexp_extract(code, {_lit(CR.CALL_ARGS)}, 1), ',') AS args
  FROM fcalls WHERE {_any_contains('call', CR.DANGEROUS_CALLS)})
  WHERE list_bool_or(list_transform(args, lambda a: {_ul('a')} OR regexp_matches(a, '^\\s*[A-Za-z_][A-Za-z0-9_.]*\\s*$')))),
v03 AS (SELECT {_i('xss', 'ln', 'high', 'security')} FROM (
  SELECT file_id, qualified_name, ln, regexp_extract(code, '["''][^"'']*<[^"'']*>[^"'']*["'']\\s*\\+\\s*(.+)$', 1) AS rgt FROM fst)
  WHERE rgt <> '' AND {_ul('rgt')}),
v04 AS (SELECT {_i('path_traversal', 'ln', 'medium', 'security')} FROM (
  SELECT DISTINCT file_id, qualified_name, ln, regexp_extract(code, 'os\\.path\\.join\\s*\\((.*)\\)', 1) AS args
  FROM fcalls WHERE contains(call, 'os.path.join')) WHERE {_ul('args')}),
security_all AS (SELECT * FROM v01a UNION ALL SELECT * FROM v01b UNION ALL SELECT * FROM v02 UNION ALL SELECT * FROM v03 UNION ALL SELECT * FROM v04),
loopish AS (SELECT c.*, s.in_loop, s.in_for, s.in_with FROM fcalls c JOIN fst s ON s.file_id = c.file_id AND s.ln = c.ln),
p01 AS (SELECT DISTINCT {_i('n_plus_1_queries', 'ln', 'high', 'performance')} FROM loopish
        WHERE (in_loop OR kind IN ('for', 'while')) AND {_any_contains('lower(call)', CR.DB_CALL_WORDS)} AND {_any_contains('lower(call)', CR.DB_RECEIVERS)}),
p02 AS (SELECT {_i('o_n_squared', 'inner_ln', 'medium', 'performance')} FROM (
  SELECT b.file_id, b.ln AS outer_ln, min(s.ln) AS inner_ln, min(s.qualified_name) AS qualified_name
  FROM blocks b JOIN fst s ON s.file_id = b.file_id AND s.kind IN ('for', 'while') AND s.ln > b.ln AND s.ln <= b.ln_end AND s.indent > b.indent
  WHERE b.kind = 'for' GROUP BY b.file_id, b.ln)),
p03 AS (SELECT DISTINCT {_i('inefficient_list_operation', 'ln', 'medium', 'performance')} FROM loopish
        WHERE in_for AND contains(call, 'insert') AND regexp_matches(code, 'insert\\s*\\(\\s*0\\s*[,)]')),
p04 AS (SELECT {_i('resource_leak_risk', 'ln', 'medium', 'performance')} FROM loopish
        WHERE (call = 'open' OR ends_with(call, '.open') OR {_any_contains("(call || '(')", CR.RESOURCE_CALLS)}) AND kind <> 'with' AND NOT in_with),
p_sib AS (SELECT *, sum(CASE WHEN kind IN ('elif', 'else') THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, fn_ln ORDER BY ln
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM fst WHERE parent_ln = fn_ln),
p05 AS (SELECT {_i('missing_early_return', 'h.ln', 'low', 'performance')} FROM p_sib h
  WHERE h.kind = 'if'
    AND EXISTS (SELECT 1 FROM p_sib r WHERE r.file_id = h.file_id AND r.fn_ln = h.fn_ln AND r.chain = h.chain AND r.kind IN ('elif', 'else'))
    AND EXISTS (SELECT 1 FROM fst t WHERE t.file_id = h.file_id AND t.kind = 'return' AND t.parent_ln = h.ln)
    AND NOT EXISTS (SELECT 1 FROM p_sib r JOIN blocks b ON b.file_id = r.file_id AND b.ln = r.ln
                    JOIN fst t ON t.file_id = r.file_id AND t.kind = 'return' AND t.ln > b.ln AND t.ln <= b.ln_end AND t.indent > b.indent
                    WHERE r.file_id = h.file_id AND r.fn_ln = h.fn_ln AND r.chain = h.chain AND r.kind IN ('elif', 'else'))),
p06 AS (SELECT {_i('inefficient_string_concat', 'ln', 'low', 'performance')} FROM (
  SELECT file_id, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), '\\+=?', 0)) AS op FROM fst WHERE in_loop AND kind <> 'docstring')),
performance_all AS (SELECT * FROM p01 UNION ALL SELECT * FROM p02 UNION ALL SELECT * FROM p03 UNION ALL SELECT * FROM p04
                    UNION ALL SELECT * FROM p05 UNION ALL SELECT * FROM p06),
q_f AS (SELECT f.*, (ln_end - ln_start) - coalesce(doc_lines, 0) AS eff,
  (SELECT count(*) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start AND NOT starts_with(p.name, '*'))
  - coalesce((SELECT CASE WHEN p.name = 'self' THEN 1 ELSE 0 END FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start
              AND NOT starts_with(p.name, '*') ORDER BY p.pos LIMIT 1), 0) AS npos,
  (SELECT max(nest + 1) FROM fst s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start AND s.kind IN ('if', 'elif', 'for', 'while', 'try', 'with', 'match')) AS depth
  FROM fmetrics f),
q01 AS (SELECT file_id, qualified_name AS function, 'long_function' AS issue_type, CAST(ln_start AS BIGINT) AS ln,
               CASE WHEN eff > 50 THEN 'medium' ELSE 'low' END AS severity, 'maintainability' AS category FROM q_f WHERE eff > 30),
q02 AS (SELECT file_id, qualified_name AS function, 'long_parameter_list' AS issue_type, CAST(ln_start AS BIGINT) AS ln,
               CASE WHEN npos > 7 THEN 'high' ELSE 'medium' END AS severity, 'maintainability' AS category FROM q_f WHERE npos > 5),
q03 AS (SELECT file_id, qualified_name AS function, 'deep_nesting' AS issue_type, CAST(ln_start AS BIGINT) AS ln,
               CASE WHEN depth > 4 THEN 'medium' ELSE 'low' END AS severity, 'maintainability' AS category FROM q_f WHERE depth > 3),
q04 AS (SELECT {_i('missing_docstring', 'ln_start', 'low', 'maintainability')} FROM q_f
        WHERE coalesce(trim(docstring), '') = '' AND NOT (starts_with(name, '__') AND ends_with(name, '__'))),
q05 AS (SELECT {_i('magic_number', 'ln', 'low', 'maintainability')} FROM (
  SELECT file_id, qualified_name, ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(P.NUMBER)}, 2)) AS num FROM fnd)
  WHERE NOT (CAST(num AS DOUBLE) IN {_ALLOWED} OR (NOT contains(num, '.') AND CAST(num AS DOUBLE) BETWEEN -10 AND 10))),
q06a AS (SELECT {_i('poor_naming', 'ln_start', 'low', 'maintainability')} FROM q_f WHERE {_bad('name')}),
q06b AS (SELECT file_id, qualified_name AS function, 'poor_naming' AS issue_type, CAST(ln_start AS BIGINT) AS ln, 'low' AS severity,
                'maintainability' AS category FROM params p WHERE NOT starts_with(name, '*') AND {_bad('name')} AND name NOT IN ('self', 'cls')),
maint_all AS (SELECT * FROM q01 UNION ALL SELECT * FROM q02 UNION ALL SELECT * FROM q03 UNION ALL SELECT * FROM q04
              UNION ALL SELECT * FROM q05 UNION ALL SELECT * FROM q06a UNION ALL SELECT * FROM q06b),
critic_all AS (SELECT * FROM logic_all UNION ALL SELECT * FROM security_all UNION ALL SELECT * FROM performance_all UNION ALL SELECT * FROM maint_all)
"""


def _with(sql):
    return with_facts(sql, CRITIC_CTES)


def _issues(spark, sf_dir):
    return for_corpus(spark, sf_dir).critic_issues


@code_query("r01_critic_findings", _with("SELECT * FROM critic_all"))
def r01_critic_findings(spark, sf_dir):
    """One findings table from the four critics."""
    return _issues(spark, sf_dir)


_PER_TYPE = [
    ("l01", "missing_precondition_check"), ("l02", "potential_none_dereference"), ("l03", "division_by_zero_risk"),
    ("l04", "array_index_risk"), ("l04", "slice_risk"), ("l05", "unreachable_code"), ("l07", "multiple_return_paths"),
    ("v01", "sql_injection"), ("v02", "command_injection"), ("v03", "xss"), ("v04", "path_traversal"),
    ("p01", "n_plus_1_queries"), ("p02", "o_n_squared"), ("p03", "inefficient_list_operation"), ("p04", "resource_leak_risk"),
    ("p05", "missing_early_return"), ("p06", "inefficient_string_concat"),
    ("q01", "long_function"), ("q02", "long_parameter_list"), ("q03", "deep_nesting"), ("q04", "missing_docstring"),
    ("q05", "magic_number"), ("q06", "poor_naming"),
]
_CATEGORY = {"l": "logic", "v": "security", "p": "performance", "q": "maintainability"}


def _register(tid: str, issue_type: str):
    cat = _CATEGORY[tid[0]]

    @code_query(f"{tid}_{issue_type}", _with(f"SELECT * FROM critic_all WHERE issue_type = '{issue_type}' AND category = '{cat}'"))
    def _q(spark, sf_dir):
        return _issues(spark, sf_dir).filter((F.col("issue_type") == issue_type) & (F.col("category") == cat))

    return _q


for _t, _it in _PER_TYPE:
    _register(_t, _it)


@code_query("l06_preconditions_verified", _with("""
SELECT p.file_id, p.qualified_name AS function, p.name AS parameter,
  EXISTS (SELECT 1 FROM (SELECT s.*, row_number() OVER (PARTITION BY s.file_id, s.fn_ln ORDER BY s.ln) AS rn FROM fst s WHERE s.parent_ln = s.fn_ln) t
          WHERE t.file_id = p.file_id AND t.fn_ln = p.ln_start AND t.rn <= 5 AND t.kind = 'if'
            AND list_contains(regexp_extract_all(coalesce(t.bare, ''), '(^|[^A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)', 2), p.name)) AS is_checked
FROM params p WHERE NOT starts_with(p.name, '*')
"""))
def l06_preconditions_verified(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    return CR.precondition_checks(sub.fn_stmts, sub.functions)


_REPORT = """
SELECT category, CASE WHEN grouping(issue_type) = 0 THEN 'by_type' WHEN grouping(severity) = 0 THEN 'by_severity' ELSE 'total' END AS dimension,
       coalesce(issue_type, severity, 'all') AS key, CAST(count(*) AS BIGINT) AS n
FROM critic_all {where} GROUP BY GROUPING SETS ((category, issue_type), (category, severity), (category))
"""


def _register_report(tid: str, cat: str):
    @code_query(f"{tid}_{cat}_report", _with(_REPORT.format(where=f"WHERE category = '{cat}'")))
    def _q(spark, sf_dir):
        return CR.report(_issues(spark, sf_dir).filter(F.col("category") == cat))

    return _q


for _t, _c in [("l08", "logic"), ("v06", "security"), ("p07", "performance"), ("q07", "maintainability")]:
    _register_report(_t, _c)


@code_query("v05_user_input_share", with_facts(f"""
SELECT file_id, CAST(count(*) AS BIGINT) AS n_calls, CAST(count(*) FILTER (WHERE {_ul('code')}) AS BIGINT) AS n_user_like
FROM fcalls GROUP BY file_id
"""))
def v05_user_input_share(spark, sf_dir):
    """The user-input predicate applied to every call line of the corpus."""
    c = for_corpus(spark, sf_dir).calls
    return c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(CR.user_like(F.col("code"))).alias("n_user_like"))
