"""Queries for rollups, gates and report sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import boundaries as B
from lintlake.operators import claims as K
from lintlake.operators import contracts as C
from lintlake.operators import rollup as RU
from lintlake.operators import rules as R
from lintlake.operators.graph import module_of
from lintlake.plans.catalog import code_query, query
from lintlake.plans.oracle import with_facts
from lintlake.plans.q_boundaries import BOUNDARY_CTES
from lintlake.plans.q_claims import CLAIM_CTES
from lintlake.plans.q_contracts import CONTRACT_CTES
from lintlake.plans.q_critics import CRITIC_CTES
from lintlake.plans.q_facts import _rules_sql
from lintlake.plans.substrate import for_corpus
from lintlake.sources import corpus, sinks

_SEV = RU.SEVERITIES
ROLLUP_CTES = CRITIC_CTES.rstrip() + ",\n" + CLAIM_CTES.strip() + f""",
t_find AS ({_rules_sql()}),
all_findings AS (
  SELECT file_id, issue_id, severity, category, title, tier, ln FROM t_find
  UNION ALL
  SELECT file_id, qualified_name || ':null_safety', CASE WHEN split_part(k01, '|', 2) = 'confirmed' THEN 'high' ELSE 'medium' END, 'logic',
         'Null safety issue: ' || array_to_string(unsafe_params, ', '), 'tier3_semantic', CAST(line_start AS BIGINT)
  FROM k_valid WHERE answer = 'UNSAFE' AND len(unsafe_params) > 0),
bad_files AS (
  SELECT file_id, CASE WHEN file_id % 13 = 0 THEN content || '(' ELSE content END AS content FROM code_files),
errors AS (
  SELECT file_id FROM bad_files
  WHERE length(content) - length(translate(content, '([{{', '')) <> length(content) - length(translate(content, ')]}}', ''))
     OR ((length(content) - length(replace(content, '\"\"\"', ''))) // 3) % 2 <> 0),
gate AS (
  SELECT c.file_id, CAST(coalesce(n, 0) AS BIGINT) AS n_findings, CAST(coalesce(n_sec, 0) AS BIGINT) AS n_security,
         e.file_id IS NOT NULL AS has_error,
         coalesce(n_sec, 0) = 0 AND e.file_id IS NULL AS passed, coalesce(n, 0) = 0 AND e.file_id IS NULL AS passed_strict
  FROM code_files c
  LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (WHERE category = 'security') AS n_sec FROM critic_all GROUP BY file_id) a
    ON a.file_id = c.file_id
  LEFT JOIN errors e ON e.file_id = c.file_id)
"""


def _r(sql, extra=""):
    return with_facts(sql, ROLLUP_CTES + ("," + extra if extra else ""))


def _sub(spark, sf_dir):
    return for_corpus(spark, sf_dir)


def _issues(sub):
    return sub.critic_issues


def all_findings(spark, sf_dir):
    """Pipeline findings: tier-2 rules plus tier-3 null-safety findings from validated claims."""
    sub = _sub(spark, sf_dir)
    t = R.run_rules(sub.facts).select("file_id", "issue_id", "severity", "category", "title", "tier", "ln")
    k = K.null_safety_findings(K.validate(K.claims(sub.facts), sub.facts)).join(
        sub.facts.select("file_id", F.concat(F.col("qualified_name"), F.lit(":null_safety")).alias("issue_id"),
                         F.col("line_start").cast("bigint").alias("ln")), ["file_id", "issue_id"]).select(
        "file_id", "issue_id", "severity", "category", "title", "tier", "ln")
    return t.unionByName(k)


@code_query("r02_summary", _r(f"""
SELECT c.file_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ["total_issues"] + _SEV[:4] + RU.CATEGORIES + ["functions_count", "classes_count"])}
FROM code_files c
LEFT JOIN (SELECT file_id, count(*) AS total_issues, {", ".join(f"count(*) FILTER (WHERE coalesce(severity, 'low') = '{s}') AS {s}" for s in _SEV[:4])},
                  {", ".join(f"count(*) FILTER (WHERE category = '{x}') AS {x}" for x in RU.CATEGORIES)}
           FROM critic_all GROUP BY file_id) a ON a.file_id = c.file_id
LEFT JOIN (SELECT file_id, count(*) AS functions_count FROM functions GROUP BY file_id) f ON f.file_id = c.file_id
LEFT JOIN (SELECT file_id, count(*) AS classes_count FROM classes GROUP BY file_id) k ON k.file_id = c.file_id
"""))
def r02_summary(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return RU.summary(sub.files, _issues(sub), sub.functions, sub.classes)


@query("r02_event_summary", f"""
SELECT event_type, {", ".join(f"CAST(count(*) FILTER (WHERE sev = '{s}') AS BIGINT) AS {s}" for s in _SEV[:4])}, CAST(count(*) AS BIGINT) AS total
FROM (SELECT event_type, CASE WHEN value >= 50 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS sev
      FROM events) GROUP BY event_type
""")
def r02_event_summary(spark, sf_dir):
    """R02 at size: events as findings (type, banded value as severity), every severity column kept; one aggregation pass."""
    ev = corpus.table(spark, sf_dir, "events").select("event_type", "value")
    sev = (F.when(F.col("value") >= 50, "critical").when(F.col("value") >= 20, "high").when(F.col("value") >= 10, "medium").otherwise("low"))
    return ev.groupBy("event_type").agg(*[F.count_if(sev == s).alias(s) for s in _SEV[:4]], F.count(F.lit(1)).alias("total"))


@code_query("r03_report_metrics", _r(f"""
SELECT c.file_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ["total_lines", "lines_of_code", "function_count", "issue_count"] + [f"{s}_issues" for s in _SEV] + ["tier1_findings", "tier2_findings", "tier3_findings"])}
FROM code_files c
LEFT JOIN (SELECT file_id, count(*) AS total_lines, count(*) FILTER (WHERE is_content) AS lines_of_code FROM lines GROUP BY file_id) l ON l.file_id = c.file_id
LEFT JOIN (SELECT file_id, count(*) AS function_count FROM functions GROUP BY file_id) f ON f.file_id = c.file_id
LEFT JOIN (SELECT file_id, count(*) AS issue_count, {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_issues" for s in _SEV)},
                  {", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {t.split('_')[0]}_findings" for t in RU.TIERS)}
           FROM all_findings GROUP BY file_id) a ON a.file_id = c.file_id
"""))
def r03_report_metrics(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return RU.report_metrics(sub.files, sub.lines, sub.functions, all_findings(spark, sf_dir))


_PROPS = " UNION ALL ".join(f"SELECT '{k}' AS property, '{v}' AS text" for k, v in RU.PROPERTIES)


@code_query("r04_proven_properties", _r(f"""
SELECT c.file_id, p.property, p.text FROM code_files c, ({_PROPS}) p
WHERE NOT EXISTS (SELECT 1 FROM all_findings f WHERE f.file_id = c.file_id AND (
  (p.property = 'no_security_findings' AND f.category = 'security')
  OR (p.property = 'no_resource_leaks' AND (contains(lower(f.title), 'resource leak') OR contains(lower(f.title), 'file')))
  OR (p.property = 'no_mutable_defaults' AND contains(lower(f.title), 'mutable'))))
"""))
def r04_proven_properties(spark, sf_dir):
    return RU.proven_properties(_sub(spark, sf_dir).files, all_findings(spark, sf_dir))


@code_query("r05_file_reports", _r("""
SELECT c.file_id, sha256(c.content) AS content_hash,
  CAST(coalesce((SELECT count(*) FROM functions f WHERE f.file_id = c.file_id), 0) AS BIGINT) AS functions_analyzed,
  coalesce((SELECT string_agg(issue_id, ',' ORDER BY issue_id) FROM all_findings a WHERE a.file_id = c.file_id), '') AS issue_ids,
  CAST(coalesce((SELECT count(*) FROM all_findings a WHERE a.file_id = c.file_id), 0) AS BIGINT) AS n_findings
FROM code_files c
"""))
def r05_file_reports(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return RU.file_report(sub.files, sub.functions, all_findings(spark, sf_dir))


@code_query("r06_ordered_findings", _r("""
SELECT file_id, issue_id, severity, title,
  CAST(row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
       WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END, ln, issue_id) AS BIGINT) AS position,
  count(*) OVER (PARTITION BY file_id, severity) AS section_size
FROM all_findings
"""))
def r06_ordered_findings(spark, sf_dir):
    return RU.ordered_sections(all_findings(spark, sf_dir))


@code_query("r07_top_security", _r("""
SELECT file_id, function, issue_type, ln, severity, CAST(rn AS BIGINT) AS rank, CAST(greatest(total - 5, 0) AS BIGINT) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
            WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END, ln, issue_type) AS rn, count(*) OVER (PARTITION BY file_id) AS total
  FROM critic_all WHERE category = 'security') WHERE rn <= 5
"""))
def r07_top_security(spark, sf_dir):
    return RU.top_security(_issues(_sub(spark, sf_dir)))


@code_query("r08_findings_per_line", _r("SELECT file_id, ln, CAST(count(*) AS BIGINT) AS n FROM critic_all GROUP BY file_id, ln"))
def r08_findings_per_line(spark, sf_dir):
    return _issues(_sub(spark, sf_dir)).groupBy("file_id", "ln").agg(F.count(F.lit(1)).alias("n"))


@query("r08_events_per_user_hour", """
SELECT user_id, date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id, date_trunc('hour', ts)
""")
def r08_events_per_user_hour(spark, sf_dir):
    """R08 at size: events per (user, hour), the per-line count of the event stream."""
    ev = corpus.table(spark, sf_dir, "events").select("user_id", "ts")
    return ev.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def _bad_files(sub):
    return sub.files.select("file_id", "path", F.when(F.col("file_id") % 13 == 0, F.concat("content", F.lit("("))).otherwise(F.col("content")).alias("content"))


@code_query("s02_quarantine", _r("SELECT file_id FROM errors"))
def s02_quarantine(spark, sf_dir):
    """Every 13th file gets a dangling bracket; those yield error rows and the rest go on."""
    _good, bad = corpus.quarantine(_bad_files(_sub(spark, sf_dir)))
    return bad.select("file_id")


def _gate(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    _good, bad = corpus.quarantine(_bad_files(sub))
    return RU.gate(sub.files, _issues(sub), bad)


@code_query("r09_quality_gate", _r("SELECT * FROM gate"))
def r09_quality_gate(spark, sf_dir):
    return _gate(spark, sf_dir)


@code_query("r10_corpus_gate", _r("""
SELECT CAST(count(*) AS BIGINT) AS files, bool_and(passed) AS all_passed, CAST(count(*) FILTER (WHERE NOT passed) AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE NOT passed_strict) AS BIGINT) AS failed_strict FROM gate
"""))
def r10_corpus_gate(spark, sf_dir):
    return RU.corpus_gate(_gate(spark, sf_dir))


@code_query("r11_selected_stages", _r("""
SELECT category AS stage, CAST(count(*) AS BIGINT) AS n FROM critic_all GROUP BY category
UNION ALL SELECT 'contracts', CAST(count(*) AS BIGINT) FROM c_viol
""", CONTRACT_CTES.strip()))
def r11_selected_stages(spark, sf_dir):
    """Report over the chosen stages (critics and contracts; patterns and invariants skipped)."""
    sub = _sub(spark, sf_dir)
    stages = {"critics": True, "contracts": True, "patterns": False, "invariants": False}
    parts = []
    if stages["critics"]:
        parts.append(_issues(sub).groupBy(F.col("category").alias("stage")).agg(F.count(F.lit(1)).alias("n")))
    if stages["contracts"]:
        items = sub.contract_items
        v = C.violations(C.contract_table(sub.functions, items), items, sub.fn_stmts)
        parts.append(v.agg(F.count(F.lit(1)).alias("n")).select(F.lit("contracts").alias("stage"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@code_query("r12_invariants_and_boundaries", _r("""
SELECT file_id, 'invariant' AS kind, class_name AS entity, ln, invariant AS detail, NULL AS risk FROM c_inv
UNION ALL SELECT file_id, kind, entity, ln, source_or_sink, risk FROM b_all
""", CONTRACT_CTES.strip() + "," + BOUNDARY_CTES.strip()))
def r12_invariants_and_boundaries(spark, sf_dir):
    """Invariant and boundary rows flattened to one shape (missing columns become null)."""
    sub = _sub(spark, sf_dir)
    inv = C.class_invariants(sub.fn_stmts, sub.functions).select(
        "file_id", F.lit("invariant").alias("kind"), F.col("class_name").alias("entity"), "ln", F.col("invariant").alias("detail"))
    b = B.boundaries(spark, sub.calls, sub.functions, sub.fn_stmts).select(
        "file_id", "kind", "entity", "ln", F.col("source_or_sink").alias("detail"), "risk")
    return inv.unionByName(b, allowMissingColumns=True)


@code_query("s01_directory_scan", with_facts("""
SELECT file_id // 10 AS pkg, sha256(content) AS content_hash, CAST(len(string_split(content, chr(10))) AS BIGINT) AS n_lines FROM code_files
"""))
def s01_directory_scan(spark, sf_dir):
    """The corpus written as a nested folder tree under the checkpoint folder, then scanned recursively."""
    root = sinks.write_tree(_sub(spark, sf_dir).files, sinks.scratch(spark, "tree"))
    t = sinks.scan_tree(spark, root)
    return t.select("pkg", F.sha2("content", 256).alias("content_hash"), F.size(F.split("content", "\n")).cast("bigint").alias("n_lines"))


@code_query("s04_report_round_trip", _r("SELECT * FROM critic_all"))
def s04_report_round_trip(spark, sf_dir):
    """Findings written as JSON and read back with the declared schema (FAILFAST)."""
    path = sinks.export(_issues(_sub(spark, sf_dir)), "json", sinks.scratch(spark, "report"))
    return sinks.load(spark, "json", path, sinks.ISSUE_SCHEMA)


@code_query("s05_nested_report", _r("""
SELECT t.file_id, CAST(to_json(struct_pack(file := c.path, total := t.total, issues := (
  SELECT list(struct_pack(category := category, items := items) ORDER BY category) FROM (
    SELECT category, list(struct_pack(line := ln, type := issue_type, function := function, severity := severity)
                          ORDER BY ln, issue_type, function, severity) AS items
    FROM critic_all a WHERE a.file_id = t.file_id GROUP BY category)))) AS VARCHAR) AS report
FROM (SELECT file_id, count(*) AS total FROM critic_all GROUP BY file_id) t JOIN code_files c ON c.file_id = t.file_id
"""))
def s05_nested_report(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return RU.nested_report(sub.files, _issues(sub))


@code_query("s06_sarif_results", _r("""
SELECT a.file_id, a.category || '.' || a.issue_type AS rule_id,
  CASE WHEN a.severity IN ('critical', 'high') THEN 'error' WHEN a.severity = 'medium' THEN 'warning' ELSE 'note' END AS level,
  a.issue_type || ' in ' || a.function AS message, c.path AS uri, CAST(coalesce(a.ln, 1) AS BIGINT) AS start_line
FROM critic_all a JOIN code_files c ON c.file_id = a.file_id
"""))
def s06_sarif_results(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return RU.sarif_rows(_issues(sub), sub.files)


@code_query("s07_graph_nodes", _r("SELECT file_id, qualified_name AS node, cyclomatic AS complexity FROM fmetrics"))
def s07_graph_nodes(spark, sf_dir):
    return _sub(spark, sf_dir).fn_metrics.select("file_id", F.col("qualified_name").alias("node"), F.col("cyclomatic").alias("complexity"))


@code_query("s07_graph_edges", _r("""
SELECT DISTINCT regexp_replace(regexp_replace(c.path, '(/__init__)?\\.py$', ''), '/', '.', 'g') AS src,
       CASE WHEN i.is_from THEN i.name ELSE i.module END AS dst
FROM imports i JOIN code_files c ON c.file_id = i.file_id
WHERE CASE WHEN i.is_from THEN i.name ELSE i.module END <> regexp_replace(regexp_replace(c.path, '(/__init__)?\\.py$', ''), '/', '.', 'g')
"""))
def s07_graph_edges(spark, sf_dir):
    """Module -> imported name edges, self edges dropped."""
    sub = _sub(spark, sf_dir)
    e = sub.imports.join(sub.files.select("file_id", module_of(F.col("path")).alias("src")), "file_id").select(
        "src", F.when(F.col("is_from"), F.col("name")).otherwise(F.col("module")).alias("dst"))
    return e.filter(F.col("dst") != F.col("src")).distinct()


@code_query("s08_result_tables", _r("""
SELECT a.file_id, sha256(c.content) AS analysis_id, a.category, a.issue_type, a.ln FROM critic_all a JOIN code_files c ON c.file_id = a.file_id
"""))
def s08_result_tables(spark, sf_dir):
    """Issues written partitioned by category, analyses by file; read back and joined on the analysis id."""
    sub = _sub(spark, sf_dir)
    an = sub.files.select("file_id", F.sha2("content", 256).alias("analysis_id"))
    ipath = sinks.export(_issues(sub).select("file_id", "category", "issue_type", "ln"), "parquet", sinks.scratch(spark, "issues"), ["category"])
    apath = sinks.export(an, "parquet", sinks.scratch(spark, "analyses"))
    issues = spark.read.parquet(ipath)
    return issues.join(spark.read.parquet(apath), "file_id").select("file_id", "analysis_id", "category", "issue_type", "ln")
