"""Queries for security boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import boundaries as B
from lintlake.plans.catalog import code_query
from lintlake.plans.oracle import _lit, _list, with_facts
from lintlake.plans.substrate import for_corpus


def _contains_any(x, words):
    return "(" + " OR ".join(f"contains({x}, {_lit(w)})" for w in words) + ")"


_SINK_CASE = "CASE " + " ".join(f"WHEN {_contains_any('call', subs)} THEN {_lit(cat)}" for cat, subs, _r in B.SINKS) + " END"
_RISK_CASE = "CASE " + " ".join(f"WHEN {_contains_any('call', subs)} THEN {_lit(r)}" for _c, subs, r in B.SINKS) + " END"
_REQ = " OR ".join(f"contains(coalesce(type_hint, ''), {_lit(t)})" for t in B.REQUEST_TYPES)

BOUNDARY_CTES = f"""
b_calls AS (SELECT DISTINCT file_id, qualified_name AS entity, ln, call, code FROM fcalls),
b_all AS (
  SELECT file_id, qualified_name AS entity, CAST(ln_start AS BIGINT) AS ln, 'input' AS kind, name AS source_or_sink, 'high' AS risk,
         'request-typed parameter' AS detail FROM params WHERE {_REQ}
  UNION ALL
  SELECT file_id, entity, CAST(ln AS BIGINT), 'input', call, 'medium', 'untrusted source call' FROM b_calls WHERE {_contains_any('call', B.UNTRUSTED_SOURCES)}
  UNION ALL
  SELECT file_id, entity, CAST(ln AS BIGINT), 'output', call, {_RISK_CASE}, {_SINK_CASE} FROM b_calls WHERE {_SINK_CASE} IS NOT NULL
  UNION ALL
  SELECT file_id, entity, CAST(ln AS BIGINT), 'privilege', call, 'critical', 'dangerous function' FROM b_calls WHERE call IN {_list(B.PRIVILEGED)}
  UNION ALL
  SELECT file_id, entity, CAST(ln AS BIGINT), 'output', 'string_format', 'high', 'format string injection' FROM (
    SELECT file_id, qualified_name AS entity, ln, code FROM fst)
  WHERE regexp_extract(code, {_lit(B.FORMAT_MOD)}, 1) <> '' AND contains(lower(regexp_extract(code, {_lit(B.FORMAT_MOD)}, 1)), 'input')),
b_first AS (SELECT file_id, ln, arg_min(call, pos) AS call FROM fcalls GROUP BY file_id, ln),
b_trust0 AS (
  SELECT s.file_id, s.fn_ln, regexp_extract(s.code, '^([A-Za-z_][A-Za-z0-9_]*)\\s*(:[^=]+)?=[^=]', 1) AS variable, c.call AS src, s.ln
  FROM fst s JOIN b_first c ON c.file_id = s.file_id AND c.ln = s.ln
  WHERE s.kind = 'assign' AND regexp_extract(s.code, '^([A-Za-z_][A-Za-z0-9_]*)\\s*(:[^=]+)?=[^=]', 1) <> ''
    AND {_contains_any('c.call', B.UNTRUSTED_SOURCES)}
  UNION ALL
  SELECT file_id, ln_start, name, 'request', ln_start FROM params WHERE {_REQ}),
b_trust AS (SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, variable, 'untrusted' AS trust_level,
                   string_agg(DISTINCT src, ',' ORDER BY src) AS sources, CAST(max(ln) AS BIGINT) AS last_ln
            FROM b_trust0 GROUP BY file_id, fn_ln, variable)
"""


def _b(sql):
    return with_facts(sql, BOUNDARY_CTES)


def _bound(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    return B.boundaries(spark, sub.calls, sub.functions, sub.fn_stmts)


def _register(qid: str, kind_filter: str, spark_filter):
    @code_query(qid, _b(f"SELECT * FROM b_all WHERE {kind_filter}"))
    def _q(spark, sf_dir):
        return _bound(spark, sf_dir).filter(spark_filter())

    return _q


_register("b01_input_boundaries", "kind = 'input'", lambda: F.col("kind") == "input")
_register("b02_output_boundaries", "kind = 'output' AND source_or_sink <> 'string_format'",
          lambda: (F.col("kind") == "output") & (F.col("source_or_sink") != "string_format"))
_register("b03_privilege_boundaries", "kind = 'privilege'", lambda: F.col("kind") == "privilege")
_register("b04_format_string_risk", "source_or_sink = 'string_format'", lambda: F.col("source_or_sink") == "string_format")


@code_query("b05_trust_levels", _b("SELECT * FROM b_trust"))
def b05_trust_levels(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    return B.trust_levels(spark, sub.fn_stmts, sub.calls, sub.functions)


@code_query("b06_boundary_report", _b("""
SELECT 'by_kind' AS dimension, kind AS key, CAST(count(*) AS BIGINT) AS n FROM b_all GROUP BY kind
UNION ALL SELECT 'by_risk', r.key, CAST(count(b.risk) AS BIGINT) FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) r(key)
          LEFT JOIN b_all b ON b.risk = r.key GROUP BY r.key
UNION ALL SELECT 'by_trust', trust_level, CAST(count(*) AS BIGINT) FROM b_trust GROUP BY trust_level
"""))
def b06_boundary_report(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    b = B.boundaries(spark, sub.calls, sub.functions, sub.fn_stmts)
    t = B.trust_levels(spark, sub.fn_stmts, sub.calls, sub.functions)
    return B.boundary_report(spark, b, t)
