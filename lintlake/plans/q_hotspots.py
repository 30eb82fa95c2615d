"""Queries for hotspots (H01-H11) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import hotspots as H
from lintlake.plans.catalog import code_query, query
from lintlake.plans.oracle import with_metrics
from lintlake.plans.substrate import for_corpus
from lintlake.sources import corpus


def _severity_case(value: str = "value") -> str:
    parts = []
    for key, (m, h, c) in H.BANDS.items():
        parts.append(f"WHEN key = '{key}' THEN CASE WHEN {value} >= {c} THEN 'critical' WHEN {value} >= {h} THEN 'high' "
                     f"WHEN {value} >= {m} THEN 'medium' ELSE 'low' END")
    return "CASE " + " ".join(parts) + " END"


def _cand_sql() -> str:
    th = {k: (v, t, d) for k, v, t, _e, d in H.THRESHOLDS}
    cols = {"cyclomatic": "cyclomatic", "cognitive": "cognitive", "nesting": "max_nesting",
            "parameters": "n_params", "function_loc": "loc"}
    parts = []
    for key, col in cols.items():
        v, t, d = th[key]
        parts.append(f"SELECT file_id, 'function' AS entity_type, name, qualified_name, ln_start, ln_end, '{key}' AS key, "
                     f"'{t}' AS hotspot_type, CAST({col} AS DOUBLE) AS value, CAST({v} AS DOUBLE) AS threshold, '{d}' AS template FROM fmetrics")
    for key, col in (("methods", "n_methods"), ("class_loc", "ln_end - ln_start + 1")):
        v, t, d = th[key]
        parts.append(f"SELECT file_id, 'class' AS entity_type, name, name AS qualified_name, ln_start, ln_end, '{key}' AS key, "
                     f"'{t}' AS hotspot_type, CAST({col} AS DOUBLE) AS value, CAST({v} AS DOUBLE) AS threshold, '{d}' AS template FROM classes")
    return " UNION ALL ".join(parts)


HS_CTES = f"""
hs_cand AS ({_cand_sql()}),
hs AS (
  SELECT file_id, entity_type, name, qualified_name, CAST(ln_start AS BIGINT) AS ln_start, CAST(ln_end AS BIGINT) AS ln_end,
         hotspot_type, {_severity_case()} AS severity, value, threshold,
         printf(template, CAST(value AS INTEGER), CAST(threshold AS INTEGER)) AS description
  FROM hs_cand WHERE value > threshold
),
hs_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY
      CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 5 END,
      value DESC, qualified_name, hotspot_type, file_id) AS rank
  FROM hs
)
"""


def _hotspots(spark, sf_dir, overrides=None):
    sub = for_corpus(spark, sf_dir)
    return H.hotspots(spark, sub.fn_metrics, sub.classes, overrides)


@code_query("h01_h07_hotspots", with_metrics("""
SELECT file_id, entity_type, qualified_name, ln_start, ln_end, hotspot_type, severity, value, threshold, description FROM hs
""", HS_CTES))
def h01_h07_hotspots(spark, sf_dir):
    """Every threshold rule with its severity band."""
    return _hotspots(spark, sf_dir).drop("name", "suggestion")


@code_query("h08_top_hotspots_per_file", with_metrics("""
SELECT file_id, qualified_name, hotspot_type, severity, value, CAST(rank AS BIGINT) AS rank FROM hs_ranked WHERE rank <= 3
""", HS_CTES))
def h08_top_hotspots_per_file(spark, sf_dir):
    """Hotspots by severity rank then value, top 3 per file."""
    r = H.ranked(_hotspots(spark, sf_dir), ["file_id"], k=3)
    return r.select("file_id", "qualified_name", "hotspot_type", "severity", "value", F.col("rank").cast("bigint").alias("rank"))


@code_query("h09_band_advice", with_metrics("""
SELECT hotspot_type, severity, CAST(count(*) AS BIGINT) AS n FROM hs GROUP BY hotspot_type, severity
""", HS_CTES))
def h09_band_advice(spark, sf_dir):
    """Hotspots counted per band; the advice text comes from the same band row."""
    hs = _hotspots(spark, sf_dir)
    return hs.groupBy("hotspot_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@code_query("h10_threshold_override", with_metrics("""
SELECT file_id, qualified_name, hotspot_type, value, threshold FROM (
  SELECT file_id, qualified_name, hotspot_type, value,
         CASE WHEN key = 'cyclomatic' THEN CAST(5.0 AS DOUBLE) WHEN key = 'function_loc' THEN CAST(20.0 AS DOUBLE) ELSE threshold END AS threshold
  FROM hs_cand) WHERE value > threshold
""", HS_CTES))
def h10_threshold_override(spark, sf_dir):
    """Stricter thresholds for complexity (5) and function length (20); the rest keep defaults."""
    hs = _hotspots(spark, sf_dir, {"cyclomatic": 5.0, "function_loc": 20.0})
    return hs.select("file_id", "qualified_name", "hotspot_type", "value", "threshold")


_REPORT_SQL = """
SELECT CASE WHEN grouping(hotspot_type) = 0 THEN 'by_type' WHEN grouping(severity) = 0 THEN 'by_severity'
            WHEN grouping(entity_type) = 0 THEN 'by_entity_type' WHEN grouping(entity) = 0 THEN 'by_entity' ELSE 'total' END AS dimension,
       coalesce(hotspot_type, severity, entity_type, entity, 'all') AS key, CAST(count(*) AS BIGINT) AS n
FROM (SELECT hotspot_type, severity, entity_type, {entity} AS entity FROM {src})
GROUP BY GROUPING SETS ((hotspot_type), (severity), (entity_type), (entity), ())
"""


@code_query("h11_hotspot_report", with_metrics(_REPORT_SQL.format(
    entity="entity_type || ':' || CAST(file_id AS VARCHAR) || ':' || qualified_name", src="hs"), HS_CTES))
def h11_hotspot_report(spark, sf_dir):
    return H.report(_hotspots(spark, sf_dir))


_EVENT_HS = """(SELECT event_type AS hotspot_type, 'user' AS entity_type, user_id, CASE WHEN value >= 50 THEN 'critical'
   WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS severity FROM events)"""


@query("h11_event_report", _REPORT_SQL.format(entity="'user:' || CAST(user_id AS VARCHAR)", src=_EVENT_HS))
def h11_event_report(spark, sf_dir):
    """H11 at size: the same grouping-sets report over ``events`` (type, banded value as severity, user as entity)."""
    ev = corpus.table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    sev = (F.when(F.col("value") >= 50, "critical").when(F.col("value") >= 20, "high")
           .when(F.col("value") >= 10, "medium").otherwise("low"))
    hs = ev.select(F.col("event_type").alias("hotspot_type"), sev.alias("severity"),
                   F.lit("user").alias("entity_type"), F.lit(0).alias("file_id"), F.col("user_id").cast("string").alias("qualified_name"))
    g = H.report(hs)
    return g.withColumn("key", F.when(F.col("dimension") == "by_entity",
                                      F.regexp_replace("key", r"^user:0:", "user:")).otherwise(F.col("key")))


def _package_ranked(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    hs = _hotspots(spark, sf_dir).filter(
        (F.col("entity_type") == "function") & F.col("hotspot_type").isin("deep_nesting", "large_size"))
    pkg = sub.files.select("file_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("package"))
    return H.ranked(hs.join(pkg, "file_id"), ["package"])


@code_query("flagship_package_hotspots", with_metrics("""
SELECT package, file_id, qualified_name, hotspot_type, severity, value, CAST(row_number() OVER (PARTITION BY package ORDER BY
      CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 5 END,
      value DESC, qualified_name, hotspot_type, file_id) AS BIGINT) AS rank
FROM (SELECT h.*, regexp_extract(c.path, '^(.*)/[^/]*$', 1) AS package FROM hs h JOIN code_files c ON c.file_id = h.file_id
      WHERE h.entity_type = 'function' AND h.hotspot_type IN ('deep_nesting', 'large_size'))
""", HS_CTES))
def flagship(spark, sf_dir):
    """Which functions exceed the nesting or length threshold, worst first, per package."""
    r = _package_ranked(spark, sf_dir)
    return r.select("package", "file_id", "qualified_name", "hotspot_type", "severity", "value",
                    F.col("rank").cast("bigint").alias("rank"))
