"""Queries for complexity metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lintlake.operators import metrics as M
from lintlake.plans.catalog import code_query
from lintlake.plans.oracle import with_metrics
from lintlake.plans.substrate import for_corpus
from lintlake.sources import corpus


@code_query("m01_cyclomatic", with_metrics("""
SELECT file_id, qualified_name, CAST(ln_start AS BIGINT) AS ln_start, cyclomatic FROM fmetrics
"""))
def m01_cyclomatic(spark, sf_dir):
    fm = for_corpus(spark, sf_dir).fn_metrics
    return fm.select("file_id", "qualified_name", F.col("ln_start").cast("bigint").alias("ln_start"), "cyclomatic")


@code_query("m02_file_cyclomatic", with_metrics("""
SELECT c.file_id, CAST(coalesce(sum(f.cyclomatic), 0) AS BIGINT) AS cyclomatic_total
FROM code_files c LEFT JOIN fmetrics f ON f.file_id = c.file_id GROUP BY c.file_id
"""))
def m02_file_cyclomatic(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    per = sub.fn_metrics.groupBy("file_id").agg(F.sum("cyclomatic").alias("cc"))
    return sub.files.select("file_id").join(per, "file_id", "left").select(
        "file_id", F.coalesce("cc", F.lit(0)).cast("bigint").alias("cyclomatic_total"))


@code_query("m03_cognitive", with_metrics("""
SELECT file_id, qualified_name, CAST(ln_start AS BIGINT) AS ln_start, cognitive FROM fmetrics
"""))
def m03_cognitive(spark, sf_dir):
    fm = for_corpus(spark, sf_dir).fn_metrics
    return fm.select("file_id", "qualified_name", F.col("ln_start").cast("bigint").alias("ln_start"), "cognitive")


_MI_SQL = r"""
tok AS (
  SELECT file_id, 'd:' || unnest(regexp_extract_all(coalesce(bare, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+', 0)) AS t FROM stmts
  UNION ALL
  SELECT file_id, 'r:' || unnest(regexp_extract_all(coalesce(bare, ''), '[-+*/%=<>!&|^~@]+', 0)) AS t FROM stmts
),
hal AS (
  SELECT file_id, count(*) FILTER (WHERE starts_with(t, 'r:')) AS n_op, count(*) FILTER (WHERE starts_with(t, 'd:')) AS n_od,
         count(DISTINCT t) FILTER (WHERE starts_with(t, 'r:')) AS u_op, count(DISTINCT t) FILTER (WHERE starts_with(t, 'd:')) AS u_od
  FROM tok GROUP BY file_id
),
rawm AS (
  SELECT file_id, count(*) FILTER (WHERE is_content AND NOT in_str) AS sloc, count(*) FILTER (WHERE is_comment) AS comments
  FROM lines GROUP BY file_id
),
fcc AS (SELECT file_id, sum(cyclomatic) AS cyclomatic_total FROM fmetrics GROUP BY file_id),
mi0 AS (
  SELECT r.file_id, r.sloc, r.comments, (h.n_op + h.n_od) * log2(h.u_op + h.u_od) AS volume, coalesce(c.cyclomatic_total, 0) AS cc
  FROM rawm r LEFT JOIN hal h ON h.file_id = r.file_id LEFT JOIN fcc c ON c.file_id = r.file_id
),
mi AS (
  SELECT file_id, sloc, round(coalesce(volume, 0.0), 4) AS halstead_volume,
    round(CASE WHEN coalesce(volume, 0) <= 0 OR sloc <= 0 THEN 100.0
         ELSE least(greatest(0.0, (171 - 5.2 * ln(volume) - 0.23 * cc - 16.2 * ln(sloc)
              + 50 * sin(sqrt(2.46 * radians(CASE WHEN sloc > 0 THEN comments * 100.0 / sloc ELSE 0.0 END)))) * 100 / 171.0), 100.0) END, 4)
      AS maintainability_index
  FROM mi0
)
"""


def _mi(sub):
    fcc = sub.fn_metrics.groupBy("file_id").agg(F.sum("cyclomatic").alias("cyclomatic_total"))
    return M.halstead_mi(sub.lines, fcc)


@code_query("m04_maintainability", with_metrics("""
SELECT file_id, maintainability_index, CAST(sloc AS BIGINT) AS sloc, halstead_volume FROM mi
""", _MI_SQL))
def m04_maintainability(spark, sf_dir):
    mi = _mi(for_corpus(spark, sf_dir))
    return mi.select("file_id", "maintainability_index", F.col("sloc").cast("bigint").alias("sloc"), "halstead_volume")


@code_query("m05_file_metrics", with_metrics("""
SELECT m.file_id, CAST(coalesce(f.cc, 0) AS BIGINT) AS cyclomatic, CAST(coalesce(f.cog, 0) AS BIGINT) AS cognitive,
       CAST(l.loc AS BIGINT) AS lines_of_code, m.maintainability_index
FROM mi m
JOIN (SELECT file_id, count(*) FILTER (WHERE is_content) AS loc FROM lines GROUP BY file_id) l ON l.file_id = m.file_id
LEFT JOIN (SELECT file_id, sum(cyclomatic) AS cc, sum(cognitive) AS cog FROM fmetrics GROUP BY file_id) f ON f.file_id = m.file_id
""", _MI_SQL))
def m05_file_metrics(spark, sf_dir):
    """All metrics of a file in one row."""
    sub = for_corpus(spark, sf_dir)
    per = sub.fn_metrics.groupBy("file_id").agg(F.sum("cyclomatic").alias("cc"), F.sum("cognitive").alias("cog"))
    loc = sub.lines.groupBy("file_id").agg(F.count_if("is_content").alias("loc"))
    return _mi(sub).join(loc, "file_id").join(per, "file_id", "left").select(
        "file_id", F.coalesce("cc", F.lit(0)).cast("bigint").alias("cyclomatic"),
        F.coalesce("cog", F.lit(0)).cast("bigint").alias("cognitive"),
        F.col("loc").cast("bigint").alias("lines_of_code"), "maintainability_index")


@code_query("m06_nesting", with_metrics("""
SELECT file_id, qualified_name, max_nesting, CAST(nesting_ln AS BIGINT) AS nesting_ln, nesting_kind FROM fmetrics
"""))
def m06_nesting(spark, sf_dir):
    fm = for_corpus(spark, sf_dir).fn_metrics
    return fm.select("file_id", "qualified_name", "max_nesting",
                     F.col("nesting_ln").cast("bigint").alias("nesting_ln"), "nesting_kind")


@code_query("m07_nesting_blocks_only", with_metrics("""
SELECT f.file_id, f.qualified_name,
       CAST(coalesce((SELECT max(nest + 1) FROM fst s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start
                      AND s.kind IN ('if', 'elif', 'for', 'while', 'try', 'with')), 0) AS BIGINT) AS nesting
FROM functions f
"""))
def m07_nesting_blocks_only(spark, sf_dir):
    """Nesting counted over block statements only (no lambda / comprehension)."""
    sub = for_corpus(spark, sf_dir)
    per = sub.fn_stmts.filter(F.col("kind").isin("if", "elif", "for", "while", "try", "with")).groupBy(
        "file_id", F.col("fn_ln").alias("ln_start")).agg(F.max(F.col("nest") + 1).alias("n"))
    return sub.functions.join(per, ["file_id", "ln_start"], "left").select(
        "file_id", "qualified_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("nesting"))


@code_query("m08_complexity_summary", with_metrics("""
SELECT file_id, round(avg(cyclomatic), 2) AS avg_complexity, CAST(count(*) AS BIGINT) AS n_functions,
       CAST(count(*) FILTER (WHERE cyclomatic > 10) AS BIGINT) AS n_complex,
       coalesce(string_agg(qualified_name, ',' ORDER BY qualified_name) FILTER (WHERE cyclomatic > 10), '') AS complex_functions
FROM fmetrics GROUP BY file_id
"""))
def m08_complexity_summary(spark, sf_dir):
    fm = for_corpus(spark, sf_dir).fn_metrics
    return fm.groupBy("file_id").agg(
        F.round(F.avg("cyclomatic"), 2).alias("avg_complexity"),
        F.count(F.lit(1)).alias("n_functions"),
        F.count_if(F.col("cyclomatic") > 10).alias("n_complex"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("cyclomatic") > 10, F.col("qualified_name")))), ",")
        .alias("complex_functions"),
    )


@code_query("m09_heatmap", with_metrics("""
SELECT file_id, qualified_name, CAST(ln_start AS BIGINT) AS ln_start, cyclomatic,
       max(cyclomatic) OVER (PARTITION BY file_id) AS file_max
FROM fmetrics
"""))
def m09_heatmap(spark, sf_dir):
    fm = for_corpus(spark, sf_dir).fn_metrics
    return fm.select("file_id", "qualified_name", F.col("ln_start").cast("bigint").alias("ln_start"), "cyclomatic",
                     F.max("cyclomatic").over(Window.partitionBy("file_id")).alias("file_max"))
