"""Rollups, gates and report shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["logic", "security", "performance", "maintainability"]
TIERS = ["tier1_deterministic", "tier2_heuristic", "tier3_semantic"]
SEV_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
# Properties shown by the absence of matching findings.
PROPERTIES = [
    ("no_security_findings", "No critical security vulnerabilities detected (Tier 1 & 2)"),
    ("no_resource_leaks", "No resource leaks detected (open() without context manager)"),
    ("no_mutable_defaults", "No mutable default arguments"),
]


def sev_rank(col):
    m = F.create_map(*[x for k, v in SEV_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col], F.lit(5))


def summary(files: DataFrame, issues: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per file total, by severity (zero kept, missing counted as low), by category, function and class counts."""
    sev = F.coalesce(F.col("severity"), F.lit("low"))
    agg = issues.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[F.count_if(sev == s).alias(s) for s in SEVERITIES[:4]],
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    fc = functions.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions_count"))
    cc = classes.groupBy("file_id").agg(F.count(F.lit(1)).alias("classes_count"))
    out = files.select("file_id").join(agg, "file_id", "left").join(fc, "file_id", "left").join(cc, "file_id", "left")
    cols = ["total_issues"] + SEVERITIES[:4] + CATEGORIES + ["functions_count", "classes_count"]
    return out.select("file_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols])


def report_metrics(files: DataFrame, lines: DataFrame, functions: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file line counts, function count, findings by severity and by tier."""
    lc = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_lines"), F.count_if("is_content").alias("lines_of_code"))
    fc = functions.groupBy("file_id").agg(F.count(F.lit(1)).alias("function_count"))
    fa = findings.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("issue_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_issues") for s in SEVERITIES],
        *[F.count_if(F.col("tier") == t).alias(f"{t.split('_')[0]}_findings") for t in TIERS])
    out = files.select("file_id").join(lc, "file_id", "left").join(fc, "file_id", "left").join(fa, "file_id", "left")
    cols = ["total_lines", "lines_of_code", "function_count", "issue_count"] + [f"{s}_issues" for s in SEVERITIES] + \
        [f"{t.split('_')[0]}_findings" for t in TIERS]
    return out.select("file_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols])


def proven_properties(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, property) rows for properties no finding of the file contradicts."""
    t = F.lower("title")
    hits = findings.select(
        "file_id",
        F.explode(F.array_compact(F.array(
            F.when(F.col("category") == "security", F.lit("no_security_findings")),
            F.when(t.contains("resource leak") | t.contains("file"), F.lit("no_resource_leaks")),
            F.when(t.contains("mutable"), F.lit("no_mutable_defaults"))))).alias("property")).distinct()
    props = files.select("file_id", F.explode(F.array(*[F.struct(F.lit(k).alias("property"), F.lit(v).alias("text"))
                                                        for k, v in PROPERTIES])).alias("p")).select("file_id", "p.property", "p.text")
    return props.join(hits, ["file_id", "property"], "left_anti")


def file_report(files: DataFrame, functions: DataFrame, findings: DataFrame) -> DataFrame:
    """One report row per file: content hash, functions analysed, ordered finding ids, count."""
    fc = functions.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions_analyzed"))
    fi = findings.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("issue_id")), ",").alias("issue_ids"),
                                         F.count(F.lit(1)).alias("n_findings"))
    return files.select("file_id", F.sha2("content", 256).alias("content_hash")).join(fc, "file_id", "left").join(fi, "file_id", "left").select(
        "file_id", "content_hash", F.coalesce("functions_analyzed", F.lit(0)).cast("bigint").alias("functions_analyzed"),
        F.coalesce("issue_ids", F.lit("")).alias("issue_ids"), F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"))


def ordered_sections(findings: DataFrame) -> DataFrame:
    """Findings ordered critical..info inside each file, with the section size of their severity."""
    w = Window.partitionBy("file_id").orderBy(sev_rank(F.col("severity")), "ln", "issue_id")
    ws = Window.partitionBy("file_id", "severity")
    return findings.select("file_id", "issue_id", "severity", "title", F.row_number().over(w).cast("bigint").alias("position"),
                           F.count(F.lit(1)).over(ws).alias("section_size"))


def top_security(issues: DataFrame, k: int = 5) -> DataFrame:
    """The first k security findings per file and how many remain."""
    sec = issues.filter(F.col("category") == "security")
    w = Window.partitionBy("file_id").orderBy(sev_rank(F.col("severity")), "ln", "issue_type")
    r = sec.select("*", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("file_id")).alias("total"))
    return r.filter(F.col("rn") <= k).select("file_id", "function", "issue_type", "ln", "severity", F.col("rn").cast("bigint").alias("rank"),
                                             F.greatest(F.col("total") - k, F.lit(0)).cast("bigint").alias("remaining"))


def gate(files: DataFrame, issues: DataFrame, errors: DataFrame) -> DataFrame:
    """Per file: passes unless a security finding exists; strict mode fails on any finding or an error row."""
    c = issues.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == "security").alias("n_sec"))
    e = errors.select("file_id").distinct().withColumn("has_error", F.lit(True))
    j = files.select("file_id").join(c, "file_id", "left").join(e, "file_id", "left")
    n, ns, he = F.coalesce("n", F.lit(0)), F.coalesce("n_sec", F.lit(0)), F.coalesce("has_error", F.lit(False))
    return j.select("file_id", n.cast("bigint").alias("n_findings"), ns.cast("bigint").alias("n_security"), he.alias("has_error"),
                    ((ns == 0) & ~he).alias("passed"), ((n == 0) & ~he).alias("passed_strict"))


def corpus_gate(g: DataFrame) -> DataFrame:
    """All files passed?  Counts of failures in both modes."""
    return g.agg(F.count(F.lit(1)).alias("files"), F.bool_and("passed").alias("all_passed"),
                 F.count_if(~F.col("passed")).alias("failed"), F.count_if(~F.col("passed_strict")).alias("failed_strict"))


def sarif_rows(issues: DataFrame, files: DataFrame) -> DataFrame:
    """SARIF-shaped result rows: rule id ``category.type``, level, message, location."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    j = issues.join(files.select("file_id", "path"), "file_id")
    return j.select("file_id", F.concat_ws(".", "category", "issue_type").alias("rule_id"), level.alias("level"),
                    F.concat(F.col("issue_type"), F.lit(" in "), F.col("function")).alias("message"),
                    F.col("path").alias("uri"), F.coalesce("ln", F.lit(1)).cast("bigint").alias("start_line"))


def nested_report(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One nested JSON document per file: totals and the issues grouped by category."""
    g = issues.groupBy("file_id", "category").agg(
        F.array_sort(F.collect_list(F.struct(F.col("ln").alias("line"), F.col("issue_type").alias("type"),
                                             F.col("function").alias("function"), F.col("severity").alias("severity")))).alias("items"))
    per = g.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("category", "items"))).alias("by_category"))
    tot = issues.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    j = files.select("file_id", "path").join(tot, "file_id").join(per, "file_id")
    doc = F.to_json(F.struct(F.col("path").alias("file"), F.col("total").alias("total"), F.col("by_category").alias("issues")))
    return j.select("file_id", doc.alias("report"))
