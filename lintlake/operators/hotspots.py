"""Threshold rules, severity bands, ordering and report of complexity hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default thresholds by key (hotspot type, entity, description template).
THRESHOLDS = [
    ("cyclomatic", 10.0, "high_cc", "function", "Function has cyclomatic complexity of %d (threshold: %d)"),
    ("cognitive", 15.0, "high_cognitive", "function", "Function has cognitive complexity of %d (threshold: %d)"),
    ("nesting", 4.0, "deep_nesting", "function", "Function has nesting depth of %d (threshold: %d)"),
    ("parameters", 5.0, "long_params", "function", "Function has %d parameters (threshold: %d)"),
    ("function_loc", 50.0, "large_size", "function", "Function is %d lines long (threshold: %d)"),
    ("methods", 10.0, "many_methods", "class", "Class has %d methods (threshold: %d)"),
    ("class_loc", 300.0, "large_size", "class", "Class is %d lines long (threshold: %d)"),
]

# Severity band lower bounds per metric key (medium, high, critical).
BANDS = {
    "cyclomatic": (10, 20, 50),
    "cognitive": (15, 20, 30),
    "nesting": (4, 5, 6),
    "parameters": (5, 7, 10),
    "function_loc": (50, 75, 100),
    "methods": (10, 15, 20),
    "class_loc": (300, 400, 500),
}

# Advice per metric key; cyclomatic has a stronger text in the critical band.
ADVICE = {
    "cyclomatic": "split off branches that do one thing each",
    "cyclomatic_critical": "rewrite as several functions before adding anything",
    "cognitive": "return early and move inner blocks out",
    "nesting": "turn outer conditions around and leave early",
    "parameters": "pass related values as one object",
    "function_loc": "cut the function where its steps end",
    "methods": "move a group of related methods to a class of their own",
    "class_loc": "split the class by what its parts are used for",
}

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def thresholds(spark: SparkSession, overrides: dict[str, float] | None = None) -> DataFrame:
    """Threshold table; overrides by key are a left join with ``coalesce`` onto the defaults."""
    base = spark.createDataFrame(
        [(k, v, t, e, d) for k, v, t, e, d in THRESHOLDS],
        "key string, default_value double, hotspot_type string, entity_type string, template string",
    )
    ov = spark.createDataFrame(list((overrides or {}).items()), "key string, override double")
    return base.join(F.broadcast(ov), "key", "left").select(
        "key", "hotspot_type", "entity_type", "template",
        F.coalesce("override", "default_value").alias("threshold"))


def bands(spark: SparkSession) -> DataFrame:
    """Band table (key, lo, hi, severity, advice) with half-open ranges."""
    inf = float("inf")
    rows = []
    for key, (m, h, c) in BANDS.items():
        for lo, hi, sev in ((-inf, m, "low"), (m, h, "medium"), (h, c, "high"), (c, inf, "critical")):
            adv = ADVICE["cyclomatic_critical"] if key == "cyclomatic" and sev == "critical" else ADVICE[key]
            rows.append((key, float(lo), float(hi), sev, adv))
    return spark.createDataFrame(rows, "key string, lo double, hi double, severity string, advice string")


def severity_rank(col):
    m = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col], F.lit(5))


def hotspots(spark: SparkSession, fn_metrics: DataFrame, classes: DataFrame,
             overrides: dict[str, float] | None = None) -> DataFrame:
    """H01-H07 in one pass: metrics unpivoted to (key, value), thresholds and bands joined."""
    f = fn_metrics.select(
        "file_id", F.lit("function").alias("entity_type"), "name", "qualified_name", "ln_start", "ln_end",
        F.col("cyclomatic").cast("double").alias("cyclomatic"), F.col("cognitive").cast("double").alias("cognitive"),
        F.col("max_nesting").cast("double").alias("nesting"), F.col("n_params").cast("double").alias("parameters"),
        F.col("loc").cast("double").alias("function_loc"),
    ).unpivot(["file_id", "entity_type", "name", "qualified_name", "ln_start", "ln_end"],
              ["cyclomatic", "cognitive", "nesting", "parameters", "function_loc"], "key", "value")
    c = classes.select(
        "file_id", F.lit("class").alias("entity_type"), "name", F.col("name").alias("qualified_name"), "ln_start", "ln_end",
        F.size("methods").cast("double").alias("methods"),
        (F.col("ln_end") - F.col("ln_start") + 1).cast("double").alias("class_loc"),
    ).unpivot(["file_id", "entity_type", "name", "qualified_name", "ln_start", "ln_end"],
              ["methods", "class_loc"], "key", "value")
    th = F.broadcast(thresholds(spark, overrides).drop("entity_type"))
    hs = f.unionByName(c).join(th, "key").filter(F.col("value") > F.col("threshold"))
    b = F.broadcast(bands(spark))
    hs = hs.join(b, (hs["key"] == b["key"]) & (hs["value"] >= b["lo"]) & (hs["value"] < b["hi"])).drop(b["key"])
    return hs.select(
        "file_id", "entity_type", "name", "qualified_name", F.col("ln_start").cast("bigint").alias("ln_start"),
        F.col("ln_end").cast("bigint").alias("ln_end"), "hotspot_type", "severity", "value", "threshold",
        F.expr("format_string(template, CAST(value AS INT), CAST(threshold AS INT))").alias("description"),
        F.col("advice").alias("suggestion"),
    )


def ranked(hs: DataFrame, partition_cols: list[str], k: int | None = None) -> DataFrame:
    """Order by severity rank then value descending inside each partition; optional top-k."""
    w = Window.partitionBy(*partition_cols).orderBy(
        severity_rank(F.col("severity")), F.col("value").desc(), F.col("qualified_name"), F.col("hotspot_type"),
        F.col("file_id"))
    out = hs.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k else out


def report(hs: DataFrame) -> DataFrame:
    """Counts by type, by severity, by entity kind, by entity and the total in one grouping-sets pass."""
    ent = F.concat_ws(":", F.col("entity_type"), F.col("file_id").cast("string"), F.col("qualified_name"))
    g = hs.select("hotspot_type", "severity", "entity_type", ent.alias("entity")).groupingSets(
        [["hotspot_type"], ["severity"], ["entity_type"], ["entity"], []],
        "hotspot_type", "severity", "entity_type", "entity",
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping("hotspot_type").alias("g1"), F.grouping("severity").alias("g2"),
        F.grouping("entity_type").alias("g3"), F.grouping("entity").alias("g4"),
    )
    dim = (F.when(F.col("g1") == 0, "by_type").when(F.col("g2") == 0, "by_severity")
           .when(F.col("g3") == 0, "by_entity_type").when(F.col("g4") == 0, "by_entity").otherwise("total"))
    key = F.coalesce("hotspot_type", "severity", "entity_type", "entity", F.lit("all"))
    return g.select(dim.alias("dimension"), key.alias("key"), "n")
