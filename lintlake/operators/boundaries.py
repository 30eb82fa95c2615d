"""Security boundaries (B01-B06): input sources, output sinks, privileged calls, trust levels.

The source and sink vocabularies are small fixed tables, so they are broadcast and
matched with ``contains`` conditions; the sink category is the first one that matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Substrings of call names that read untrusted input.
UNTRUSTED_SOURCES = ["request", "flask.request", "HttpRequest", "WebRequest", "fastapi.Request", "starlette.request",
                     "input", "sys.stdin", "os.environ", "argv", "getattr", "__getitem__"]
# Request-like parameter annotations.
REQUEST_TYPES = ["Request", "HttpRequest", "WebRequest"]
# Sink categories in match order with their substrings and risk.
SINKS = [
    ("database", ["execute", "executemany", "cursor.execute", "db.execute"], "medium"),
    ("network", ["requests.", "urllib.", "http.client", "socket.send", "socket.sendto"], "medium"),
    ("file", ["open(", "file.write", "Path.write", "os.remove", "os.unlink"], "medium"),
    ("command", ["os.system", "subprocess.call", "subprocess.run", "subprocess.Popen"], "critical"),
    ("eval", ["eval", "exec", "__import__"], "critical"),
]
PRIVILEGED = ["eval", "exec", "__import__"]
RISKS = ["low", "medium", "high", "critical"]


def sink_table(spark: SparkSession) -> DataFrame:
    rows = [(prio, cat, s, risk) for prio, (cat, subs, risk) in enumerate(SINKS) for s in subs]
    return spark.createDataFrame(rows, "prio int, category string, needle string, risk string")


def source_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in UNTRUSTED_SOURCES], "needle string")


def boundaries(spark: SparkSession, calls: DataFrame, functions: DataFrame, fst: DataFrame) -> DataFrame:
    """B01-B04 as one table: (file_id, entity, ln, kind, source_or_sink, risk, detail)."""
    c = calls.select("file_id", F.col("qualified_name").alias("entity"), "ln", "call", "code").distinct()
    src = c.join(F.broadcast(source_table(spark)), F.col("call").contains(F.col("needle")), "left_semi")
    b01b = src.select("file_id", "entity", "ln", F.lit("input").alias("kind"), F.col("call").alias("source_or_sink"),
                      F.lit("medium").alias("risk"), F.lit("untrusted source call").alias("detail"))
    req = functions.select("file_id", F.col("qualified_name").alias("entity"), F.col("ln_start").alias("ln"), F.explode("params").alias("p")) \
        .filter(F.exists(F.array(*[F.lit(t) for t in REQUEST_TYPES]), lambda t: F.coalesce(F.col("p.type_hint"), F.lit("")).contains(t)))
    b01a = req.select("file_id", "entity", "ln", F.lit("input").alias("kind"), F.col("p.name").alias("source_or_sink"),
                      F.lit("high").alias("risk"), F.lit("request-typed parameter").alias("detail"))
    sk = c.join(F.broadcast(sink_table(spark)), F.col("call").contains(F.col("needle"))).groupBy(
        "file_id", "entity", "ln", "call").agg(F.min_by(F.struct("category", "risk"), "prio").alias("s"))
    b02 = sk.select("file_id", "entity", "ln", F.lit("output").alias("kind"), F.col("call").alias("source_or_sink"),
                    F.col("s.risk").alias("risk"), F.col("s.category").alias("detail"))
    b03 = c.filter(F.col("call").isin(*PRIVILEGED)).select(
        "file_id", "entity", "ln", F.lit("privilege").alias("kind"), F.col("call").alias("source_or_sink"),
        F.lit("critical").alias("risk"), F.lit("dangerous function").alias("detail"))
    fmt = fst.select("file_id", F.col("qualified_name").alias("entity"), "ln", "code")
    left = F.regexp_extract("code", FORMAT_MOD, 1)
    b04 = fmt.filter((left != "") & F.lower(left).contains("input")).select(
        "file_id", "entity", "ln", F.lit("output").alias("kind"), F.lit("string_format").alias("source_or_sink"),
        F.lit("high").alias("risk"), F.lit("format string injection").alias("detail"))
    out = b01a.unionByName(b01b).unionByName(b02).unionByName(b03).unionByName(b04)
    return out.withColumn("ln", F.col("ln").cast("bigint"))


FORMAT_MOD = r"^(.*\S)\s*%\s*(\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*$"


def trust_levels(spark: SparkSession, fst: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Untrusted variables: assigned from a source call, or request-typed parameters."""
    tgt = F.regexp_extract("code", r"^([A-Za-z_][A-Za-z0-9_]*)\s*(:[^=]+)?=[^=]", 1)
    asg = fst.filter(F.col("kind") == "assign").select("file_id", "fn_ln", "ln", tgt.alias("variable")).filter(F.col("variable") != "")
    first_call = calls.groupBy("file_id", "ln").agg(F.min_by("call", "pos").alias("call"))
    src = first_call.join(F.broadcast(source_table(spark)), F.col("call").contains(F.col("needle")), "left_semi")
    a = asg.join(src, ["file_id", "ln"]).groupBy("file_id", "fn_ln", "variable").agg(
        F.array_join(F.array_sort(F.collect_set("call")), ",").alias("sources"), F.max("ln").alias("last_ln"))
    req = functions.select("file_id", F.col("ln_start").alias("fn_ln"), F.explode("params").alias("p")).filter(
        F.exists(F.array(*[F.lit(t) for t in REQUEST_TYPES]), lambda t: F.coalesce(F.col("p.type_hint"), F.lit("")).contains(t))).select(
        "file_id", "fn_ln", F.col("p.name").alias("variable"), F.lit("request").alias("sources"), F.col("fn_ln").alias("last_ln"))
    out = a.unionByName(req).groupBy("file_id", "fn_ln", "variable").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", ","))))), ",").alias("sources"),
        F.max("last_ln").alias("last_ln"))
    return out.select("file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), "variable", F.lit("untrusted").alias("trust_level"),
                      "sources", F.col("last_ln").cast("bigint").alias("last_ln"))


def boundary_report(spark: SparkSession, b: DataFrame, trust: DataFrame) -> DataFrame:
    """Counts by kind, by risk level (all four levels kept, zero included) and by trust level."""
    by_kind = b.groupBy(F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit("by_kind"))
    risks = spark.createDataFrame([(r,) for r in RISKS], "key string")
    by_risk = risks.join(b.groupBy(F.col("risk").alias("key")).agg(F.count(F.lit(1)).alias("c")), "key", "left").select(
        "key", F.coalesce("c", F.lit(0)).cast("bigint").alias("n")).withColumn("dimension", F.lit("by_risk"))
    by_trust = trust.groupBy(F.col("trust_level").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit("by_trust"))
    return by_kind.unionByName(by_risk).unionByName(by_trust).select("dimension", "key", F.col("n").cast("bigint").alias("n"))
