"""Sinks and round trips (S01, S02, S04, S08): everything is written under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.session import scratch  # noqa: F401

FORMATS = ("json", "parquet")

ISSUE_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("function", T.StringType()),
    T.StructField("issue_type", T.StringType()), T.StructField("ln", T.LongType()),
    T.StructField("severity", T.StringType()), T.StructField("category", T.StringType()),
])


def export(df: DataFrame, fmt: str, path: str, partition_by: list[str] | None = None) -> str:
    """Write a findings table in the named format; an unknown name is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format: {fmt!r} (expected one of {FORMATS})")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)
    return path


def load(spark: SparkSession, fmt: str, path: str, schema: T.StructType) -> DataFrame:
    """Read a report back with an explicit schema; malformed records fail the read."""
    if fmt == "json":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).parquet(path)


def write_tree(files: DataFrame, root: str) -> str:
    """Materialise a corpus as a nested folder tree: one folder per package, one text file per source file."""
    (files.select((F.col("file_id") / 10).cast("bigint").alias("pkg"), "content")
     .repartition("pkg").write.option("maxRecordsPerFile", 1).mode("overwrite").partitionBy("pkg").text(root))
    return root


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """S01 on a written tree: recursive whole-file scan; the package comes back from the folder name."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
           .text(root, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("uri")))
    return raw.select(F.xxhash64("uri").alias("file_id"), F.regexp_extract("uri", r"pkg=(\d+)", 1).cast("bigint").alias("pkg"), "uri",
                      # The text writer ends every record with one line separator; drop exactly that one.
                      F.when(F.col("content").endswith("\n"), F.expr("substring(content, 1, length(content) - 1)"))
                      .otherwise(F.col("content")).alias("content"))
