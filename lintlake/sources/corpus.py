"""Sources: the given tables, tables of source files, directory scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``code_files(file_id, path, content)`` of a folder that holds one; see ``scan_directory`` for raw folders."""
    return table(spark, sf_dir, "code_files")


def scan_directory(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Recursive scan of a folder of source files into ``files``.

    ``wholetext`` keeps one row per file; ``file_id`` is a stable hash of the path so
    repeated scans agree without a global sort.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("uri"))
    )
    rel = F.regexp_replace(F.col("uri"), r"^.*?" + _escape(root.rstrip("/")) + "/", "")
    return raw.select(
        F.xxhash64(F.col("uri")).alias("file_id"),
        rel.alias("path"),
        F.col("content"),
    )


def _escape(text: str) -> str:
    out = []
    for ch in text:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch)
    return "".join(out)


def with_fingerprint(files: DataFrame) -> DataFrame:
    """Content hash, size and the run stamp of every file."""
    return files.select(
        "*",
        F.sha2(F.col("content"), 256).alias("content_hash"),
        F.octet_length(F.col("content")).alias("n_bytes"),
        F.current_timestamp().alias("run_ts"),
    )


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Groups of byte-identical files (partial aggregation before the shuffle)."""
    return (
        with_fingerprint(files)
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))
    )


def quarantine(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split files into (good, bad); a bad file yields an error row and the rest go on.

    Validity is judged by column expressions only: balanced brackets over the whole text
    and an even number of triple quotes.
    """
    c = F.col("content")
    opens = F.length(c) - F.length(F.translate(c, "([{", ""))
    closes = F.length(c) - F.length(F.translate(c, ")]}", ""))
    triple = (F.length(c) - F.length(F.replace(c, F.lit('"""'), F.lit("")))) / 3
    reason = (
        F.when(opens != closes, F.lit("unbalanced brackets"))
        .when(triple % 2 != 0, F.lit("unterminated string"))
    )
    tagged = files.withColumn("error", reason)
    good = tagged.filter(F.col("error").isNull()).drop("error")
    bad = tagged.filter(F.col("error").isNotNull()).select("file_id", "path", "error")
    return good, bad


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file below a folder whose name meets ``glob``: (path, name, suffix, top, bytes, modified); contents are not read.

    ``path`` is relative to the folder, ``top`` its first step; hidden files and folders (``_``, ``.``) are Spark's own and left out, and
    Spark lists no empty files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # The folder may be given without scheme, or by another name of the same place: what follows its last step counts.
    last = _escape(root.rstrip("/").rsplit("/", 1)[-1])
    rel = F.regexp_replace(F.col("path"), "^.*?/" + last + "/", "")
    f = raw.select(rel.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise("")
    return f.select("path", name.alias("name"), suffix.alias("suffix"), F.element_at(F.split("path", "/"), 1).alias("top"), "bytes", "modified")
