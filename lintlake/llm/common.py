"""Helpers shared by the operators: tables, keys, steps written to the shared folder, global offsets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a step once under the shared checkpoint folder and read it back (cuts lineage, survives lost executors)."""
    return materialize(df, name, **options)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def id_remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def fresh(names: Iterable[str], base: str) -> str:
    """A column name that is not taken."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base = "_" + base
    return base


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_offset(totals: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before in ``order``.

    For small tables only: one row per file, partition or size class, never one per document.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def carried(docs: DataFrame, *apart: str) -> Column:
    """All columns but ``apart`` as one struct ``row``, so that no name of the input can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c not in apart], F.lit(True).alias("__row")).alias("row")


def restored(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The original ``columns`` from ``row``, or from ``changed`` where an operator made them anew."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])
