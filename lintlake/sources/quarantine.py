"""Lenient parsing (S02, X23): rows that do not keep the declared fields become error rows, and the rest go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.session import scratch


def parsed(df: DataFrame, column: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """``df`` with one long column per field, ``reason`` and ``confidence``.

    ``column`` is parsed once as a variant; ``fields``: name -> (least, most).  ``reason`` is null for a good row, else the first
    that holds: ``no_text``, ``not_json``, ``missing:<field>``, ``not_a_number:<field>``, ``out_of_range:<field>``.  A value that
    is no number is null.  Confidence is ``high`` for a good row, ``medium`` if it is JSON of another shape, ``low`` if it is none.
    """
    v = F.try_parse_json(column)
    path = lambda f: f"$.{f}"
    out = df.withColumn("__v", v)
    for f in fields:
        out = out.withColumn(f, F.try_variant_get("__v", path(f), "long"))

    def wrong(f: str, least: int, most: int) -> Column:
        there = F.try_variant_get("__v", path(f), "string")
        return (F.when(there.isNull(), F.lit(f"missing:{f}")).when(F.col(f).isNull(), F.lit(f"not_a_number:{f}")).when(~F.col(f).between(least, most), F.lit(f"out_of_range:{f}")))

    reason = F.when(F.col(column).isNull(), F.lit("no_text")).when(F.col("__v").isNull(), F.lit("not_json")).otherwise(F.coalesce(*[wrong(f, a, z) for f, (a, z) in fields.items()], F.lit(None).cast("string")))
    out = out.withColumn("reason", reason)
    confidence = F.when(F.col("reason").isNull(), "high").when(F.col("reason").isin("no_text", "not_json"), "low").otherwise("medium")
    return out.withColumn("confidence", confidence).drop("__v")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of ``parsed``, written once in two folders of one table."""
    path = scratch(rows.sparkSession, "quarantine")
    state = F.when(F.col("reason").isNull(), "good").otherwise("bad")
    rows.withColumn("state", state).write.partitionBy("state").parquet(path)
    back = rows.sparkSession.read.schema(reduce(lambda s, f: s.add(f.name, f.dataType), rows.schema, type(rows.schema)()).add("state", "string")).parquet(path)
    return back.filter("state = 'good'").drop("state", "reason"), back.filter("state = 'bad'").drop("state")
