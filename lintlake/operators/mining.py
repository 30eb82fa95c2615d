"""Inferred contracts of tables: value rules, functional dependencies, inclusions, each with support and confidence; merged with
declared ones; and order rules over event sequences.

All are aggregations with partial results before the shuffle.  A rule holds with ``confidence`` = share of its support.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a numeric column may promise.
VALUE_RULES = {
    "not_negative": lambda c: c >= 0,
    "positive": lambda c: c > 0,
    "whole": lambda c: c == F.floor(c),
    "unit_interval": lambda c: (c >= 0) & (c <= 1),
}
INFERRED = "subject string, kind string, support long, holds long, confidence double"


def _shares(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round(F.col("holds") / F.col("support"), 6))


def value_rules(table: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """(subject, kind, support, holds, confidence, lo, hi): rules that at least ``least`` of a column's values keep.

    One pass and one row for all columns and rules; nulls are no support, but ``not_null`` counts all rows.
    """
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        rules = [F.struct(F.lit("not_null").alias("kind"), F.count(F.lit(1)).alias("support"), F.count(c).alias("holds"))]
        rules += [F.struct(F.lit(k).alias("kind"), F.count(c).alias("support"), F.count_if(rule(x)).alias("holds")) for k, rule in VALUE_RULES.items()]
        aggs.append(F.struct(F.lit(c).alias("subject"), F.array(*rules).alias("rules"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(f"a_{c}"))
    one = table.agg(*aggs)
    each = one.select(F.explode(F.array(*[F.col(f"a_{c}") for c in columns])).alias("s")).select("s.subject", "s.lo", "s.hi", F.inline("s.rules"))
    return _shares(each).filter((F.col("support") > 0) & (F.col("confidence") >= least)).select("subject", "kind", "support", "holds", "confidence", "lo", "hi")


def dependencies(table: DataFrame, pairs: list[tuple[str, str]], least: float = 0.95) -> DataFrame:
    """Functional dependencies ``a -> b`` by refinement: within each value of a, the rows of its most frequent b hold.

    (subject, kind, support, holds, confidence, groups, broken_groups).  All pairs share one scan; (pair, a, b) are counted
    before they are shuffled, so a frequent value of a is a few rows.  Nulls are a value like any other.  Where every a
    stands on one row only, nothing can be learned: such pairs are left out.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null"))
    rows = table.select(F.explode(F.array(*[F.struct(F.lit(f"{a} -> {b}").alias("subject"), text(a).alias("a"), text(b).alias("b")) for a, b in pairs])).alias("x")).select("x.*")
    per_b = rows.groupBy("subject", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    per_a = per_b.groupBy("subject", "a").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds"))
    out = per_a.groupBy("subject").agg(F.sum("n").alias("support"), F.sum("most").alias("holds"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("kinds") > 1).alias("broken_groups"))
    out = _shares(out.withColumn("kind", F.lit("determines"))).filter((F.col("confidence") >= least) & (F.col("groups") < F.col("support")))
    return out.select("subject", "kind", "support", "holds", "confidence", "groups", "broken_groups")


def inclusions(pairs: list[tuple[str, Column, DataFrame, str, Column, DataFrame]], least: float = 0.95) -> DataFrame:
    """C14: inclusion dependencies: (subject, kind, support, holds, confidence): distinct values of one column found in another.

    ``pairs``: (name, column, table, name, column, table).  Both sides are made distinct before they meet; nulls are no values.
    """
    parts = []
    for name, col, left, of_name, of_col, right in pairs:
        mine = left.select(col.cast("string").alias("v")).filter("v IS NOT NULL").distinct()
        there = right.select(of_col.cast("string").alias("v")).filter("v IS NOT NULL").distinct().withColumn("hit", F.lit(1))
        parts.append(mine.join(there, "v", "left").agg(F.count(F.lit(1)).alias("support"), F.count("hit").alias("holds")).withColumn("subject", F.lit(f"{name} in {of_name}")))
    out = reduce(DataFrame.unionByName, parts).filter("support > 0").withColumn("kind", F.lit("included"))
    return _shares(out).filter(F.col("confidence") >= least).select("subject", "kind", "support", "holds", "confidence")


def merged(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """(subject, kind, state, support, confidence): declared (subject, kind) contracts against inferred ones.

    ``confirmed``: declared and kept by all rows; ``violated``: declared, and broken by some; ``unsupported``: declared, but not
    inferred at all; ``new``: inferred only.
    """
    d = declared.select("subject", "kind").distinct().withColumn("said", F.lit(True))
    j = d.join(inferred.select("subject", "kind", "support", "holds", "confidence"), ["subject", "kind"], "full")
    state = F.when(F.col("said").isNull(), "new").when(F.col("support").isNull(), "unsupported").when(F.col("holds") == F.col("support"), "confirmed").otherwise("violated")
    return j.select("subject", "kind", state.alias("state"), "support", "confidence")


def contract_report(contracts: DataFrame, states: tuple[str, ...] = ("confirmed", "violated", "unsupported", "new")) -> DataFrame:
    """(kind, state, n): every kind with all states, those without contracts at 0."""
    per = contracts.groupBy("kind").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])
    return per.select("kind", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in states])).alias("x")).select("kind", "x.state", "x.n")


def used_before(rows: DataFrame, key: str, at: Column, use: Column, check: Column) -> DataFrame:
    """Keys whose first use stands before their first check, or that are never checked.

    (key, first_use, first_check, uses_before): ``at`` orders the rows of a key; a use at the very place of a check is after
    it.  Two aggregations, no self join: the second counts the uses before the key's first check.
    """
    r = rows.select(F.col(key), at.alias("at"), use.alias("u"), check.alias("c")).filter("u OR c")
    first = r.groupBy(key).agg(F.min(F.when(F.col("u"), F.col("at"))).alias("first_use"), F.min(F.when(F.col("c"), F.col("at"))).alias("first_check"))
    bad = first.filter("first_use IS NOT NULL AND (first_check IS NULL OR first_use < first_check)")
    early = r.filter("u").join(bad, key).filter("first_check IS NULL OR at < first_check")
    return early.groupBy(key, "first_use", "first_check").agg(F.count(F.lit(1)).alias("uses_before"))
