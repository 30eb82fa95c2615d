"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded block selection.

DataFrame functions only.

1. *Targets.*  Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words of the corpus.  No
   target passes ``max_repeat`` times its source; the excess is shared again by weight (water filling over the sources).
2. *Blocks.*  The documents of a source, in seeded order, form one stream of words that is cut into blocks of
   ``block_words`` words.  A stream is split into shards of about ``shard_words`` words, so no task ever holds a whole source.
3. *Quotas.*  The corpus' blocks are allocated to sources by the highest quotients target / (2k + 1), and a source's
   blocks to its shards in the same way by the shards' sizes.  Only the few seats near the last one awarded are ranked:
   seats below ``round(target * (N - K) / T)`` are certain (K parties), seats above ``round(target * (N + K) / T)`` lose.
4. *Selection.*  A shard with quota q over n blocks takes every block q div n times, and q mod n blocks once more: those
   whose place under the seeded permutation ``(p * block + c) mod n`` (p a prime above n) is below q mod n.

Defined results: null text and text without words have size 0, are never taken and keep their row; null sources form a
source of their own, the last one; repeated rows are separate documents; an empty table gives an empty result; other
columns of the input are ignored here and clash with nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import WORD, carried, keep

WEIGHTS = (1, 2, 3)
# Primes above every shard's number of blocks, so each is coprime to it.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def targets(sources: DataFrame, max_repeat: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source in and out.

    Water filling in closed form: sources are capped in the order of cap / weight; the level of the others is
    (T - caps so far) / (weights left), and the first source whose cap is not below that level ends the capped ones.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("place", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (w.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    w = w.withColumn("free_level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything))
    level = F.coalesce(F.col("free_level.level"), F.lit(float("inf")))
    return w.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def seats(parties: DataFrame, group: list[str], party: list[str], share: str, n_seats: str) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats of every party; ``n_seats`` (per group) go by the highest ``share`` / (2k + 1).

    Ties go to the party that sorts first.  Shares of 0 get no seat.
    """
    g = Window.partitionBy(*group)
    p = (parties.withColumn("_k", F.count(F.lit(1)).over(g)).withColumn("_t", F.sum(share).over(g)))

    def rounded(n: Column) -> Column:
        return F.when(F.col("_t") > 0, F.floor(F.col(share) * F.greatest(n, F.lit(0)) / F.col("_t") + 0.5)).otherwise(F.lit(0)).cast("long")

    p = p.withColumn("_sure", rounded(F.col(n_seats) - F.col("_k"))).withColumn("_most", rounded(F.col(n_seats) + F.col("_k")))
    p = p.withColumn("_rest", F.col(n_seats) - F.sum("_sure").over(g))
    open_seats = p.filter(F.col("_most") > F.col("_sure")).select(
        *group, *party, "_rest", F.col(share).alias("_share"), F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_seat"))
    rank = Window.partitionBy(*group).orderBy((F.col("_share") / (2 * F.col("_seat") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in party], "_seat")
    won = open_seats.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= F.col("_rest"))
    won = won.groupBy(*[F.col(c).alias("_w_" + c) for c in [*group, *party]]).agg(F.count(F.lit(1)).alias("_won"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col("_w_" + c)) for c in [*group, *party]])
    return p.join(won, on, "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, block_words: int = 16, shard_words: int = 1 << 21, max_repeat: int = 3, seed: int = 20260101, rows: bool = False) -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, taken, copies[, row]): what the mix takes of every document.

    ``taken`` counts words, repeats included; ``copies`` is how often the block of the document's first word is taken,
    an unbiased choice of whole documents for callers that cannot cut them.  ``rows`` carries the input's columns along.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(seed)).alias("mark"))
    if rows:
        d = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(seed)).alias("mark"), carried(docs))
    else:
        d = keep(d, "mix-sizes")
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = keep(targets(per_source, max_repeat), "mix-targets")

    # Shards: as many as the source needs, dealt by the seeded mark.
    s = t.select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(shard_words)).alias("n_shards"))
    d = d.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # one row per source
    d = d.withColumn("shard", F.pmod(F.shiftrightunsigned("mark", 20), F.col("n_shards")))
    sh = d.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    b = F.lit(block_words)
    sh = sh.withColumn("blocks", F.ceil(F.col("shard_size") / b))  # the last block of a shard may be shorter

    src = t.withColumn("all_blocks", F.round(F.sum("target").over(Window.partitionBy()) / b).cast("long")).withColumn("everyone", F.lit(0))
    src = seats(src, ["everyone"], ["source"], "target", "all_blocks").select(F.col("source").alias("s"), F.col("quota").alias("source_quota"))
    sh = sh.join(F.broadcast(src), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sh = seats(sh, ["source"], ["shard"], "blocks", "source_quota")
    sh = sh.select(F.col("source").alias("qs"), F.col("shard").alias("qh"), "blocks", F.least(F.col("quota"), max_repeat * F.col("blocks")).alias("quota"))
    sh = keep(sh, "mix-quotas")

    # Every document's place in its shard's stream.
    place = Window.partitionBy("source", "shard").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(place), F.lit(0)))
    d = d.join(sh, F.col("source").eqNullSafe(F.col("qs")) & (F.col("shard") == F.col("qh"))).drop("qs", "qh")
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.lit(len(PRIMES))) + 1).cast("int"))
    turn = F.pmod(F.xxhash64("shard", "source", F.lit(seed + 1)), F.lit(1 << 30))
    d = d.withColumns({"n": F.greatest(F.col("blocks"), F.lit(1)), "prime": prime.cast("long"), "turn": turn.cast("long")})
    d = d.withColumns({"lo": F.floor(F.col("start") / b), "hi": F.floor((F.col("start") + F.col("size") - 1) / b)})

    def times(block: Column) -> Column:
        at = F.pmod(F.pmod(F.col("prime"), F.col("n")) * block + F.col("turn"), F.col("n"))
        return (F.floor(F.col("quota") / F.col("n")) + F.when(at < F.pmod("quota", "n"), 1).otherwise(0)).cast("long")

    overlap = lambda k: F.least((k + 1) * b, F.col("start") + F.col("size")) - F.greatest(k * b, F.col("start"))
    taken = F.aggregate(F.sequence("lo", "hi"), F.lit(0).cast("long"), lambda acc, k: acc + times(k) * overlap(k))
    d = d.withColumns({"taken": F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"),
                       "copies": F.when(F.col("size") > 0, times(F.col("lo"))).otherwise(F.lit(0))})
    return d.select("doc_id", "source", "mark", "size", "source_size", "target", "taken", "copies", *(["row"] if rows else []))
