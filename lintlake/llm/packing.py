"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents longer than the capacity are cut into pieces of exactly the capacity, the first piece holding the rest.  Full
pieces, and pieces over half the capacity (no two of which share a sequence), open a sequence each; that leaves gaps.
All other pieces are placed from large to small, in bands of lengths (h/2, h], by rounds over two distributed tables,
pieces and gaps:

1. *Sort.*  Both tables are sorted by size within partitions; the counts per size class turn a row's place in its partition
   into its place in the global descending order, gaps before pieces of the same size.
2. *Successor sweep.*  Going down that order, a gap adds one to the balance and a piece takes one.  A piece belongs to the
   nearest gap above it at its balance level: the smallest gap that it fits and that no larger piece has taken.
3. *Conflicts.*  Pieces that want the same gap have different levels by their rank, so each gap slot gets one piece at most.
   A gap of g >= h offers g // h slots in one round.
4. *Update.*  Gaps shrink by what they got; pieces without a gap go to the next round.  The size classes tell before a round
   how many pieces it will leave over.  When hardly any match, the fewest sequences that could hold the rest are opened
   empty; when fewer than ``settle`` of the sequences' number are left over, enough for all of them.

Pieces of at most 1/32 of the capacity are first joined with pieces of the same length into items of up to 1/16.

No table is ever held by one task: the sweeps work on levels (at most one row per size class and table each) and the class
tables hold at most two rows per possible size and partition.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they occur; null ids
are kept; an empty table gives an empty result; extra columns of the input are ignored here.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import keep
from lintlake.llm.encoding import encoder
from lintlake.session import ensure_checkpoint_dir

END_ID = 2


def pieces(docs: DataFrame, tokenizer: str, keeps_space: bool = True, capacity: int = 1024, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids_crc32[, ids]): every document's ids in pieces of at most ``capacity``."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        for b in batches:
            doc = b.column("doc_id")
            for i, j, ids, off in enc.batches(b.column("text"), end_id):
                n = np.diff(off)
                k = -(-n // capacity)  # pieces per document, at least the end id's
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                head = n - (k - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (off[row] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[a : a + m]) for a, m in zip(at.tolist(), (length * 4).tolist(), strict=True)), np.int64, len(row))
                cols = [doc.slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    ends = np.append(off[row] + start, off[-1]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, ddl)
    return keep(out.withColumn("pid", F.monotonically_increasing_id()), "pieces")


def bundles(small: DataFrame, unit: int) -> DataFrame:
    """(pid, iid, ahead, size): pieces of at most unit / 2 joined, within a batch, into items of equal lengths up to ``unit``."""
    schema = pa.schema([("pid", pa.int64()), ("iid", pa.int64()), ("ahead", pa.int64()), ("size", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, n = b.column("pid").to_numpy(), b.column("length").to_numpy()
            order = np.argsort(n, kind="stable")
            pid, n = pid[order], n[order]
            new = np.append(True, n[1:] != n[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
            slot = (np.arange(len(n)) - first) % (unit // n)
            lead = np.arange(len(n)) - slot
            size = np.bincount(lead, weights=n, minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(pid[lead]), pa.array(slot * n), pa.array(size[lead])], schema=schema)

    return small.select("pid", "length").mapInArrow(join, "pid long, iid long, ahead long, size long")


def _sweep(items: DataFrame, slots: DataFrame) -> DataFrame:
    """(iid, size, sid): items matched one to one with the smallest slots that hold them, larger items choosing first."""
    both = slots.select(F.lit(0).alias("kind"), F.col("slot").alias("size"), F.col("sid").alias("id")).unionByName(
        items.select(F.lit(1).alias("kind"), "size", F.col("iid").alias("id")))
    both = both.sortWithinPartitions(F.col("size").desc(), "kind").withColumn("mid", F.monotonically_increasing_id())
    both = keep(both.withColumn("part", F.shiftrightunsigned("mid", 33)), "pack-order")
    parts = both.groupBy("size", "kind", "part").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    classes = both.groupBy("size", "kind").agg(F.count(F.lit(1)).alias("n"))
    signed = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    down = Window.orderBy(F.col("size").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)  # one row per size class
    classes = classes.select("size", "kind", F.coalesce(F.sum(signed).over(down), F.lit(0)).alias("balance"))
    within = Window.partitionBy("size", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0)))
    parts = parts.join(classes, ["size", "kind"]).select("size", "kind", "part", "first", "earlier", "balance")
    rank = F.col("mid") - F.col("first") + F.col("earlier")
    level = F.when(F.col("kind") == 0, F.col("balance") + rank + 1).otherwise(F.col("balance") - rank)
    rows = both.join(parts, ["size", "kind", "part"]).select("kind", "size", "id", level.alias("level"))
    at = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
    rows = rows.withColumn("above", F.lag(F.struct("kind", "id")).over(at))
    return rows.filter("kind = 1 AND above.kind = 0").select(F.col("id").alias("iid"), "size", F.col("above.id").alias("sid"))


def _offers(gap: int, top: int) -> int:
    return max(1, gap // top)


def _unmatched(sizes: dict[int, int], gaps: dict[int, int], top: int) -> int:
    """Pieces that a sweep over these size classes would leave without a gap."""
    least, free, left = min(sizes), 0, 0
    slots: dict[int, int] = {}
    for g, n in gaps.items():
        if g >= least:
            slots[min(g, top)] = slots.get(min(g, top), 0) + n * _offers(g, top)
    for size in sorted({*sizes, *slots}, reverse=True):
        free += slots.get(size, 0)
        got = min(free, sizes.get(size, 0))
        free, left = free - got, left + sizes.get(size, 0) - got
    return left


def place(pieces_: DataFrame, capacity: int = 1024, settle: float = 0.01) -> DataFrame:
    """(pid, sequence_id, offset) for (pid, length) rows with unique pids and 0 < length <= capacity."""
    spark = pieces_.sparkSession
    p = pieces_.select("pid", "length")
    big = p.filter(F.col("length") > capacity // 2)
    unit = max(1, capacity // 16)
    small = p.filter(F.col("length") <= capacity // 2)
    members = keep(bundles(small.filter(F.col("length") <= unit // 2), unit).unionByName(
        small.filter(F.col("length") > unit // 2).select("pid", F.col("pid").alias("iid"), F.lit(0).cast("long").alias("ahead"), F.col("length").alias("size"))), "pack-items")
    # The state of the rounds: gaps (kind 0) and items without a place (kind 1), one table.
    state = big.filter(F.col("length") < capacity).select(F.lit(0).alias("kind"), F.col("pid").alias("id"), (capacity - F.col("length")).alias("size")).unionByName(
        members.filter("pid = iid").select(F.lit(1).alias("kind"), F.col("iid").alias("id"), "size"))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pack-places-{uuid.uuid4().hex}"
    spark.createDataFrame([], "iid long, sequence_id long, at long").write.parquet(folder)
    opened = big.count()
    fresh = 0
    top = capacity // 2
    while top >= 1:
        low = top // 2 if top > unit else 0
        while True:
            classes = state.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most two rows per possible size
            sizes = {r["size"]: r["n"] for r in classes if r["kind"] == 1 and low < r["size"] <= top}
            gaps = {r["size"]: r["n"] for r in classes if r["kind"] == 0}
            n = sum(sizes.values())
            if not n:
                break
            rest = _unmatched(sizes, gaps, top)
            # Too few left over to matter: enough new sequences for all of them.  Hardly any match: the fewest that hold the rest.
            m = -(-rest // (capacity // top)) if rest <= max(1, settle * opened) else 0 if rest < 0.9 * n else -(-sum(k * v for k, v in sizes.items()) // capacity)
            if m:
                new = spark.range(fresh, fresh + m).select(F.lit(0).alias("kind"), (-F.col("id") - 1).alias("id"), F.lit(capacity).cast("long").alias("size"))
                fresh, opened = fresh + m, opened + m
                state = state.unionByName(new)
            left = state.filter((F.col("kind") == 1) & (F.col("size") > low) & (F.col("size") <= top)).select(F.col("id").alias("iid"), "size")
            open_ = state.filter("kind = 0").select(F.col("id").alias("sid"), F.col("size").alias("gap"))
            each = F.greatest(F.floor(F.col("gap") / top), F.lit(1))
            slots = open_.filter(F.col("gap") >= min(sizes)).select("sid", F.least(F.col("gap"), F.lit(top)).alias("slot"), F.explode(F.sequence(F.lit(1), each))).drop("col")
            match = keep(_sweep(left, slots), "pack-match")
            before = Window.partitionBy("sid").orderBy("iid").rowsBetween(Window.unboundedPreceding, -1)
            at = capacity - F.col("gap") + F.coalesce(F.sum("size").over(before), F.lit(0))
            match.join(open_, "sid").select("iid", F.col("sid").alias("sequence_id"), at.alias("at")).write.mode("append").parquet(folder)
            used = match.groupBy(F.lit(0).alias("kind"), F.col("sid").alias("id")).agg(F.sum("size").alias("used")).unionByName(
                match.select(F.lit(1).alias("kind"), F.col("iid").alias("id"), F.col("size").alias("used")))
            state = state.join(used, ["kind", "id"], "left").select("kind", "id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")).filter("size > 0")
            state = keep(state, "pack-state")
        top = low
    where = spark.read.parquet(folder)
    rest_ = members.join(where, "iid").select("pid", "sequence_id", (F.col("at") + F.col("ahead")).alias("offset"))
    return big.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(rest_)


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = True, capacity: int = 1024, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    p = pieces(docs, tokenizer, keeps_space, capacity, end_id, with_ids)
    return p.join(place(p, capacity), "pid").drop("pid")
