"""Exact top-k by Fagin's threshold algorithm over sorted per-dimension lists of integer vectors.

Rows and queries are cut into blocks; every block of queries meets every block of rows in a task of its own (a stated query
set against all rows, in blocks).  A task sorts its rows once per dimension.  For a query it reads the lists in step, from
the end that the query's sign prefers: rows met for the first time are scored in full, and the threshold is the score of an
imagined row that holds the last value read of every list.  No unseen row can pass the threshold, so the query stops when
its k-th best score is above it (at equality it goes on, as an unseen tie may have a smaller id).  The best k of all blocks
are merged per query.

Components become floor(scale * x) in double precision; scores are exact integers.  Defined results: vectors that are null
or hold a null or non-finite component, or are of another length than most, take no part (zero vectors do); a query gets
all candidates if there are fewer than k; rows of a query's own id are not its candidates; repeated ids are separate
candidates of the others; equal query rows are one query, rows of one id with different vectors are queries of their own,
each with its own ranks; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import keep, partitions

ROW_BLOCK = 4096
QUERY_BLOCK = 512
FIRST = 16  # list entries read before the first check of the threshold; every step after it reads as many as all before


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, vec) with integer components."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    v = v.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    most = v.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "dim").limit(1)
    v = v.join(F.broadcast(most.select("dim")), F.size("x") == F.col("dim"), "left_semi")
    return v.select("vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("vec"))


def blocks(v: DataFrame, size: int, name: str) -> DataFrame:
    """(block, ids, data): runs of up to ``size`` vectors, little-endian 64-bit."""
    schema = pa.schema([("ids", pa.binary()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                ids.append(part.column("vec_id").to_numpy())
                rows.append(part.column("vec").flatten().to_numpy().reshape(part.num_rows, -1))
                held += part.num_rows
                while held >= size:
                    i_, r_ = np.concatenate(ids), np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([i_[:size].tobytes()], pa.binary()), pa.array([r_[:size].tobytes()], pa.binary())], schema=schema)
                    ids, rows, held = [i_[size:]], [r_[size:]], held - size
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(rows).tobytes()], pa.binary())], schema=schema)

    return keep(v.mapInArrow(cut, "ids binary, data binary").withColumn("block", F.monotonically_increasing_id()), name)


def search(ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(ids, scores, entries read of each list, rows scored) of the query's k best rows of a block; ``lists`` holds each dimension's rows in ascending order."""
    n = len(ids)
    q = query.astype(rows.dtype)
    used = np.flatnonzero(query)
    up = (query[used] > 0)[:, None]
    seen = np.zeros(n, bool)
    score = np.empty(n, rows.dtype)
    got = np.zeros(0, np.int64)
    depth = 0
    while depth < n:
        m = min(max(depth, FIRST), n - depth)
        ahead = np.where(up, lists[used, n - depth - m : n - depth][:, ::-1], lists[used, depth : depth + m])  # best end first
        new = np.zeros(n, bool)
        new[ahead.ravel() if len(used) else slice(None)] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        depth += m
        score[new] = rows[new] @ q
        got = np.concatenate([got, new[ids[new] != own]])
        if len(got) > k:
            kth = np.partition(score[got], len(got) - k)[len(got) - k]
            got = got[score[got] >= kth]
        if seen.all():
            break
        if len(got) >= k and (rows[ahead[:, -1], used] * q[used]).sum() < score[got].min():
            break
    o = np.lexsort((ids[got], -score[got]))[:k]
    return ids[got][o], score[got][o], depth, int(seen.sum())


def best(ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of ``search``."""
    return search(ids, rows, lists, own, query, k)[:2]


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every row whose ``vec_id`` meets ``queries``."""
    v = integers(vectors, id_col, vec_col, scale)
    rows = blocks(v, ROW_BLOCK, "threshold-rows")
    wanted = v.filter(queries).distinct()
    asked = blocks(wanted.repartition(max(1, -(-wanted.count() // QUERY_BLOCK))), QUERY_BLOCK, "threshold-queries")
    # Query blocks are numbered 1, 2, ... so that every row block can name its partners; only their ids meet in one task.
    number = asked.select("block", F.row_number().over(Window.orderBy("block")).alias("q"))
    n = number.count()
    asked = asked.join(number, "block").select("q", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    schema = pa.schema([("q", pa.int32()), ("i", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[r].as_py(), np.int64)
                m = np.frombuffer(b.column("data")[r].as_py(), np.int64).reshape(len(ids), -1)
                qid = np.frombuffer(b.column("q_ids")[r].as_py(), np.int64)
                q = np.frombuffer(b.column("q_data")[r].as_py(), np.int64).reshape(len(qid), -1)
                # Sums that a float holds exactly go through the faster product.
                most = float(np.abs(m).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, m.shape[1])
                lists = np.argsort(m, axis=0, kind="stable").T.astype(np.int32)
                m = m.astype(np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64)
                out = [best(ids, m, lists, own, query, k) for own, query in zip(qid.tolist(), q, strict=True)]
                size = [len(x) for x, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(size), b.column("q")[r].as_py(), np.int32)), pa.array(np.repeat(np.arange(len(qid), dtype=np.int32), size)), pa.array(np.repeat(qid, size)),
                                                  pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([s for _, s in out]).astype(np.int64))], schema=schema)

    each = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    met = rows.select("ids", "data", F.explode(each).alias("q")).join(asked, "q").repartition(partitions(vectors.sparkSession))
    found = met.select("ids", "data", "q", "q_ids", "q_data").mapInArrow(run, "q int, i int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q", "i").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
