"""Hard negatives by score bounds along a spanning tree of the anchors.

Anchors are sorted by label and a hyperplane code and cut into blocks; each block gets a minimum spanning tree under the
Euclidean distance, computed once.  Candidate rows are cut into blocks too, and every block of anchors meets every block of
rows in a task of its own (a stated query set against all rows, in blocks).  There, the root anchor scores all rows.  For any
other anchor a with the parent p, the Cauchy-Schwarz inequality gives

    score(p, x) - |a - p| |x|  <=  score(a, x)  <=  score(p, x) + |a - p| |x|,

where score(p, x) itself may be known exactly or as an interval.  Only rows whose interval can matter are scored anew:

* *positives* (first pass): rows of the anchor's label whose upper bound reaches the n-th largest lower bound;
* *negatives* (second pass): rows of other labels whose interval overlaps the score window of one of the anchor's positives
  and whose upper bound reaches the n-th largest lower bound of the rows surely inside that window.

The best of all blocks are merged by rank.  Scores and bounds are integers, so nothing is lost by rounding.

Defined results: rows with a null id, null label or null vector, with a null, non-finite or too large (beyond ``LIMIT`` once
scaled) component, or of another length than most, take no part; equal anchor rows are one anchor; rows of the anchor's
own id are neither its positives nor its negatives; other repeated rows count each; an anchor without positives, or a positive
without negatives, gives no row; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import keep, partitions

ROW_BLOCK = 4096
ANCHOR_BLOCK = 512
LIMIT = 1 << 26
PLANES = 12


def usable(vectors: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, components as floor(scale * x)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).alias("x"))
    v = v.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    v = v.filter(F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LIMIT, F.lit(False))))  # NaN is larger than any number
    most = v.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "dim").limit(1)
    v = v.join(F.broadcast(most.select("dim")), F.size("x") == F.col("dim"), "left_semi")
    return v.select("vec_id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("vec"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vec").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def row_blocks(v: DataFrame) -> DataFrame:
    """The written (block, ids, labels, data): up to ``ROW_BLOCK`` rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROW_BLOCK):
                p = b.slice(i, ROW_BLOCK)
                yield pa.RecordBatch.from_arrays(_binary(p.column("vec_id").to_numpy(), p.column("label").to_numpy(), _matrix(p).astype(np.int32)), names=["ids", "labels", "data"])

    return keep(v.mapInArrow(cut, "ids binary, labels binary, data binary").withColumn("block", F.monotonically_increasing_id()), "candidate-blocks")


def root_up(x: np.ndarray) -> np.ndarray:
    """The smallest integers whose squares are at least ``x``."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + (r * r < x)


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge length rounded up): a minimum spanning tree by Prim's rule; parents come before children."""
    n = len(m)
    norm = (m * m).sum(axis=1)
    order, parent = np.zeros(n, np.int64), np.full(n, -1)
    near, by = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    done = np.zeros(n, bool)
    at = 0
    for k in range(n):
        order[k], done[at], parent[at] = at, True, by[at]
        d = norm + norm[at] - 2 * (m @ m[at])
        closer = ~done & (d < near)
        near[closer], by[closer] = d[closer], at
        at = int(np.where(done, np.iinfo(np.int64).max, near).argmin())
    edge = m - m[np.maximum(parent, 0)]
    return order, parent, root_up((edge * edge).sum(axis=1))


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """The written (ablock, a_ids, a_labels, a_data, tree): similar anchors share a block, and their tree comes with it."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b)
            planes = np.random.default_rng(7).standard_normal((m.shape[1], PLANES))
            code = ((m @ planes) > 0) @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vec"), pa.array(code)], names=["vec_id", "label", "vec", "code"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ANCHOR_BLOCK):
                p = b.slice(i, ANCHOR_BLOCK)
                m = _matrix(p)
                yield pa.RecordBatch.from_arrays(_binary(p.column("vec_id").to_numpy(), p.column("label").to_numpy(), m, np.stack(spanning_tree(m))), names=["a_ids", "a_labels", "a_data", "tree"])

    a = keep(anchors.distinct().mapInArrow(coded, "vec_id long, label long, vec array<int>, code long"), "anchors")
    n = max(1, -(-a.count() // ANCHOR_BLOCK))
    a = a.repartitionByRange(n, "label", "code", "vec_id").sortWithinPartitions("label", "code", "vec_id").select("vec_id", "label", "vec")
    blocks = keep(a.mapInArrow(cut, "a_ids binary, a_labels binary, a_data binary, tree binary").withColumn("id", F.monotonically_increasing_id()), "anchor-blocks")
    # Blocks are numbered 1, 2, ... so that every row block can name its partners; only their ids meet in one task.
    number = blocks.select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("ablock"))
    return keep(blocks.join(number, "id").drop("id"), "numbered-anchors")


class Rows:
    """A block of candidate rows."""

    def __init__(self, ids: bytes, labels: bytes, data: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.m = np.frombuffer(data, np.int32).reshape(len(self.ids), -1).astype(np.int64)
        self.norm = root_up((self.m * self.m).sum(axis=1))
        most = int(np.abs(self.m).max(initial=0)) * self.m.shape[1] * LIMIT
        self.fast = self.m.astype(np.float64) if most < 1 << 53 else self.m  # sums that a float holds exactly

    def score(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return (self.fast[at] @ anchor.astype(self.fast.dtype)).astype(np.int64)


class Anchors:
    """A block of anchors and their spanning tree."""

    def __init__(self, ids: bytes, labels: bytes, data: bytes, tree: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.m = np.frombuffer(data, np.int64).reshape(len(self.ids), -1)
        self.order, self.parent, self.edge = np.frombuffer(tree, np.int64).reshape(3, -1)

    def walk(self, rows: Rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, lower bounds, upper bounds) in tree order; what the caller writes into the bounds holds for the children."""
        lo, hi = {}, {}
        left = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))  # children still to come
        everything = np.arange(len(rows.ids))
        for a in self.order.tolist():
            p = int(self.parent[a])
            if p < 0:
                lo[a] = rows.score(everything, self.m[a])
                hi[a] = lo[a].copy()
            else:
                slack = self.edge[a] * rows.norm
                lo[a], hi[a] = lo[p] - slack, hi[p] + slack
                left[p] -= 1
                if not left[p]:
                    del lo[p], hi[p]
            yield a, lo[a], hi[a]
            if not left[a]:
                del lo[a], hi[a]


def rescore(rows: Rows, anchor: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
    """Makes the bounds of the rows ``at`` exact; returns how many were not."""
    at = at[lo[at] < hi[at]]
    lo[at] = hi[at] = rows.score(at, anchor)
    return len(at)


def _floor_of(values: np.ndarray, n: int) -> int:
    """The n-th largest value, or the least number if there are fewer."""
    return int(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else np.iinfo(np.int64).min


def _first(ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:n]


def positives_of(anchors: Anchors, rows: Rows, n: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """((anchor, ids, scores) of every anchor's first ``n`` rows of its label, rows scored anew)."""
    out, scored = [], 0
    for a, lo, hi in anchors.walk(rows):
        same = np.flatnonzero((rows.labels == anchors.labels[a]) & (rows.ids != anchors.ids[a]))
        at = same[hi[same] >= _floor_of(lo[same], n)]
        scored += rescore(rows, anchors.m[a], at, lo, hi)
        o = at[_first(rows.ids[at], lo[at], n)]
        out.append((a, rows.ids[o], lo[o]))
    return out, scored


def negatives_of(anchors: Anchors, rows: Rows, wanted: dict[int, list[int]], n: int, low: int, high: int) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], int]:
    """((anchor, positive score, ids, scores) of the first ``n`` rows of another label in every positive's window, rows scored anew).

    ``wanted``: the positive scores of every anchor; a score s is in the window of p if low * p <= 100 * s <= high * p.
    """
    out, scored = [], 0
    for a, lo, hi in anchors.walk(rows):
        other = np.flatnonzero((rows.labels != anchors.labels[a]) & (rows.ids != anchors.ids[a]))
        for p in wanted.get(a, ()):
            least, most = low * p, high * p
            at = other[(100 * hi[other] >= least) & (100 * lo[other] <= most)]
            sure = (100 * lo[at] >= least) & (100 * hi[at] <= most)
            at = at[hi[at] >= _floor_of(lo[at[sure]], n)]
            scored += rescore(rows, anchors.m[a], at, lo, hi)
            at = at[(100 * lo[at] >= least) & (100 * lo[at] <= most)]
            o = at[_first(rows.ids[at], lo[at], n)]
            if len(o):
                out.append((a, p, rows.ids[o], lo[o]))
    return out, scored


def mine(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    For every row whose ``vec_id`` meets ``anchors``: its first ``positives`` other rows of the same label by inner product,
    and for each of these the first ``negatives`` rows of another label whose score is ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    v = usable(vectors, label, id_col, vec_col, scale)
    rows = row_blocks(v)
    asked = anchor_blocks(v.filter(anchors))
    count = asked.count()
    each = F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long")) if count else F.array().cast("array<bigint>")
    paired = rows.select("ids", "labels", "data", F.explode(each).alias("ablock"))
    meet = lambda a: paired.join(a, "ablock").repartition(partitions(spark))

    def load(b: pa.RecordBatch, r: int) -> tuple[Anchors, Rows]:
        of = lambda *names: (b.column(n)[r].as_py() for n in names)
        return Anchors(*of("a_ids", "a_labels", "a_data", "tree")), Rows(*of("ids", "labels", "data"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                a, x = load(b, r)
                found, _ = positives_of(a, x, positives)
                size = [len(i) for _, i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("ablock")[r].as_py()] * sum(size), pa.int64()), pa.array(np.repeat([k for k, _, _ in found], size), pa.int32()),
                     pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], names=["ablock", "a", "positive_id", "positive_score"])

    best = Window.partitionBy("ablock", "a").orderBy(F.col("positive_score").desc(), "positive_id")
    pos = meet(asked).mapInArrow(near, "ablock long, a int, positive_id long, positive_score long").withColumn("positive_rank", F.row_number().over(best))
    pos = keep(pos.filter(F.col("positive_rank") <= positives), "positives")
    # At most ``positives`` scores for each anchor of a block.
    windows = pos.groupBy("ablock").agg(F.collect_set(F.struct("a", "positive_score")).alias("wanted")).select("ablock", F.col("wanted.a").alias("w_a"), F.col("wanted.positive_score").alias("w_s"))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                a, x = load(b, r)
                wanted: dict[int, list[int]] = {}
                for k, s in zip(b.column("w_a")[r].as_py(), b.column("w_s")[r].as_py(), strict=True):
                    wanted.setdefault(k, []).append(s)
                found, _ = negatives_of(a, x, wanted, negatives, low, high)
                size = [len(i) for _, _, i, _ in found]
                if sum(size):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column("ablock")[r].as_py()] * sum(size), pa.int64()), pa.array(np.repeat([k for k, *_ in found], size), pa.int32()), pa.array(np.repeat([p for _, p, _, _ in found], size), pa.int64()),
                         pa.array(np.concatenate([i for *_, i, _ in found])), pa.array(np.concatenate([s for *_, s in found]))], names=["ablock", "a", "positive_score", "negative_id", "negative_score"])

    first = Window.partitionBy("ablock", "a", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    neg = meet(asked.join(windows, "ablock")).mapInArrow(hard, "ablock long, a int, positive_score long, negative_id long, negative_score long")
    neg = neg.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)

    def anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column("a_ids")[r].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("ablock")[r].as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)], names=["ablock", "a", "anchor_id"])

    ids = asked.select("ablock", "a_ids").mapInArrow(anchor_ids, "ablock long, a int, anchor_id long")
    return pos.join(neg, ["ablock", "a", "positive_score"]).join(ids, ["ablock", "a"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
