"""Dimension-sharded Lloyd clustering of integer vectors, exact and repeatable.

Vectors are cut into row blocks and every row block into ``shards`` column blocks, which stay where they are for all rounds.
A round is two small exchanges:

1. a column-block task computes the exact partial squared distances of its rows to its *slice* of the centroids;
   ``reduceByKey`` adds the partial matrices of a row block and takes the argmin (ties: smaller number);
2. the labels go back to the row block's column blocks, each shard adds up its own columns, and ``reduceByKey`` by shard
   gives the shard's new slice, floor(sum / count) in integers; empty clusters keep theirs.

The driver only holds the centroids (k x dim numbers).  Column blocks come from a written table, so a lost one is read
again.  Work is dealt by block, not by value: a vector that holds a third of all rows changes nothing.

Defined results: vectors that are null, of another length than ``dim``, or hold a null, non-finite or too large (beyond
``LIMIT`` once scaled, so that distances fit 64 bits) component take no part; a null vec_id counts as empty text in the seeded
order; repeated rows are vectors of their own; equal hashes are ordered by the vector; with fewer than ``k`` vectors each is
a centroid; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import keep, partitions

ROWS = 1024  # rows of a block
LIMIT = 1 << 27


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, dim: int) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, components as floor(scale * x)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x")).filter(F.size("x") == dim)
    v = v.filter(F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double")) * scale < LIMIT, F.lit(False))))  # NaN is larger than any number
    return v.select("vec_id", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("vec"))


def row_blocks(v: DataFrame) -> DataFrame:
    """The written (block, ids, data): up to ``ROWS`` vectors of one Arrow batch, as 32-bit rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                data = part.column("vec").flatten().to_numpy().astype(np.int32).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([data], pa.binary())], names=["ids", "data"])

    return keep(v.mapInArrow(cut, "ids array<long>, data binary").withColumn("block", F.monotonically_increasing_id()), "row-blocks")


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over these columns, one row per vector, one column per centroid."""
    d = x.astype(np.int64)[:, None, :] - centroids[None, :, :]
    return (d * d).sum(axis=2)


def _sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the columns per cluster, vectors per cluster)."""
    total = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(total, label, x.astype(np.int64))
    return total, np.bincount(label, minlength=k)


def first_centroids(v: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["vec"] for r in v.orderBy(key, "vec").limit(k).collect()], np.int64)


class Sharded:
    """The column blocks of all vectors and the steps of a round over them."""

    def __init__(self, blocks: DataFrame, dim: int, shards: int):
        self.cuts = np.array_split(np.arange(dim), shards)
        self.parts = partitions(blocks.sparkSession)
        cuts = self.cuts

        def columns(r) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
            x = np.frombuffer(r["data"], np.int32).reshape(-1, dim)
            for s, c in enumerate(cuts):
                yield (r["block"], s), np.ascontiguousarray(x[:, c])

        self.columns: RDD = blocks.select("block", "data").rdd.flatMap(columns).partitionBy(self.parts).persist(StorageLevel.DISK_ONLY)

    def assign(self, centroids: np.ndarray) -> RDD:
        """(block, (cluster, squared distance)) of the nearest centroids."""
        slices = [centroids[:, c] for c in self.cuts]

        def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            label = d.argmin(axis=1)
            return label.astype(np.int32), d[np.arange(len(d)), label]

        return self.columns.map(lambda kv: (kv[0][0], partial_distances(kv[1], slices[kv[0][1]]))).reduceByKey(np.add, self.parts).mapValues(nearest)

    def update(self, labels: RDD, centroids: np.ndarray) -> np.ndarray:
        """The centroids of the labelled vectors; every shard makes its own slice."""
        k, slices = len(centroids), [centroids[:, c] for c in self.cuts]
        sent = labels.flatMap(lambda kv: [((kv[0], s), kv[1][0]) for s in range(len(slices))]).partitionBy(self.parts)
        sums = self.columns.join(sent, self.parts).map(lambda kv: (kv[0][1], _sums(*kv[1], k))).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), len(slices))
        made = sums.map(lambda kv: (kv[0], np.where(kv[1][1][:, None] > 0, kv[1][0] // np.maximum(kv[1][1], 1)[:, None], slices[kv[0]]))).collectAsMap()
        out = centroids.copy()
        for s, c in enumerate(self.cuts):
            out[:, c] = made[s]
        return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = 64, shards: int = 4,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((vec_id, cluster, distance), (cluster, size, inertia, centroid)) after ``rounds`` rounds and a last assignment."""
    spark = vectors.sparkSession
    v = integers(vectors, id_col, vec_col, scale, dim)
    blocks = row_blocks(v)
    centroids = first_centroids(v, k, seed)
    sharded = Sharded(blocks, dim, shards)
    for _ in range(rounds if len(centroids) else 0):
        centroids = sharded.update(sharded.assign(centroids), centroids)
    made = sharded.assign(centroids) if len(centroids) else spark.sparkContext.emptyRDD()
    last = spark.createDataFrame(made.map(lambda kv: (kv[0], kv[1][0].tobytes(), kv[1][1].tobytes())), "block long, labels binary, distances binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, d in zip(*(b.column(c) for c in ("ids", "labels", "distances")), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(labels.as_py(), np.int32)), pa.array(np.frombuffer(d.as_py(), np.int64))], names=["vec_id", "cluster", "distance"])

    assigned = keep(last.join(blocks.select("block", "ids"), "block").select("ids", "labels", "distances").mapInArrow(rows, "vec_id long, cluster int, distance long"), "clusters")
    sharded.columns.unpersist()
    rows_of = [(i, [int(x) for x in c], hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(rows_of, "cluster int, centroid array<long>, centroid_sha256 string")
    total = F.coalesce(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(0)).cast("long")
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), total.alias("inertia"))
    return assigned, named.join(sizes, "cluster", "left").na.fill(0, ["size", "inertia"])
