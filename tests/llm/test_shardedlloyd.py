import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import shardedlloyd

DDL = "vec_id long, embedding array<float>, label int, cluster int, block long, distance string"


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in data], DDL)


def kept(data, dim, scale):
    ok = [(i, v) for i, v in data if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) * scale < shardedlloyd.LIMIT for c in v)]
    return [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in ok]


def brute(data, k, rounds, seed, dim, scale):
    """Plain Lloyd on Python integers: sorted (vec_id, cluster, distance), and the centroids."""
    rows = kept(data, dim, scale)
    cents = [v for _, v in sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in rows]
        for n in range(len(cents)):
            mine = [v for (_, v), c in zip(rows, of, strict=True) if c == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, *reversed(nearest(v))) for i, v in rows), key=str), cents


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dim)) + 3 * rng.integers(-1, 2, (n, 1))).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows is one vector
    nan, inf = float("nan"), float("inf")
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return data + [(7, data[7][1]), (7, data[8][1]), (None, data[9][1]), (900, None), (901, []), (902, [1.0]), (903, [nan] * dim), (904, [inf] * dim), (905, [None] * dim), (906, [1e30] * dim), (907, [0.0] * dim)]


def check(spark, data, k, rounds, dim, shards, scale=16):
    assigned, clusters = shardedlloyd.cluster(frame(spark, data), k=k, rounds=rounds, seed=3, scale=scale, dim=dim, shards=shards)
    want, cents = brute(data, k, rounds, 3, dim, scale)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=str)
    assert got == want
    c = {r["cluster"]: r for r in clusters.collect()}
    assert [c[n]["centroid"] for n in range(len(cents))] == cents and len(c) == len(cents)
    for n, r in c.items():
        assert r["size"] == sum(w[1] == n for w in want) and r["inertia"] == sum(w[2] for w in want if w[1] == n)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()


def test_against_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(shardedlloyd, "ROWS", 16)
    check(spark, vectors(200, 6, 1), k=5, rounds=4, dim=6, shards=4)


def test_shards_change_nothing(spark):
    check(spark, vectors(60, 5, 2), k=3, rounds=3, dim=5, shards=1)
    check(spark, vectors(60, 5, 2), k=3, rounds=3, dim=5, shards=5)


def test_empty_clusters_keep_their_centroid(spark):
    data = [(i, [1.0, -1.5]) for i in range(9)] + [(9, [5.0, 5.0])]
    check(spark, data, k=4, rounds=3, dim=2, shards=2)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(1, [0.1, -0.1]), (2, [3.0, 4.0])], k=8, rounds=2, dim=2, shards=2)
    assigned, clusters = shardedlloyd.cluster(frame(spark, []), dim=2, shards=2)
    assert assigned.count() == 0 and clusters.count() == 0


def test_partial_distances_add_up():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-(1 << 26), 1 << 26, (20, 9)).astype(np.int32), rng.integers(-(1 << 26), 1 << 26, (4, 9))
    parts = sum(shardedlloyd.partial_distances(x[:, s], c[:, s]) for s in np.array_split(np.arange(9), 4))
    assert parts.tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]


def test_extra_columns_are_ignored(spark):
    out = shardedlloyd.cluster(frame(spark, vectors(20, 3, 5)).withColumn("centroid", F.lit(1)), k=2, rounds=1, dim=3, shards=3)[0]
    assert out.columns == ["vec_id", "cluster", "distance"]
