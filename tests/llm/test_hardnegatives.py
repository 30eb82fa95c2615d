import math

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import hardnegatives

DDL = "vec_id long, embedding array<float>, label int, rank int, a int, positive_id string"


def frame(spark, data):
    return spark.createDataFrame([(i, v, c, 1, 2, "x") for i, v, c in data], DDL)


def brute(data, every, scale, n, low=80, high=100):
    ok = [(i, [math.floor(scale * float(np.float32(c))) for c in v], c0) for i, v, c0 in data
          if i is not None and v is not None and c0 is not None and len(v) == len(data[0][1]) and all(c is not None and math.isfinite(c) and abs(c) * scale < hardnegatives.LIMIT for c in v)]
    out = []
    for i, v, c in {(i, tuple(v), c) for i, v, c in ok if i % every == 0}:
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, w, d in ok if j != i]
        for p, j, _ in sorted(x for x in score if x[2] == c)[:n]:
            window = sorted((s, k) for s, k, d in score if d != c and low * -p <= 100 * -s <= high * -p)[:n]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(window)]
    return sorted(out)


def vectors(n=400, dim=6, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((4, dim))
    label = rng.integers(0, 4, n)
    x = (centers[rng.integers(0, 4, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)
    x[100:230] = x[5]  # a third of all rows is one vector
    nan, inf, one = float("nan"), float("inf"), [1.0] * dim
    data = [(i, [float(c) for c in v], int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    data += [(20, data[21][1], 1), (20, data[20][1], data[20][2]), (33, data[33][1], data[33][2]), (500, one, None), (None, one, 1), (520, None, 1), (540, [nan] * dim, 1),
             (560, [inf] * dim, 1), (580, [None] * dim, 1), (600, [1.0], 1), (620, [0.0] * dim, 1), (640, [1e30] * dim, 1)]
    return data


def run(spark, data, every=10, n=5, scale=16):
    out = hardnegatives.mine(frame(spark, data), F.col("vec_id") % every == 0, F.col("label"), scale=scale, positives=n, negatives=n).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "ROW_BLOCK", 64)
    monkeypatch.setattr(hardnegatives, "ANCHOR_BLOCK", 7)
    data = vectors()
    want = brute(data, 10, 16, 5)
    assert run(spark, data) == want and len(want) > 100


def test_one_block_and_few_rows(spark):
    data = vectors(60)
    assert run(spark, data, every=5, n=3) == brute(data, 5, 16, 3)
    assert run(spark, [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1)]) == []
    assert run(spark, [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.8], 2), (3, [-1.0, -1.0], 3)]) == [(0, 1, 1, 2, 512, 448)]
    assert run(spark, []) == []


def test_zero_and_negative_scores(spark):
    data = [(0, [0.0, 0.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (10, [1.0, 0.0], 3), (11, [-1.0, 0.0], 3), (12, [-1.0, 0.0], 4)]
    assert run(spark, data) == brute(data, 10, 16, 5)


def test_tree_is_minimal_and_ordered():
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 50, (40, 5)).astype(np.int64)
    m[7] = m[8]
    order, parent, edge = hardnegatives.spanning_tree(m)
    place = np.argsort(order)
    assert sorted(order) == list(range(40)) and parent[order[0]] == -1 and all(place[parent[a]] < place[a] for a in order[1:])
    d2 = ((m[:, None] - m[None]) ** 2).sum(axis=2)
    assert all(edge[a] ** 2 >= d2[a, parent[a]] > (edge[a] - 1) ** 2 for a in order[1:] if edge[a])
    # Kruskal's rule gives the same total.
    root, total = list(range(40)), 0
    find = lambda x: x if root[x] == x else find(root[x])
    for w, a, b in sorted((int(d2[a, b]), a, b) for a in range(40) for b in range(a)):
        if find(a) != find(b):
            root[find(a)], total = find(b), total + w
    assert total == sum(int(d2[a, parent[a]]) for a in order[1:])


def blocks(data, ids, label, scale=256):
    m = np.floor(data * scale).astype(np.int64)
    return hardnegatives.Rows(ids.tobytes(), label.tobytes(), m.astype(np.int32).tobytes()), m


def test_bounds_hold_and_spare_rows():
    """Near anchors: children rescore a small part of the rows, and every bound holds."""
    rng = np.random.default_rng(2)
    n, dim, k = 3000, 16, 20
    x = rng.standard_normal((n, dim))
    ids, label = np.arange(n), rng.integers(0, 5, n)
    rows, _ = blocks(x, ids, label)
    near = np.floor((x[0] + 0.002 * rng.standard_normal((k, dim))) * 256).astype(np.int64)
    a = hardnegatives.Anchors(np.arange(10_000, 10_000 + k).tobytes(), np.zeros(k, np.int64).tobytes(), near.tobytes(), np.stack(hardnegatives.spanning_tree(near)).tobytes())
    for i, lo, hi in a.walk(rows):
        exact = rows.m @ near[i]
        assert (lo <= exact).all() and (exact <= hi).all()
    found, scored = hardnegatives.positives_of(a, rows, 5)
    assert scored < 0.1 * k * n
    for i, got, score in found:
        want = sorted((-int(s), int(j)) for s, j, c in zip(rows.m @ near[i], ids, label, strict=True) if c == 0)[:5]
        assert [(-int(s), int(j)) for j, s in zip(got, score, strict=True)] == want
    wanted = {i: score.tolist() for i, _, score in found}
    hard, scored = hardnegatives.negatives_of(a, rows, wanted, 5, 80, 100)
    assert hard and scored < 0.3 * k * n


def test_root_up():
    x = np.array([0, 1, 2, 3, 4, 5, 8, 9, 10, (1 << 26) ** 2, (1 << 26) ** 2 + 1, (1 << 26) ** 2 - 1], np.int64)
    assert hardnegatives.root_up(x).tolist() == [0, 1, 2, 2, 2, 3, 3, 3, 4, 1 << 26, (1 << 26) + 1, 1 << 26]
