import math
import random

import numpy as np

from lintlake.llm import nndescent, threshold

DDL = "vec_id long, embedding array<float>, label int, nid long, score double, rank int"


def vectors(n=400, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[50:90] = x[0]  # a hot vector
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    data += [(1000, None), (1020, [0.0] * dim), (1040, [nan] + [1.0] * (dim - 1)), (1060, [inf] * dim), (1080, [None] + [1.0] * (dim - 1)), (1100, [1.0, 2.0]), (None, [1.0] * dim), (20, data[20][1])]
    return data


def table(spark, data):
    return spark.createDataFrame([(i, v, 0, 1, 0.5, 9) for i, v in data], DDL)


def good(data, zero):
    dim = len(data[0][1])
    ok = [(i, v) for i, v in data if i is not None and v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, v) for i, v in ok if zero or any(v)]


def test_nn_descent_recall_ties_and_scores(spark):
    data = vectors()
    out = nndescent.neighbours(table(spark, data), nndescent.F.col("vec_id") % 20 == 0, top=10, k=12, leaf=64, trees=4, ef=24).collect()
    rows = {i: np.array(v, dtype=np.float64) for i, v in good(data, zero=False)}
    found = {}
    for r in out:
        assert abs(r["score"] - rows[r["query_id"]] @ rows[r["vec_id"]]) < 1e-9 and r["query_id"] != r["vec_id"]
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    hit = 0
    for q, f in found.items():
        f.sort()
        assert [x[0] for x in f] == list(range(1, 11)) and [x[1:] for x in f] == sorted(x[1:] for x in f)
        best = sorted((-float(rows[q] @ v), i) for i, v in rows.items() if i != q)[:10]
        hit += len({i for _, i in best} & {x[2] for x in f})
    assert set(found) == {i for i in rows if i % 20 == 0}
    assert hit >= 0.9 * 10 * len(found)


def test_nn_descent_few_and_none(spark):
    few = [(i, [float(i + 1), 1.0]) for i in range(5)]
    out = nndescent.neighbours(table(spark, few), nndescent.F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 4), (0, 3), (0, 2), (0, 1)]
    assert nndescent.neighbours(table(spark, []), nndescent.F.col("vec_id") % 20 == 0).count() == 0
    assert nndescent.neighbours(table(spark, [(0, [1.0, 2.0])]), nndescent.F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(threshold, "ROW_BLOCK", 64)
    monkeypatch.setattr(threshold, "QUERY_BLOCK", 8)
    data = vectors()
    out = threshold.top_k(table(spark, data), threshold.F.col("vec_id") % 20 == 0, k=15).collect()
    ints = [(i, [math.floor(64 * c) for c in v]) for i, v in good(data, zero=True)]
    want = []
    for q, w in {(i, tuple(v)) for i, v in ints}:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in ints if i != q)[:15]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)
    assert len({r["vec_id"] for r in out if r["query_id"] == 20}) == 15  # the repeated row is one query, with all its candidates


def test_one_id_with_two_vectors_is_two_queries(spark):
    """Each of them has its own ranks and as many candidates as any other query."""
    rng = np.random.default_rng(8)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 6)).astype(np.float32))] + [(20, [1.0, -1.0, 0.5, 0.0, 0.25, 2.0])]
    out = threshold.top_k(table(spark, data), threshold.F.col("vec_id") % 20 == 0, k=20).collect()
    ints = [(i, [math.floor(64 * c) for c in v]) for i, v in data]
    want = [(q, k + 1, i, -s) for q, w in ints if q % 20 == 0 for k, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in ints if i != q)[:20])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)
    near = nndescent.neighbours(table(spark, data), nndescent.F.col("vec_id") % 20 == 0, top=20, k=30, ef=48).collect()
    assert sorted(r["rank"] for r in near if r["query_id"] == 20) == sorted([*range(1, 21)] * 2)
    exact = [(q, k + 1, i) for q, w in data if q % 20 == 0 for k, (s, i) in enumerate(sorted((-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(w, v, strict=True)), i) for i, v in data if i != q)[:20])]
    assert len(set(exact) & {(r["query_id"], r["rank"], r["vec_id"]) for r in near}) >= 0.9 * len(exact)


def test_threshold_stops_early(spark):
    """One dominant dimension: the threshold falls below the k-th score long before the lists end."""
    n = 4000
    rows = np.zeros((n, 3), np.float64)
    rows[:, 0] = np.arange(n)
    lists = np.argsort(rows, axis=0, kind="stable").T
    ids, scores = threshold.best(np.arange(n), rows, lists, -1, np.array([5, 0, 0]), 3)
    assert list(ids) == [n - 1, n - 2, n - 3] and list(scores) == [5 * (n - 1), 5 * (n - 2), 5 * (n - 3)]


def test_threshold_reads_little_where_it_can():
    """The search stops after its first entries, and scores only the rows met there."""
    n, d = 4000, 3
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 50, (n, d))
    rows[:40] += 1000
    lists = np.argsort(rows, axis=0, kind="stable").T
    q = np.array([3, 2, 1])
    ids, scores, depth, scored = threshold.search(np.arange(n), rows, lists, -1, q, 10)
    assert list(zip(-scores, ids, strict=True)) == sorted(zip(-(rows @ q), range(n), strict=True))[:10]
    assert depth <= 64 and scored <= d * depth and scored < 200


def test_threshold_random_ties():
    rnd = random.Random(4)
    for _ in range(30):
        n, d = rnd.randint(1, 120), rnd.randint(1, 5)
        rows = np.array([[rnd.randint(-2, 2) for _ in range(d)] for _ in range(n)], dtype=np.int64)
        q = np.array([rnd.randint(-2, 2) for _ in range(d)])
        ids = np.array(rnd.sample(range(1000), n))
        got = threshold.best(ids, rows, np.argsort(rows, axis=0, kind="stable").T, int(ids[0]), q, 7)
        want = sorted((-int(r @ q), int(i)) for i, r in zip(ids, rows, strict=True) if i != ids[0])[:7]
        assert [(-int(s), int(i)) for i, s in zip(*got, strict=True)] == want


def test_threshold_numbers_only_block_ids(spark, monkeypatch):
    """No window without a key sorts the vectors of the query blocks."""
    monkeypatch.setattr(threshold, "ROW_BLOCK", 64)
    monkeypatch.setattr(threshold, "QUERY_BLOCK", 8)
    plan = threshold.top_k(table(spark, vectors()), threshold.F.col("vec_id") % 20 == 0)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "row_number() windowspecdefinition(block" in x)
    below = lines[at + 1]
    assert "Project [block#" in below and "data#" not in below


def test_threshold_empty(spark):
    assert threshold.top_k(table(spark, []), threshold.F.col("vec_id") % 20 == 0).count() == 0
