from collections import defaultdict
from itertools import cycle

from helpers import doc, frame, words

from lintlake.llm import mixing


def wanted(sizes):
    """Targets by repeated sharing of the excess."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = dict(zip(order, cycle((1, 2, 3)), strict=False))
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_quotas_and_limits(spark):
    data = [doc(i, "w " * (i % 37 + 1), source=s) for i, s in enumerate(["a"] * 60 + ["b"] * 5 + ["B"] * 40 + ["é"] * 2 + [None] * 30)]
    data += [doc(900, None, source="a"), doc(901, "", source="b"), doc(902, "x y", source="empty-ish"), doc(0, "w " * 1, source="a"), doc(None, "n n n", source=None)]
    df = frame(spark, data)
    out = mixing.mix(df, block_words=4, shard_words=150)
    rows = out.collect()
    sizes = defaultdict(int)
    for d in data:
        sizes[d[3]] += len(words(d[1]))
    goal, taken = wanted(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(data)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 4 * 8, s
    again = sorted(map(str, mixing.mix(df, block_words=4, shard_words=150).drop("mark").collect()))
    assert again == sorted(map(str, out.drop("mark").collect()))


def test_sainte_lague_seats(spark):
    """Against seat-by-seat allocation by the highest quotient."""
    shares = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.5, "e": 24.0}
    for n in (0, 1, 7, 50):
        df = spark.createDataFrame([(0, p, s, n) for p, s in shares.items()], "g int, party string, share double, seats long")
        got = {r["party"]: r["quota"] for r in mixing.seats(df, ["g"], ["party"], "share", "seats").collect()}
        want = dict.fromkeys(shares, 0)
        for _ in range(n):
            want[max(shares, key=lambda p: (shares[p] / (2 * want[p] + 1), -ord(p)))] += 1
        assert got == want


def test_whole_rows_and_empty_table(spark):
    df = frame(spark, [doc(i, "one two three", source="s") for i in range(9)])
    assert mixing.mix(df, rows=True).select("row.*").drop("__row").columns == df.columns
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(frame(spark, [doc(1, None), doc(2, "")])).collect()} == {0}
