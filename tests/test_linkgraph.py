"""Cycle components, shortest cycles and near-to-far look-up against plain Python."""

import random
from collections import deque

from lintlake.operators import linkgraph as L


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach(pairs, start):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        for a, b in pairs:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def components(pairs):
    nodes = sorted({n for p in pairs for n in p})
    to = {n: reach(pairs, n) for n in nodes}
    return {n: min(m for m in nodes if m in to[n] and n in to[m]) for n in nodes if n in to[n]}


def shortest(pairs, comp, c):
    """Smallest predecessors on the level before, read back from the first return to ``c``."""
    inner = [(a, b) for a, b in pairs if comp.get(a) == comp.get(b) == c]
    level, todo = {c: 0}, deque([c])
    while todo:
        n = todo.popleft()
        for a, b in sorted(inner):
            if a == n and b not in level:
                level[b] = level[n] + 1
                todo.append(b)
    last = min((level[a], a) for a, b in inner if b == c)[1]
    path = [last, c]
    while level[path[0]]:
        path.insert(0, min(a for a, b in inner if b == path[0] and level[a] == level[path[0]] - 1))
    return path


def check(spark, pairs):
    pairs = sorted(set(pairs))
    e = edges(spark, pairs)
    members = L.cycle_components(e)
    want = components(pairs)
    assert {r["node"]: r["component"] for r in members.collect()} == want and members.count() == len(want)
    got = {r["component"]: (r["size"], r["length"], r["path"]) for r in L.cycles_through(e, members).collect()}
    assert got.keys() == set(want.values())
    for c, (size, length, path) in got.items():
        assert path == shortest(pairs, want, c) and length == len(path) - 1 and size == sum(x == c for x in want.values())


def test_hand_made_graph(spark):
    check(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "f"), ("g", "a"), ("f", "h"), ("s", "s"), ("x", "y")])


def test_random_graphs(spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        check(spark, [(f"n{rnd.randint(0, 25):02d}", f"n{rnd.randint(0, 25):02d}") for _ in range(38)])


def test_a_long_ring_and_a_graph_without_cycles(spark):
    check(spark, [(f"r{k:02d}", f"r{(k + 1) % 23:02d}") for k in range(23)])
    e = edges(spark, [("a", "b"), ("b", "c")])
    members = L.cycle_components(e)
    assert members.count() == 0 and L.cycles_through(e, members).count() == 0


def test_near_to_far(spark):
    links = spark.createDataFrame([(1, ["com", "shop", "fr"], ["x"]), (2, ["com", "shop", "fr"], ["y"]), (3, ["org"], ["x"]), (4, [], ["z"]), (5, ["com", "shop", "fr"], ["sub", "x"])], "id long, base array<string>, name array<string>")
    known = spark.createDataFrame([(["com", "shop", "x"],), (["com", "x"],), (["y"],), (["com", "shop", "fr", "sub", "x"],), (["y"],)], "path array<string>")
    got = {r["id"]: (r["target"], r["level"]) for r in L.resolve_near_to_far(links, known).collect()}
    assert got == {1: (["com", "shop", "x"], 1), 2: (["y"], 3), 3: (None, None), 4: (None, None), 5: (["com", "shop", "fr", "sub", "x"], 0)}


def test_near_to_far_collects_no_links_in_the_driver(spark):
    links = spark.createDataFrame([(1, ["com", "shop"], ["x"]), (2, ["org"], ["y"])], "id long, base array<string>, name array<string>")
    known = spark.createDataFrame([(["com", "x"],), (["y"],)], "path array<string>")
    out = L.resolve_near_to_far(links, known)
    got = {(r["id"], tuple(r["target"]), r["level"]) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert got == {(1, ("com", "x"), 1), (2, ("y",), 1)} and "Broadcast" not in plan


def test_reached_counts_equal_plain_reach(spark):
    for seed, nodes, links in ((1, 30, 45), (2, 60, 70), (3, 40, 160)):
        rnd = random.Random(seed)
        pairs = [(f"n{rnd.randint(0, nodes):02d}", f"n{rnd.randint(0, nodes):02d}") for _ in range(links)]
        starts = sorted({a for a, _ in pairs}) + ["alone"]
        got = {r["seed"]: r["reached"] for r in L.reached_counts(edges(spark, pairs), spark.createDataFrame([(n,) for n in starts], "node string")).collect()}
        assert got == {n: len(reach(pairs, n) | {n}) for n in starts}


def test_reached_counts_make_no_pairs_of_entries_and_reached_nodes(spark, monkeypatch):
    # 400 entries link into a ring of 40 topics that all link to 60 leaves: 40,400 pairs, 3,240 edges.
    ring = [(f"r{k:02d}", f"r{(k + 1) % 40:02d}") for k in range(40)] + [(f"r{k:02d}", f"r{(k * 7 + 1) % 40:02d}") for k in range(40)]
    pairs = ring + [(f"r{k:02d}", f"z{m:02d}") for k in range(40) for m in range(60)] + [(f"e{k:03d}", f"r{k % 40:02d}") for k in range(400)] + [(f"e{k:03d}", f"y{k % 3}") for k in range(400)]
    written = []
    keep = L.materialize

    def counted(df, name="step"):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "materialize", counted)
    seeds = spark.createDataFrame([(f"e{k:03d}",) for k in range(400)], "node string")
    got = {r["seed"]: r["reached"] for r in L.reached_counts(edges(spark, pairs), seeds).collect()}
    assert got == {f"e{k:03d}": 102 for k in range(400)} and sum(written) < 20_000
