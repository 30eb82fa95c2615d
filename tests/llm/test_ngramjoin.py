import os
import random
import time

from helpers import doc, frame, words

from lintlake.llm import ngramjoin
from lintlake.session import ensure_checkpoint_dir, materialize, steps


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(data, width, percent):
    sets = [shingles(t, width) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(data))


def corpus(seed, bases=6, copies=12):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    data = []
    for _ in range(bases):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([2, 5, 40, 120]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            data.append((len(data), " ".join(t).upper() if rnd.random() < 0.3 else " ".join(t)))
    return data + [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (0, data[0][1]), (None, data[0][1]), (None, "alone and null here")]


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_against_brute_force(spark):
    for width, percent, seed in ((3, 90, 1), (5, 80, 2)):
        data = corpus(seed)
        df = frame(spark, [doc(i, t) for i, t in data])
        assert got(ngramjoin.components(df, width, percent)) == brute(data, width, percent)


def test_star_rounds_reach_every_link(spark):
    """One large group of near copies: most pairs link, some only through others."""
    data = corpus(3, bases=1, copies=60)
    assert got(ngramjoin.components(frame(spark, [doc(i, t) for i, t in data]), 3, 80)) == brute(data, 3, 80)


def test_every_link_inside_components(spark):
    """Links and numbers of links of every document, in a large group of near copies too."""
    base = [f"v{i}" for i in range(120)]
    near = [(1000 + i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]])) for i in range(40)]
    data = near + near[:3] + corpus(5, bases=2, copies=5)
    df = frame(spark, [doc(i, t) for i, t in data])
    sets = [shingles(t, 3) for _, t in data]
    linked = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    number = [sum(bool(linked(x, y)) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    out = ngramjoin.components(df, 3, 80, every_link=True)
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in out.collect()) == sorted((str(d), len(s), k) for (d, _), s, k in zip(data, sets, number, strict=True))
    assert got(out) == brute(data, 3, 80)
    links, members = ngramjoin.similar(df, 3, 80)
    pairs = sum(bool(linked(x, y)) for x in set(sets) for y in set(sets) if x != y) // 2
    assert links.count() == links.distinct().count() == pairs > len(set(sets))
    assert members.count() == sum(bool(s) for s in sets) and members.select("node").distinct().count() == len({s for s in sets if s})


def test_one_of_each(spark):
    data = corpus(4, bases=3, copies=6)
    df = frame(spark, [doc(i, t) for i, t in data])
    out = ngramjoin.one_of_each(df)
    assert out.columns == df.columns
    comps = {c for _, n, c in brute(data, 5, 80) if n}
    kept = [r for r in out.collect() if words(r["text"])]
    assert len(kept) == len({c for c in comps if c != "None"}) + 1  # the class of null ids keeps its row
    assert sum(1 for r in out.collect() if not words(r["text"])) == 3


def test_empty_table(spark):
    empty = frame(spark, [])
    assert ngramjoin.components(empty).count() == 0
    assert ngramjoin.one_of_each(empty).count() == 0


def test_common_counts_in_column_blocks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngramjoin, "COLUMNS", 7)
    rnd = random.Random(9)
    sets = [sorted(rnd.sample(range(60), rnd.randint(0, 30))) for _ in range(25)]
    got_ = ngramjoin._common(np.array([len(x) for x in sets]), np.array([i for x in sets for i in x], np.int64))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            shared = [x for x in set(a) & set(b)]
            assert got_[i, j] == len(shared) or i == j


def test_link_counts_do_not_depend_on_blocks(spark, monkeypatch):
    base = [f"v{i}" for i in range(120)]
    data = [(i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]])) for i in range(40)] + corpus(5, bases=2, copies=6)
    df = frame(spark, [doc(i, t) for i, t in data])
    links = lambda: sorted(map(str, ((r["doc_id"], r["n_links"], r["component_id"]) for r in ngramjoin.components(df, 3, 90, every_link=True).collect())))
    whole = links()
    monkeypatch.setattr(ngramjoin, "ITEMS", 300)
    assert links() == whole


def test_slices_count_like_the_whole_block():
    import numpy as np
    from lintlake.llm import ngramjoin as N

    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 1 << 64, 3000, dtype=np.uint64)
    parts = [rnd.choice(pool, 4000) for _ in range(5)] + [np.array([0, 0, (1 << 64) - 1, (1 << 64) - 1], np.uint64)]
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    found = [N.counted(parts, k, 2) for k in range(N.SLICES)]
    assert max(len(x) for x, _ in found) < len(h) / 8  # none sorts the whole block
    got_h, got_n = (np.concatenate(x) for x in zip(*found, strict=True))
    assert got_h.tolist() == h[n >= 2].tolist() and got_n.tolist() == n[n >= 2].tolist()


def test_pairs_of_a_group_share_cells(spark, monkeypatch):
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)] + [(20, 21), (21, 22), (22, 23)]
    sized = spark.createDataFrame([(k, 5) for k in range(30)], "cid long, n long")
    frame_ = spark.createDataFrame(pairs, "a long, b long")
    rows = ngramjoin.cells(frame_, sized).collect()
    assert sorted(r["cid"] for r in rows if r["place"] == 0) == list(range(12))  # once each, not once a pair
    monkeypatch.setattr(ngramjoin, "CELL_ITEMS", 10)
    rows = ngramjoin.cells(frame_, sized)
    assert rows.filter("lo <> hi").count() > 0
    far = ngramjoin.met(rows.unionByName(rows), [], lambda t, a, b: t.column("cid").to_numpy()[b] - t.column("cid").to_numpy()[a] > 3)
    assert sorted((r["a"], r["b"]) for r in far.collect()) == [(a, b) for a, b in pairs if b - a > 3]


def test_one_of_each_leaves_no_passing_steps(spark):
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/lintlake-steps"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = frame(spark, [doc(1, "a b c d e f"), doc(2, "a b c d e f"), doc(3, "g h i j k l")])
    out = ngramjoin.one_of_each(df)
    assert {p.rsplit("-", 1)[0] for p in set(os.listdir(folder)) - before} == {"ngram-classes", "ngram-stay"}
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_steps_on_the_way_are_removed_early(spark, monkeypatch):
    """Signatures and a round's candidates are gone before the components are read."""
    data = corpus(3, bases=1, copies=20)
    with steps() as written:
        out = ngramjoin.components(frame(spark, [doc(i, t) for i, t in data]), 3, 80)
    left = [os.path.basename(p).rsplit("-", 1)[0] for p in written if os.path.isdir(p.removeprefix("file:"))]
    assert set(left) == {"ngram-nodes", "ngram-postings", "ngram-traits", "ngram-sets", "ngram-links", "ngram-components"}
    assert got(out) == brute(data, 3, 80)


def test_shuffle_files_go_with_their_step(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    before = set(files())
    out = materialize(spark.range(20_000, numPartitions=7).repartition(11, "id"))
    for _ in range(50):
        left = [f for f in set(files()) - before if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.2)
    assert not left and out.count() == 20_000


def test_near_pairs_of_a_large_component(spark, monkeypatch):
    """Every pair across components, none inside; a large component is sent to the others only, one that is alone nowhere."""
    group = 4
    monkeypatch.setattr(ngramjoin, "GROUP", group)
    sizes = [60, 9, 1, 1, 2, 1, 3]
    of = [c for c, k in enumerate(sizes) for _ in range(k)]
    first = [of.index(c) for c in of]
    rows = [(7, cid, 10, 0, first[cid]) for cid in range(len(of))] + [(8, cid, 10, 0, 0) for cid in range(60)]
    g = spark.createDataFrame(rows, "token long, cid long, n long, i int, c long")
    traits = spark.createDataFrame([(cid, [0] * ngramjoin.BUCKETS) for cid in range(len(of))], "cid long, counts array<short>")
    got_ = sorted((r["a"], r["b"]) for r in ngramjoin.near_pairs(g, traits, 80).collect())
    assert got_ == [(a, b) for a in range(len(of)) for b in range(a + 1, len(of)) if of[a] != of[b]]
    sent = ngramjoin.dealt(g).selectExpr("token", "c", "explode(blocks) AS bc").filter("bc < 0 OR bc <> c")
    assert sent.filter("token = 8").count() == 0
    others = -(-5 // group) + -(-9 // group) + 1  # blocks of the small ones, of nine and of three
    assert sent.filter("c = 0").count() == 60 * others


def test_rounds_keep_open_tokens_only(spark):
    g = spark.createDataFrame([(1, 5, 0), (1, 6, 0), (2, 5, 0), (2, 7, 7)], "token long, cid long, c long")
    assert sorted(tuple(r) for r in ngramjoin.open_tokens(g).collect()) == [(2, 5, 0), (2, 7, 7)]
