"""Similarity join against brute force; closure and components properties."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from lintlake.operators import graph as G
from lintlake.operators import similarity as SIM

SF = "/root/testdata/sf0.001"


def _dice(a, b):
    ca, cb = Counter(a), Counter(b)
    return 2 * sum((ca & cb).values()) / (sum(ca.values()) + sum(cb.values()))


def test_document_pairs_equal_brute_force(spark):
    from lintlake.plans.q_patterns import d09_near_duplicate_documents

    got = {(r.doc_a, r.doc_b) for r in d09_near_duplicate_documents(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rep = {}
    for d in sorted(docs, key=lambda r: r.doc_id):
        rep.setdefault(d.text, d.doc_id)
    items = sorted((i, [t for t in txt.lower().split() if t]) for txt, i in rep.items())
    want = {(a, b) for (a, ta), (b, tb) in itertools.combinations(items, 2) if ta and tb and _dice(ta, tb) >= 0.8}
    assert got == want


def test_prefix_filter_is_exact_on_synthetic_sets(spark):
    rows = [(0, i, " ".join(f"w{(i * k) % 17}" for k in range(1, 12 + i % 5))) for i in range(40)]
    items = spark.createDataFrame(rows, "grp int, item int, text string")
    el = SIM.elements(items, SIM.doc_tokens(F.col("text")))
    got = {(r.a, r.b) for r in SIM.similar_pairs(el, 0.6).collect()}
    toks = {i: t.split() for _g, i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(toks), 2) if _dice(toks[a], toks[b]) >= 0.6 - 1e-12}
    assert got == want


def test_closure_is_transitive_and_matches_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    r = {(x.src, x.dst) for x in G.closure(e).collect()}
    for (a, b), (c, d) in itertools.product(r, r):
        if b == c:
            assert (a, d) in r
    cyc = {x.node: x.component for x in G.cycles(G.closure(e)).collect()}
    assert cyc == {"a": "a", "b": "a", "c": "a"}


def test_components_min_label(spark):
    p = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 7, 8)], "grp int, a int, b int")
    comp = {r.item: r.component for r in SIM.components(p).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from lintlake.operators import components as C

    written = []
    keep = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: written.append(name) or keep(df, name))
    rows = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert written.count("large-star") <= 14


def test_reachable_and_shortest_cycles(spark):
    from lintlake.operators import linkgraph as L

    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    e = spark.createDataFrame([*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("s", "s"), ("c", "d"), ("d", "n00")], "src string, dst string")
    far = {(r.seed, r.node): r.distance for r in L.reachable(e, spark.createDataFrame([("n00",), ("zz",)], "node string")).collect()}
    assert far == {("n00", f"n{i:02d}"): i for i in range(21)} | {("zz", "zz"): 0}
    assert {r.node: r.length for r in L.shortest_cycles(e).collect()} == {"a": 2, "b": 2, "c": 3, "s": 1}
    none = spark.createDataFrame(chain, "src string, dst string")
    assert L.cyclic_core(none).count() == 0


def test_document_groups_equal_brute_force(spark):
    from lintlake.plans.q_patterns import d11_document_duplicate_groups

    got = sorted(r.n_docs for r in d11_document_duplicate_groups(spark, SF).collect())
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    parent = {d.doc_id: d.doc_id for d in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a, b):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)

    rep = {}
    for d in docs:
        if d.text in rep:
            union(rep[d.text], d.doc_id)
        else:
            rep[d.text] = d.doc_id
    items = sorted((i, [t for t in txt.lower().split() if t]) for txt, i in rep.items())
    for (a, ta), (b, tb) in itertools.combinations(items, 2):
        if ta and tb and _dice(ta, tb) >= 0.8:
            union(a, b)
    sizes = Counter(find(d.doc_id) for d in docs)
    want = sorted(n for n in sizes.values() if n > 1)
    assert got == want


def test_items_stay_one_row_and_pairs_equal_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    base = [[words[min(399, int(rnd.expovariate(0.02)))] for _ in range(rnd.choice([1, 2, 5, 30, 90, 300]))] for _ in range(60)]
    texts = list(base)
    for k in range(90):
        t = list(base[k % 60])
        for _ in range(rnd.randint(0, max(1, len(t) // 6))):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(t + rnd.sample(words, rnd.randint(0, len(t) // 5)))
    rows = [(k % 2, k, " ".join(t)) for k, t in enumerate(texts)]
    el = SIM.elements(spark.createDataFrame(rows, "grp int, item long, text string"), SIM.doc_tokens(F.col("text")))
    assert el.count() == len(rows)  # not a row per token
    for dice in (0.8, 0.6):
        got = {(r.a, r.b): (r.na, r.nb, round(r.similarity, 9)) for r in SIM.similar_pairs(el, dice).collect()}
        want = {(a, b): (len(texts[a]), len(texts[b]), round(_dice(texts[a], texts[b]), 9)) for a, b in itertools.combinations(range(len(texts)), 2) if a % 2 == b % 2 and _dice(texts[a], texts[b]) >= dice - 1e-12}
        assert got == want and len(want) > 20


def test_document_pairs_of_repeated_ids_and_nulls_equal_the_sql(spark, tmp_path):
    import duckdb
    from lintlake.plans.q_patterns import d09_near_duplicate_documents
    from lintlake.plans.catalog import load_all

    a = "one two three four five six seven eight nine ten"
    rows = [(1, a), (1, a), (2, a + " eleven"), (3, "x y z"), (3, "p q r"), (4, "x y z p q r"), (5, None), (None, a + " twelve"), (6, ""), (7, "Z X y p Q r"), (8, a.upper())]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(load_all()["d09_near_duplicate_documents"][1]).fetchall()
    got = d09_near_duplicate_documents(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3


def test_text_elements_are_those_of_the_tokens(spark):
    """Texts cut where they are hashed give the elements of Spark's tokens, and only items that may match are cut again."""
    from lintlake.operators import similarity as SIM

    texts = ["A b c  b\tB\x0b\x0cd\r\ne", "", " \n", "İstanbul ÉTÉ ẞ", "x" * 50 + " x", "  \x1c y \x85 z", "one", None] + [f"w{k} w{k + 1} " * 40 for k in range(0, 60, 2)]
    base = [f"v{k}" for k in range(60)]
    texts += [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(5)]
    items = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "grp int, item long, text string")
    rows = lambda df: sorted((r["grp"], r["item"], r["n"], sorted(r["es"])) for r in df.collect())
    tokens = SIM.elements(items.filter("text IS NOT NULL"), SIM.doc_tokens(F.col("text")))
    cut = SIM.text_elements(items, F.col("text"))
    assert rows(cut) == rows(tokens) and len(rows(cut)) == len(texts) - 3
    asked = []

    def only(keys):
        asked.append(keys.count())
        return SIM.text_elements(items.join(keys, ["grp", "item"], "left_semi"), F.col("text"))

    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    found = pairs(SIM.similar_pairs(cut, 0.8, only=only))
    assert found == pairs(SIM.similar_pairs(tokens, 0.8)) and len(found) == 4
    assert asked[0] < 10


def test_overlaps_by_marks(monkeypatch):
    import random

    import numpy as np

    from lintlake.operators import similarity as SIM

    monkeypatch.setattr(SIM, "MET", 20)
    rnd = random.Random(4)
    sets = [rnd.sample(range(40), rnd.randint(1, 30)) for _ in range(15)]
    pairs = [(a, b) for a in range(15) for b in range(15) if rnd.random() < 0.4]
    rnd.shuffle(pairs)
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    got = SIM._overlaps(np.concatenate(sets).astype(np.int32), np.cumsum([0, *map(len, sets)]), a, b)
    assert got.tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in pairs]
