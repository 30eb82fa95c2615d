import os
import random
import re

from helpers import LOWER, doc, frame

from lintlake.llm import decontam

ITEMS = "item_id long, text string, doc_id string, items int"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window, slop=None):
    wins = []
    for i, text in items:
        t = tokens(text)
        wins += [("" if i is None else str(i), t[k : k + window]) for k in range(max(1, len(t) - window + 1)) if t]
    out = []
    for d in docs:
        t, hit, found, near = tokens(d[1]), set(), set(), set()
        for item, w in wins:
            for k in range(len(t) - len(w) + 1):
                if t[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(item)
            if slop is not None and any(set(w) <= set(t[k : k + slop]) for k in range(max(1, len(t) - slop + 1))):
                near.add(item)
        out.append((d[0], len(t), len(hit), sorted(found), sorted(near)))
    return out


def some(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


def case(seed):
    rnd = random.Random(seed)
    words = ["a", "B", "c1", "é", "d"]
    items = [(k, some(rnd, rnd.randint(1, 9), words)) for k in range(8)] + [(3, "zz yy"), (None, "null id item"), (9, None), (10, "--- !"), (11, "")]
    docs = [doc(k, some(rnd, rnd.randint(0, 60), words)) for k in range(30)]
    docs += [doc(5, "ZZ, yy!zz"), doc(5, "zz yy"), doc(None, "Null-ID (item)"), doc(40, None), doc(41, ""), doc(42, " \x00 .,"), doc(43, some(rnd, 4000, words))]
    docs += [doc(50, items[0][1] + "; " + items[1][1]), doc(51, items[0][1])] + [doc(60 + k, "x " + items[2][1] * 3) for k in range(40)]
    return docs, items


def run(spark, docs, items, window, slop=None):
    its = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    got = decontam.decontaminate(frame(spark, docs), its, window, slop).collect()
    for r in got:
        assert r["n_hit"] == sum(z - a for a, z in zip(r["begins"], r["ends"], strict=True)) and r["contaminated"] == (r["n_hit"] > 0)
        assert all(a < z for a, z in zip(r["begins"], r["ends"], strict=True)) and all(z < a for z, a in zip(r["ends"], r["begins"][1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["near_items"]) for r in got), key=str)


def test_against_brute_force(spark, monkeypatch):
    for seed, segment in ((1, 200), (2, 1 << 20)):
        monkeypatch.setattr(decontam, "SEGMENT", segment)
        docs, items = case(seed)
        assert run(spark, docs, items, 4) == sorted(brute(docs, items, 4), key=str)


def test_blocks_of_windows_change_nothing(spark, monkeypatch):
    docs, items = case(3)
    monkeypatch.setattr(decontam, "STARTS", 50)
    whole = run(spark, docs, items, 3)
    monkeypatch.setattr(decontam, "BLOCK", 5)
    assert run(spark, docs, items, 3) == whole == sorted(brute(docs, items, 3), key=str)


def test_proximity(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rnd.sample(words, 4))) for k in range(6)] + [(7, "w1 w2 w1")]
    docs = [doc(k, some(rnd, 150, words)) for k in range(40)] + [doc(90, "w1 " + items[0][1].replace(" ", " x ")), doc(91, items[0][1])]
    want = sorted(brute(docs, items, 4, slop=12), key=str)
    assert run(spark, docs, items, 4, slop=12) == want and 20 < sum(len(r[4]) for r in want) < 200
    monkeypatch.setattr(decontam, "SEGMENT", 500)
    monkeypatch.setattr(decontam, "BLOCK", 2)
    assert run(spark, docs, items, 4, slop=12) == want


def test_near_is_order_free_and_stays_in_its_document(spark):
    items = [(1, "alpha beta gamma")]
    docs = [doc(1, "gamma x beta y alpha"), doc(2, "alpha beta"), doc(3, "gamma"), doc(4, "alpha " + "x " * 20 + "beta gamma")]
    got = {r[0]: r for r in run(spark, docs, items, 10, slop=5)}
    assert got[1][4] == ["1"] and got[1][3] == [] and not got[2][4] and not got[3][4] and not got[4][4]


def test_a_phrase_does_not_cross_documents(spark):
    assert [r[2] for r in run(spark, [doc(1, "one two"), doc(2, "three four")], [(1, "two three")], 10)] == [0, 0]


def test_short_items_repeated_ids_and_items(spark):
    items = [(1, "one"), (1, "two three"), (10, "one"), (2, "one")]
    got = run(spark, [doc(7, "Two three. ONE one"), doc(7, "four")], items, 10)
    assert got == [(7, 1, 0, [], []), (7, 4, 4, ["1", "10", "2"], [])]


def test_empty(spark):
    docs = [doc(1, "one two")]
    assert run(spark, [], [(1, "one")], 10) == []
    assert run(spark, docs, [], 10) == [(1, 2, 0, [], [])]


def test_jobs_hold_few_segments(spark, monkeypatch):
    """Index and every search run under bounds on what a task holds at once; the index goes when the searches are written."""
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    seen, kept = [], decontam.keep

    def keep(df, name, **options):
        out = kept(df, name, **options)
        seen.append((name, [spark.conf.get(k, None) for k in keys], out.inputFiles()[0].removeprefix("file:")))
        return out

    before = [spark.conf.get(k, None) for k in keys]
    monkeypatch.setattr(decontam, "keep", keep)
    monkeypatch.setattr(decontam, "SEGMENT", 200)
    monkeypatch.setattr(decontam, "BLOCK", 10)
    docs, items = case(3)
    assert run(spark, docs, items, 4) == sorted(brute(docs, items, 4), key=str)
    bounds = {name: at for name, at, _ in seen}
    assert bounds["postings"] == [str(decontam.HANDED), str(decontam.READ[0])] and bounds["found"] == [str(decontam.HANDED), str(decontam.READ[1])]
    assert sum(name == "found" for name, _, _ in seen) > 2
    assert [spark.conf.get(k, None) for k in keys] == before
    assert not any(os.path.exists(path) for name, _, path in seen if name == "postings")
