import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import doc, frame, remainder, words
from pyspark.sql import functions as F

from lintlake.llm import suffixtree
from lintlake.llm.common import id_remainder


def corpus():
    rnd = random.Random(5)
    data = []
    for i in range(120):
        t, w = [], "a"
        for _ in range(rnd.choice([0, 3, 40])):
            w = rnd.choice({"a": "bbbc", "b": "aaad", "c": "abcd", "d": "b"}[w])
            t.append(w.upper() if rnd.random() < 0.2 else w)
        data.append((i, " ".join(t)))
    return data + [(500, None), (501, ""), (502, "unseen words only"), (3, data[3][1]), (None, "a b a"), (503, "a b " * 3000 + "zz")]


class Plain:
    """The tree as a dictionary of counted runs."""

    def __init__(self, texts, depth, gain):
        self.depth, self.runs = depth, Counter()
        for t in texts:
            for k in range(1, depth + 2):
                self.runs.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
        self.total = sum(n for r, n in self.runs.items() if len(r) == 1)
        self.distinct = sum(len(r) == 1 for r in self.runs)
        self.kept, nats = Counter(), Counter()
        for r, n in self.runs.items():
            if len(r) > 1 and n >= suffixtree.SUPPORT:
                below = self.runs[r[1:-1]] if len(r) > 2 else self.total
                self.kept[r[:-1]] += n
                nats[r[:-1]] += n * (math.log(n / self.runs[r[:-1]]) - math.log(self.runs[r[1:]] / below))
        self.states = {c for c in self.kept if nats[c] >= gain * self.kept[c]}

    def root(self, w):
        return (self.runs[(w,)] + 1) / (self.total + self.distinct + 1)

    def p(self, before, w):
        p = self.root(w)
        for k in range(1, min(self.depth, len(before)) + 1):
            c = tuple(before[-k:])
            if c not in self.states:
                break
            n = self.runs[(*c, w)]
            n = n if n >= suffixtree.SUPPORT else 0
            p = (n + (self.runs[c] - self.kept[c] + suffixtree.PRIOR) * p) / (self.runs[c] + suffixtree.PRIOR)
        return p


@pytest.mark.parametrize(("depth", "gain", "block"), [(1, 0.01, 1 << 24), (2, 0.01, 1 << 24), (2, 0.3, 64), (3, 0.05, 200)])
def test_equals_plain_tree(spark, monkeypatch, depth, gain, block):
    monkeypatch.setattr(suffixtree, "SHARD_TOKENS", 1000)  # read on the driver
    data = corpus()
    out = suffixtree.score(frame(spark, [doc(i, t) for i, t in data]), id_remainder(F.col("doc_id"), 7) != 2, gain, depth, block).collect()
    listed = [(i, [*words(t), None]) for i, t in data]
    tree = Plain([t for i, t in listed if remainder(i, 7) != 2], depth, gain)
    assert 0 < len(tree.states)
    want = []
    for i, t in listed:
        base = sum(math.log10(tree.root(w)) for w in t)
        lp = sum(math.log10(tree.p(t[:j], w)) for j, w in enumerate(t))
        want.append((str(i), remainder(i, 7) != 2, len(t), sum(tree.runs[(w,)] > 0 for w in t), round(base, 5), round(lp, 5)))
    got = sorted((str(r["doc_id"]), r["trained"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in out)
    assert got == sorted(want)
    assert {r["train_tokens"] for r in out} == {tree.total}
    held = [r for r in out if not r["trained"] and r["n_tokens"] > 10]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # contexts help on unseen texts


def test_states_are_distributions():
    """In every state the probabilities of all known words and one unknown word sum to 1."""
    texts = [[*words(t), None] for _, t in corpus()]
    tree = Plain(texts, 2, 0.01)
    symbols = [r[0] for r in tree.runs if len(r) == 1] + ["an unknown word"]
    for c in [(), *tree.states]:
        assert abs(sum(tree.p(list(c), w) for w in symbols) - 1) < 1e-9


def test_a_text_that_occurs_twice_is_known(spark):
    """However small its share of the corpus is, a run that occurs twice makes states."""
    rnd = random.Random(1)
    lone = [" ".join(rnd.choice("abcdefghij") * 2 for _ in range(60)) for _ in range(300)]
    twice = " ".join(rnd.choice("abcdefghij") * 2 + str(k) for k in range(60))
    out = suffixtree.score(frame(spark, [doc(i, t) for i, t in enumerate([*lone, twice, twice])]), F.lit(True)).collect()
    by = {r["doc_id"]: r["score"] / r["n_tokens"] for r in out}
    assert min(by[300], by[301]) > -0.25 > max(by[i] for i in range(300))


def test_distinct_keys_with_equal_high_bits():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 1000, 5000):
        for spread in (3, 1 << 10, 1 << 63):
            key = rng.integers(0, spread, n, dtype=np.uint64) * np.uint64(1 if spread > 4 else 0x9E3779B97F4A7C15)
            keys, place = suffixtree.distinct_of(key)
            want, inverse = np.unique(key, return_inverse=True)
            assert (keys == want).all() and (place == inverse).all()


def test_changed_blocks_are_noticed():
    rows = [{"m": 2, "crc": 0, "answer": suffixtree.packed(np.array([1, 2]))}]
    with pytest.raises(RuntimeError):
        suffixtree._answers(rows)(np.array([3, 4], np.uint64))


def test_empty_tables(spark):
    assert suffixtree.score(frame(spark, []), F.lit(True)).count() == 0
    r = suffixtree.score(frame(spark, [doc(1, "a b")]), F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0.0
