import hashlib
import random

import numpy as np
from helpers import doc, frame

from lintlake.llm import suffixdedup as S


def brute(data, length, first):
    at = {}
    for k, (_, t) in enumerate(data):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            at.setdefault(raw[i : i + length], []).append((k, i))
    out = []
    for k, (d, t) in enumerate(data):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            where = at[raw[i : i + length]]
            if len(where) > 1 and (not first or min(where) != (k, i)):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    data = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 20)))]
        for _ in range(rnd.choice([0, 1, 2])):
            parts += [rnd.choice(passages), " ".join(word() for _ in range(rnd.randint(0, 12)))]
        data.append((i, "".join(parts)))
    data += [(60, data[5][1]), (61, data[5][1]), (62, "z" * 130), (63, "xy" * 90), (64, None), (65, ""), (66, "short"), (67, passages[0][3:-4]), (68, "q" * 39), (69, "ab" * 3000)]
    return data


def got(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_all_copies_against_brute_force(spark):
    for seed, limit in ((1, 32), (2, 2)):  # a low limit sends most groups the fingerprint way
        data = corpus(seed) + [(5, corpus(seed)[5][1]), (None, corpus(seed)[7][1])]
        df = frame(spark, [doc(i, t) for i, t in data])
        assert got(S.remove(df, length=40, gram=24, group_limit=limit)) == brute(data, 40, False)


def test_first_copy_stays(spark):
    for seed, limit in ((3, 32), (4, 2)):
        data = corpus(seed)
        df = frame(spark, [doc(i, t) for i, t in data])
        assert got(S.remove(df, length=40, gram=24, first=True, group_limit=limit)) == brute(data, 40, True)


def test_whole_characters(spark):
    shared = "é" * 60
    df = frame(spark, [doc(1, "aé" + shared), doc(2, "bà" + shared)])
    for r in S.remove(df, length=41, gram=24, whole_chars=True).collect():
        assert "�" not in bytes(r["kept"]).decode("utf-8", errors="replace")


def test_suffix_ranks_are_the_suffix_order():
    rnd = random.Random(9)
    for n in (1, 5, 60, 300):
        raw = bytes(rnd.choice(b"ab") for _ in range(n))
        for depth in (1, 3, 7, 8, 20, 40):
            rank = S.suffix_ranks(np.frombuffer(raw, np.uint8), depth)
            order = sorted(range(n), key=lambda i: raw[i : i + depth])
            keys = [raw[i : i + depth] for i in order]
            for a, b, x, y in zip(order, order[1:], keys, keys[1:], strict=False):
                assert (rank[a] == rank[b]) == (x == y) and rank[a] <= rank[b]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 3, 7, 200):
        assert (S.sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def test_long_texts_in_slices(spark, monkeypatch):
    data = [(1, "".join(random.Random(2).choice("abc") for _ in range(3000))), (2, "x" + "".join(random.Random(2).choice("abc") for _ in range(900)))]
    monkeypatch.setattr(S, "SLICE", 500)
    full = S.anchors(np.frombuffer(data[0][1].encode(), np.uint8), np.array([0, 3000]), 40, 24)
    assert (full[4] * full[5]).sum() == 3000 - 39
    assert full[3].tolist() == sorted(full[3].tolist())
    periodic = S.anchors(np.frombuffer(b'ab' * 500, np.uint8), np.array([0, 1000]), 40, 24)
    assert len(periodic[0]) <= 4 and (periodic[4] * periodic[5]).sum() == 1000 - 39
    df = frame(spark, [doc(i, t) for i, t in data])
    assert got(S.remove(df, length=40, gram=24)) == brute(data, 40, False)


def test_empty_table(spark):
    assert S.remove(frame(spark, []), length=40, gram=24).count() == 0
