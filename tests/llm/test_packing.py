import random
import zlib

import numpy as np
import pytest
from helpers import doc, frame

from lintlake.llm import packing

public = pytest.importorskip("public_tokenizers")


def check(spark, lengths, capacity, slack):
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(lengths)], "pid long, length long, gap long")
    out = packing.place(df, capacity).collect()
    assert len(out) == len(lengths) and len({r["pid"] for r in out}) == len(lengths)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["pid"]]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    floor = max(-(-sum(lengths) // capacity), sum(n > capacity // 2 for n in lengths))
    assert len(seqs) <= floor * slack + 1
    return len(seqs)


def test_fills_sequences(spark):
    rnd = random.Random(1)
    check(spark, [rnd.randint(1, 1024) for _ in range(400)], 1024, 1.05)
    check(spark, [300] * 150, 1024, 1.2)
    check(spark, [rnd.randint(1, 20) for _ in range(300)], 1024, 1.3)
    assert check(spark, [8, 4, 4, 2, 2, 2, 2, 1, 7], 8, 1.0) == 4


def test_pieces_of_documents(spark):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [None, "", "short text", "a b c " * 900, "é  x\n\n y " * 50, "short text"]
    out = packing.pack(frame(spark, [doc(i, t) for i, t in enumerate(texts)] + [doc(None, "null id"), doc(2, "short text")]), path).collect()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: (r["piece"], r["sequence_id"]))
        if i == 2:
            assert len(mine) == 2
            mine = mine[:1]
        assert [x for r in mine for x in r["ids"]] == ids
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1])
        assert all(r["length"] == 1024 for r in mine[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    assert sum(r["doc_id"] is None for r in out) == 1


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), public.path("byte_bpe_50k.json")).count() == 0
