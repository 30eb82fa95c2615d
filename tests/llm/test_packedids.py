import zlib

import numpy as np
import pytest
from helpers import doc, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import packedids as P

public = pytest.importorskip("public_tokenizers")


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.integers(0, 2**32 - 1))
def test_bits_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    raw = P.pack_bits(ids, bits)
    assert len(raw) == -(-n * bits // 8) and (P.unpack_bits(raw, n, bits) == ids).all()


def test_random_access(tmp_path):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(3)
    for bits, block in ((16, 8), (13, 8), (13, 5)):
        counts = rng.integers(0, 9, 40)
        ids = rng.integers(0, 1 << bits, counts.sum()).astype(np.uint32)
        path = tmp_path / f"{bits}-{block}.ids"
        path.write_bytes(b"".join(P.file_bytes([None, *range(1, 40)], counts, ids, bits, block)))
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            h, offsets, docs, first, null = P.read_header(f)
            assert null[0] and docs[1] == 1 and (first == np.cumsum(counts) - counts).all()
            for a, z in ((0, len(ids)), (3, 4), (7, 30), (5, 5), (len(ids) - 1, len(ids))):
                assert (P.read_ids(f, h, offsets, a, z) == ids[a:z]).all()


def test_round_trip_of_documents(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    data = [doc(5, "Hello World, it's x"), doc(3, None), doc(9, ""), doc(-2, "ÀB́ C d  e　f"), doc(7, "word " * 5000), doc(None, "null id"), doc(5, "Hello World, it's x")]
    df = frame(spark, data)
    folder = P.new_folder(df)
    out = P.digest(P.write(df, folder, path, 49408, file_ids=64), folder).collect()
    assert len(out) == len(data)
    want, at = [], 0
    for i, t in sorted(((d[0], d[1]) for d in data), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"])) for r in out)
    empty = frame(spark, [])
    folder = P.new_folder(empty)
    assert P.digest(P.write(empty, folder, path, 49408), folder).count() == 0


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_as_in_the_plain_call(name, keeps_space):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lintlake.llm.encoding import Encoder

    path = public.path(name)
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain words", None, "x<|endoftext|><|endoftext|>", "<|startoftext|> y", "<|ENDOFTEXT|> <|endoftext", "|> z", "", "  <|endoftext|>\n c"]
    got = []
    for _, _, ids, off in Encoder(path, keeps_space).batches(pa.array(texts), None):
        got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
