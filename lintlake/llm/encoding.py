"""Token ids of whole texts with a public tokenizer, remembered per white-space piece.

Both public BPE files pre-tokenise at white space: no token ever spans from one run of non-space bytes into the next, save
that the byte-level one glues a space to the word behind it.  So a text's ids are the concatenation of its pieces' ids,
where a piece is a word (word-level file) or a white-space run with the word behind it (byte-level file).  Every distinct
piece of a task is encoded once by the ``tokenizers`` library; texts with white space outside ASCII, whose runs may mix
with ASCII ones, and texts that hold the string of an added token go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from lintlake.llm.textbuf import BYTE_CODE, IS_SPACE, chunks, prefix_sums, ranges, span_hash

MEMO = 2_000_000  # pieces remembered by a worker (about 80 MB); a cache bound only, it changes no result
RECENT = 100_000  # pieces kept in a dict before they are merged into the sorted table
# First bytes (pairs) of UTF-8 white space outside ASCII: U+0085, U+00A0, U+1680, U+2000-2029, U+205F, U+3000.
_WIDE_SPACE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


class Encoder:
    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Strings of added tokens are cut out of a text before white space counts, so texts that hold one go to the library whole.
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        self.width = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted fingerprints of the pieces, and their slots
        self.slots = np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.n = self.used = 0
        self.flat = np.zeros(1 << 20, self.width)
        self.start = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            slot[hit] = self.slots[at[hit]]
        miss = np.flatnonzero(slot < 0)
        if len(miss) and self.recent:
            slot[miss] = [self.recent.get(k, -1) for k in keys[miss].tolist()]
        return slot

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        on = ~IS_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        edge = first[:n].copy()
        if self.keeps_space:  # a piece begins where white space begins
            edge[1:] |= ~on[1:] & on[:-1]
            start = np.flatnonzero(edge)
            end = np.append(start[1:], n)
        else:
            begin = on.copy()
            begin[1:] &= ~on[:-1] | first[1:n]
            stop = on.copy()
            stop[:-1] &= ~on[1:] | first[1:n]
            start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return start, end, np.searchsorted(off, start, side="right") - 1

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encodes new pieces and remembers them in slots n, n + 1, ..."""
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(x) for x in found], dtype=np.int32)
        total = int(n.sum())
        while self.n + len(n) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), self.width, total)
        self.start[self.n : self.n + len(n)] = self.used + np.cumsum(n) - n
        self.count[self.n : self.n + len(n)] = n
        self.recent.update(zip(keys.tolist(), range(self.n, self.n + len(n)), strict=True))
        self.used += total
        self.n += len(n)
        if len(self.recent) > RECENT:
            k = np.concatenate([self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
            v = np.concatenate([self.slots, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
            o = np.argsort(k)
            self.keys, self.slots, self.recent = k[o], v[o], {}

    def encode_chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[off[i]:off[i + 1]]."""
        rows = len(off) - 1
        start, end, row = self._pieces(data, off) if len(data) else (np.zeros(0, np.int64),) * 3
        if len(start) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        code, uniq = pd.factorize(span_hash(prefix_sums(data, BYTE_CODE), start, end))
        if self.n + len(uniq) > max(MEMO, len(uniq)):
            self._clear()
        slot = self._find(uniq)
        new = np.flatnonzero(slot < 0)
        if len(new):
            at = np.zeros(len(uniq), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]  # first place of each distinct piece
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            slot[new] = np.arange(self.n, self.n + len(new))
            self._learn(uniq[new], texts)
        piece = slot[code]
        n = self.count[piece]
        ids = self.flat[np.repeat(self.start[piece], n) + ranges(n)].astype(np.uint32)
        out = np.zeros(rows + 1, np.int64)
        np.cumsum(np.bincount(row, weights=n, minlength=rows).astype(np.int64), out=out[1:])
        return ids, out

    def batches(self, col: pa.Array, end_id: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of successive runs of rows; ``end_id`` closes every text."""
        for i, j, data, off in chunks(col):
            wide = np.zeros(j - i, bool)
            if len(data) > 1:
                hit = np.zeros(len(data) - 1, bool)
                for a, b in _WIDE_SPACE:
                    hit |= (data[:-1] == a) & (data[1:] == b)
                wide[np.searchsorted(off, np.flatnonzero(hit), side="right") - 1] = True
            raw = data.tobytes()
            for token in self.added:
                at = raw.find(token)
                while at >= 0:
                    wide[np.searchsorted(off, at, side="right") - 1] = True
                    at = raw.find(token, at + 1)
            if wide.any():
                parts = []
                for r in range(j - i):
                    part = data[off[r] : off[r + 1]]
                    parts.append(self.whole(part.tobytes().decode("utf-8")) if wide[r] else self.encode_chunk(part, np.array([0, len(part)]))[0])
                ids, n = np.concatenate(parts), np.array([len(p) for p in parts])
            else:
                ids, o = self.encode_chunk(data, off)
                n = np.diff(o)
            if end_id is not None:
                closed = np.full(len(ids) + len(n), end_id, np.uint32)
                closed[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                ids, n = closed, n + 1
            out = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=out[1:])
            yield i, j, ids, out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder a worker process."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_space)
    return _ENCODERS[key]


def forget() -> None:
    """Drops the tokenizers and pieces that this worker remembers; they come back when they are needed."""
    _ENCODERS.clear()
