"""Benchmark decontamination by a distributed positional inverted index.

1. *Index.*  Documents are cut into segments, runs of whole texts of about ``SEGMENT`` bytes.  A segment is one row: its
   documents, and for every term (fingerprint of a lower-cased word) the ascending list of its positions.  Segments are
   written once and shared by any number of searches; no posting is ever shuffled.
2. *Search.*  The benchmark's distinct windows (``window`` consecutive words; a shorter item is one window) are sent to the
   segments in blocks of at most ``BLOCK`` (window, item) pairs.  A window that lacks a term in a segment is dropped
   there.  For the rest, the list of the rarest term, less the term's offset, gives the possible starts; every further
   list, rarest first, is intersected at its own offset.  What is left are exact phrases.
3. *Proximity.*  With ``slop``, a window is near in a document if ``slop`` consecutive words of it hold all the window's
   distinct terms, in any order; the lists are the same, and only runs around the rarest term are tried.
4. *Memory.*  Index and searches are jobs of their own that hand the Python workers about ``HANDED`` bytes at a time and read
   few rows at once, so a task holds a few segments, whatever the size of its partition.  A search writes what it found.

Every row of ``docs`` gives one row, repeated ids too.  Defined results: null, empty or wordless texts have no words and no
hits; null or wordless items have no window; items of equal id are one item; a null item id counts as empty text; an empty
table of documents gives an empty result, an empty benchmark no hits; very long texts are a segment of their own; extra
columns of both inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import keep
from lintlake.llm.textbuf import LOWER, LOWER_CODE, chunks, prefix_sums, ranges, signed, span_hash, words
from lintlake.session import remove, settings, steps

SEGMENT = 2 << 20  # bytes of text in a segment
BLOCK = 1 << 17  # (window, item) pairs sent to the segments at once: at most 20 MB
HANDED = 4 << 20  # bytes after which a batch of rows is handed to a worker
READ = 256, 4  # documents and segments read at once
# Row groups of a few segments; without the second, a writer looks at its size after a hundred rows at first.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
STARTS = 1 << 21  # possible starts held at once in a task
# Words are runs of letters, digits and non-ASCII characters; every byte of a non-ASCII character is at least 0x80.
SEPARATOR = np.array([b < 0x80 and not (chr(LOWER[b]).isalnum()) for b in range(256)])


def _list(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term of every word, words before every text)."""
    start, end, row = words(data, off, SEPARATOR)
    return signed(span_hash(prefix_sums(data, LOWER_CODE), start, end)), np.searchsorted(row, np.arange(len(off))).astype(np.int32)


def _bounded(df: DataFrame, rows: int):
    """Jobs inside read so many rows at once and hand over about ``HANDED`` bytes at a time."""
    return settings(df.sparkSession, execution__arrow__maxBytesPerBatch=str(HANDED), parquet__columnarReaderBatchSize=str(rows))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written segments: (segment, docs, bases, terms, starts, positions).

    ``bases[i]`` is the number of words of the segment before document i (one more entry closes the last); the positions of
    ``terms[t]``, counted over the segment, are ``positions[starts[t]:starts[t + 1]]``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column("text"), SEGMENT):
                term, base = _terms(data, off)
                order = np.argsort(term, kind="stable")  # positions stay ascending within a term
                sorted_terms = term[order]
                first = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1])) if len(term) else np.zeros(0, np.int64)
                ids = b.column("id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids), _list([0, len(base)], base), _list([0, len(first)], sorted_terms[first]),
                     _list([0, len(first) + 1], np.append(first, len(term)).astype(np.int32)), _list([0, len(order)], order.astype(np.int32))],
                    names=["docs", "bases", "terms", "starts", "positions"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"docs array<{id_type}>, bases array<int>, terms array<long>, starts array<int>, positions array<int>")
    with _bounded(docs, READ[0]):
        return keep(out.withColumn("segment", F.monotonically_increasing_id()), "postings", **SMALL_GROUPS)


def windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (win, item): the terms of a window as little-endian 64-bit numbers, and the item's id as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column("text")):
                term, base = _terms(data, off)
                n = np.diff(base)
                count = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
                at = np.repeat(base[:-1], count) + ranges(count)
                size = np.minimum(np.repeat(n, count), window)
                raw = term.tobytes()
                wins = [raw[8 * a : 8 * (a + s)] for a, s in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), b.column("id").slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), count)))], names=["win", "item"])

    given = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return keep(given.mapInArrow(cut, "win binary, item string").distinct(), "windows")


class Windows:
    """A block of windows: terms padded to the longest, and the items of each."""

    def __init__(self, pairs: pa.Table):
        win, wid = np.unique(np.array([w.as_py() for w in pairs.column("win")], object), return_inverse=True)
        self.items, item = np.unique(np.array(pairs.column("item").to_pylist(), object), return_inverse=True)
        self.size = np.array([len(w) // 8 for w in win], np.int64)
        self.terms = np.zeros((len(win), max(self.size, default=1)), np.int64)
        for k, w in enumerate(win):
            self.terms[k, : len(w) // 8] = np.frombuffer(w, np.int64)
        order = np.argsort(wid, kind="stable")
        self.of, self.item_at = item[order], np.searchsorted(wid[order], np.arange(len(win) + 1))

    def items_of(self, doc: np.ndarray, win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) of matches, ascending."""
        pair = np.unique(doc * len(self.size) + win)
        doc, win = np.divmod(pair, max(1, len(self.size)))
        n = self.item_at[win + 1] - self.item_at[win]
        pair = np.unique(np.repeat(doc, n) * len(self.items) + self.of[np.repeat(self.item_at[win], n) + ranges(n)])
        return np.divmod(pair, max(1, len(self.items)))


class Segment:
    """The posting lists of one segment."""

    def __init__(self, bases: np.ndarray, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray):
        self.bases, self.terms, self.starts, self.positions = bases.astype(np.int64), terms, starts.astype(np.int64), positions
        self.n = int(self.bases[-1]) + 1
        # All lists as one ascending array: membership in any list is one binary search.
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(self.starts)) * self.n + positions

    def lists(self, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows of which every term is here, their lists, their offsets), rarest list first, no list last."""
        if not len(self.terms) or not len(w.size):
            none = np.zeros((0, 1), np.int64)
            return none[:, 0], none, none
        at = np.minimum(np.searchsorted(self.terms, w.terms), len(self.terms) - 1)
        used = np.arange(w.terms.shape[1]) < w.size[:, None]
        win = np.flatnonzero(((self.terms[at] == w.terms) | ~used).all(axis=1))
        at, used = at[win], used[win]
        length = np.where(used, (self.starts[1:] - self.starts[:-1])[at], np.iinfo(np.int64).max)
        order = np.argsort(length, axis=1, kind="stable")
        return win, np.take_along_axis(np.where(used, at, -1), order, 1), order

    def document(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, pos, side="right") - 1

    def rarest(self, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``lists``, position) of the rarest terms, at most about ``STARTS`` at once."""
        first = lists[:, 0]
        n = self.starts[first + 1] - self.starts[first]
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STARTS, side="right")))
            yield np.repeat(np.arange(i, j), n[i:j]), self.positions[np.repeat(self.starts[first[i:j]], n[i:j]) + ranges(n[i:j])].astype(np.int64)
            i = j

    def phrases(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence inside a document."""
        win, lists, offset = self.lists(w)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row, pos in self.rarest(lists):
            start = pos - offset[row, 0]
            end = start + w.size[win[row]]
            doc = self.document(pos)
            fits = (start >= self.bases[doc]) & (end <= self.bases[doc + 1])
            row, start = row[fits], start[fits]
            for k in range(1, lists.shape[1]):
                has = lists[row, k] >= 0
                key = lists[row, k] * self.n + start + offset[row, k]
                in_list = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                row, start = row[in_list | ~has], start[in_list | ~has]
            found.append((win[row], start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _within(self, lists: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of every window, whether all its lists have a position from ``lo`` to ``hi``."""
        good = np.ones(len(row), bool)
        for k in range(lists.shape[1]):
            todo = np.flatnonzero(good & (lists[row, k] >= 0))
            at = lists[row[todo], k] * self.n
            i = np.minimum(np.searchsorted(self.keys, at + lo[todo]), len(self.keys) - 1)
            good[todo] = (self.keys[i] >= at + lo[todo]) & (self.keys[i] <= at + hi[todo])
        return good

    def near(self, w: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where ``slop`` consecutive words of a document hold all its terms."""
        win, lists, _ = self.lists(w)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row, pos in self.rarest(lists):
            # First whether all terms are around the rarest one at all, then every run of words that holds it.
            for tries, reach in ((1, 2 * slop - 1), (slop, slop)):
                doc = self.document(pos)
                first = np.repeat(pos, tries) - slop + 1 + np.tile(np.arange(tries), len(pos))
                lo, hi = np.maximum(first, np.repeat(self.bases[doc], tries)), np.minimum(first + reach, np.repeat(self.bases[doc + 1], tries)) - 1
                good = self._within(lists, np.repeat(row, tries), lo, hi).reshape(-1, tries).any(axis=1)
                row, pos = row[good], pos[good]
            found.append((win[row], pos))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _search(segments: DataFrame, w: Windows, slop: int | None, every: bool = True) -> DataFrame:
    """One written row per document, or per document with a hit: (segment, i, doc, n_words, begins, ends, items, near_items) for a block of windows."""
    id_type = segments.schema["docs"].dataType.elementType.simpleString()

    def grouped(doc: np.ndarray, value: pa.Array, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(w.items.tolist(), pa.string())
        for b in batches:
            for r in range(b.num_rows):
                bases, terms, starts, positions = (b.column(c)[r].values.to_numpy() for c in ("bases", "terms", "starts", "positions"))
                s = Segment(bases, terms, starts, positions)
                n = len(bases) - 1
                win, start = s.phrases(w)
                # Words under any occurrence, then their runs; a run ends with its document.
                cover = np.cumsum(np.bincount(start, minlength=s.n) - np.bincount(start + w.size[win], minlength=s.n))[:-1] > 0
                edge = np.zeros(s.n, bool)
                edge[s.bases[:-1]] = True
                begin = np.flatnonzero(cover & (edge[:-1] | ~np.append(False, cover[:-1])))
                end = np.flatnonzero(cover & (np.append(edge[1:-1], True) | ~np.append(cover[1:], False))) + 1
                doc = s.document(begin)
                d, item = w.items_of(s.document(start), win)
                close, pos = s.near(w, slop) if slop is not None else (win[:0], start[:0])
                nd, near = w.items_of(s.document(pos), close)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column("segment")[r].as_py()), pa.int64()), pa.array(np.arange(n), pa.int32()), b.column("docs")[r].values, pa.array(np.diff(s.bases)),
                     grouped(doc, pa.array(begin - s.bases[doc]), n), grouped(doc, pa.array(end - s.bases[doc]), n), grouped(d, names.take(pa.array(item)), n), grouped(nd, names.take(pa.array(near)), n)],
                    names=["segment", "i", "doc", "n_words", "begins", "ends", "items", "near_items"])

    found = segments.select("segment", "docs", "bases", "terms", "starts", "positions").mapInArrow(
        run, f"segment long, i int, doc {id_type}, n_words long, begins array<long>, ends array<long>, items array<string>, near_items array<string>")
    with _bounded(segments, READ[1]):
        return keep(found if every else found.filter((F.size("items") > 0) | (F.size("near_items") > 0)), "found")


def _merged(found: DataFrame) -> DataFrame:
    """The blocks' rows as one per document: united items, united spans."""
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))))
    out = found.groupBy("segment", "i").agg(F.first("doc").alias("doc"), F.max("n_words").alias("n_words"), spans.alias("s"), flat("items").alias("items"), flat("near_items").alias("near_items"))
    # Spans in order of their begins: one begins anew where it lies beyond the furthest end so far.
    fold = F.aggregate(
        "s", F.expr("cast(array() as array<struct<begins: bigint, ends: bigint>>)"),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["ends"] < x["begins"]), F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begins"].alias("begins"), F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends"))))))
    return out.withColumn("s", fold).select("segment", "i", "doc", "n_words", F.col("s.begins").alias("begins"), F.col("s.ends").alias("ends"), "items", "near_items")


def search(segments: DataFrame, pairs: DataFrame, slop: int | None = None) -> DataFrame:
    """One row per indexed document: (doc, n_words, n_hit, begins, ends, items, near_items).

    ``begins`` / ``ends`` are the runs of hit words; ``items`` the ids, sorted, of the items of which a window occurs;
    ``near_items`` those of which a window is near by ``slop`` (none without it).
    """
    n = max(1, -(-pairs.count() // BLOCK))
    blocks = (Windows(pairs.filter(F.pmod(F.xxhash64("win", "item"), F.lit(n)) == k).toArrow()) for k in range(n))
    if n == 1:
        out = _search(segments, next(blocks), slop)
    else:
        rest = _search(segments, Windows(pairs.limit(0).toArrow()), None)
        out = _merged(reduce(DataFrame.unionByName, [rest, *(_search(segments, w, slop, every=False) for w in blocks)]))
    n_hit = F.aggregate(F.zip_with("begins", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select("doc", "n_words", n_hit.alias("n_hit"), "begins", "ends", F.sort_array("items").alias("items"), F.sort_array("near_items").alias("near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """``search`` of all windows of ``benchmark`` in all ``docs``, with ``doc_id`` and ``contaminated`` (any word is hit)."""
    with steps() as passing:
        segments, pairs = index(docs), windows(benchmark, window)
    out = search(segments, pairs, slop)
    remove(docs.sparkSession, passing)
    return out.withColumnRenamed("doc", "doc_id").withColumn("contaminated", F.col("n_hit") > 0)
