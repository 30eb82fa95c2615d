"""Exact Jaccard join on word shingles with prefix filters under several global token orders.

A document's set is its distinct shingles of ``width`` words (A-Z lower-cased words; a shorter text is one shingle).  Two
documents link when 100 * |A ∩ B| >= percent * |A ∪ B|.

* *Global orders.*  Any total order of shingles gives an exact prefix filter: linked sets share a shingle among the first
  ``n - ceil(percent * n / 100) + 1`` of each.  All orders here put rare shingles first (frequent ones, found by an exact
  pigeonhole over blocks of text, go last, and shingles of common words only go before them) and differ in the hash that
  orders equals.  A pair is a candidate when it shares prefix tokens under *every* order, its sizes are compatible, and
  the counts of its sets over 64 hash buckets differ by no more than a linked pair's may.  Candidates are verified on
  whole sets, which are shipped once for a neighbourhood of pairs, not once for every pair.
* *Groups of copies.*  Equal sets are one node.  Large groups of near copies are linked by rounds of stars: every token's
  documents are tested against one seeded pivot, and documents that are already connected need no further test, as the
  result is connectivity.  When few pairs between different components are left, or a round no longer halves them, all
  remaining pairs across components are tested, in blocks.  No pair is left out, and none inside a component is made.
* *Every link.*  Links lie inside components.  Where their number is asked for (``every_link``), all pairs of distinct sets of
  a component are tested on whole sets, block against block, and each block pair returns one count per set; where the pairs
  themselves are asked for (``similar``) there are no stars, and all pairs that pass the filters are tested and listed.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component;
repeated rows and equal sets share a component; null ids take part (a component of null ids alone is null); an empty
table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import carried, keep, partitions, restored
from lintlake.llm.textbuf import U, chunks, mix, ranges, signed, word_hashes
from lintlake.operators.components import connected_components
from lintlake.session import released, remove, steps

BUCKETS = 64
BLOCK_BYTES = 16 << 20  # text per block of the frequency scan
SLICES = 16  # parts in which a block's hashes are sorted
HOT_SHARE = 1 / 500  # shingles in at least this share of a block's documents are frequent
COMMON_SHARE = 1e-5  # words with at least this share of a block's words are common: at most 100,000 words
GROUP = 128  # documents of a token that meet in one task
STEP = 2048
ITEMS = 1 << 18  # shingles of a block of a component's sets: 2 MB
CELL_ITEMS = 1 << 20  # hashes of a block of a place of candidate pairs: 8 MB
COLUMNS = 1 << 13  # distinct shingles compared at once
BROADCAST_ROWS = 1 << 21  # wanted documents are broadcast up to this many ids (16 MB), joined by shuffle beyond
BROADCAST_CELLS = 1 << 18  # the same for rows of cells (some 100 bytes each)
ORDERS = (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179))


def shingles(words: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, first word) of all shingles of ``width`` words; shorter texts give one shingle of all their words."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    parts, owners, places = [], [], []
    if len(words) >= width:
        h = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            h = mix(h * U(5) + words[k : len(words) - width + 1 + k])
        whole = row[: len(h)] == row[width - 1 :]
        parts.append(mix(h[whole] + U(width)))
        owners.append(row[: len(h)][whole])
        places.append(np.flatnonzero(whole))
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        if len(short):
            h = words[first[short]].copy()
            for i in range(1, k):
                h = mix(h * U(5) + words[first[short] + i])
            parts.append(mix(h * U(3) + U(k)))
            owners.append(short)
            places.append(first[short])
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    return np.concatenate(parts), np.concatenate(owners), np.concatenate(places)


def counted(parts: list[np.ndarray], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the k-th slice that occur ``least`` times or more, by their highest bits."""
    h, n = np.unique(np.concatenate([x[x // U((1 << 64) // SLICES) == U(k)] for x in parts]), return_counts=True)
    return h[n >= least], n[n >= least]


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequent shingles, their counts, common words), sorted.

    A shingle or word over the share in the corpus is over it in some block, so every block reports those over the share
    in it; sizes are bounded by the shares, not by the corpus.
    """
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        grams: list[np.ndarray] = []
        docs_ = size = 0

        def report() -> Iterator[pa.RecordBatch]:
            for kind, parts, least in ((0, grams, max(3, HOT_SHARE * docs_)), (1, words, max(3, COMMON_SHARE * sum(map(len, words))))):
                # A slice of the hashes at a time: sorting a whole block takes several copies of it.
                h, n = map(np.concatenate, zip(*(counted(parts, k, least) for k in range(SLICES)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(signed(h)), pa.array(n)], schema=schema)

        for b in batches:
            for i, j, data, off in chunks(b.column(0)):
                w, _, _, row = word_hashes(data, off)
                s, _, _ = shingles(w, row, j - i, width)
                words.append(w)
                grams.append(s)
                docs_, size = docs_ + j - i, size + len(data)
                if size >= BLOCK_BYTES:
                    yield from report()
                    words, grams, docs_, size = [], [], 0, 0
        if docs_:
            yield from report()

    found = docs.select("text").mapInArrow(scan, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    t = found.toArrow()  # bounded by the shares
    kind, h, n = (t.column(c).to_numpy() for c in ("kind", "h", "n"))
    h = h.view(np.uint64)
    hot = np.argsort(h[kind == 0])
    return h[kind == 0][hot], n[kind == 0][hot], np.sort(h[kind == 1])


def _in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(table) == 0:
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def _sets(data: np.ndarray, off: np.ndarray, rows: int, width: int):
    """Distinct (row, shingle) sorted, with the first word's place, the words, and per row: size, start and 128-bit id."""
    w, _, _, row = word_hashes(data, off)
    s, own, at = shingles(w, row, rows, width)
    order = np.lexsort((s, own))
    s, own, at = s[order], own[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    s, own, at = s[new], own[new], at[new]
    n = np.bincount(own, minlength=rows)
    first = np.cumsum(n) - n
    ids = []
    for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ salt))])
        ids.append(mix(total[first + n] - total[first]))
    return s, own, at, w, n, first, ids


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(th, doc_id, n, s1, s2, counts, p1, p2): text hash, set size, set id, bucket counts and the prefix under each order."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))
    schema = pa.schema([("th", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("counts", pa.list_(pa.int16())),
                        ("p1", pa.list_(pa.int64())), ("p2", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_, frequent_n, common_ = hot.value
        for b in batches:
            doc = b.column("doc_id")
            for i, j, data, off in chunks(b.column("text")):
                rows = j - i
                s, own, at, w, n, first, ids = _sets(data, off, rows, width)
                is_common, _ = _in(common_, w)
                run = np.concatenate([[0], np.cumsum(is_common)])
                words = np.minimum(at + width, len(w))
                plain = run[words] - run[at] == words - at  # common words only
                is_hot, where = _in(frequent_, s)
                rank = plain.astype(np.uint64)
                rank[is_hot] = 2 + np.minimum(np.log2(frequent_n[where[is_hot]]), 60).astype(np.uint64)
                p = n - (n * percent + 99) // 100 + 1
                lists = []
                for salt in ORDERS:
                    key = (rank << U(56)) | (mix(s + salt) >> U(8))
                    o = np.lexsort((key, own))
                    pick = o[np.arange(len(o)) - first[own] < p[own]]  # rows keep their places: o sorts by own first
                    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, p, 0))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(s[pick]))))
                c = np.minimum(np.bincount(own * BUCKETS + (s >> U(58)).astype(np.int64), minlength=rows * BUCKETS), (1 << 15) - 1)  # capped counts only bring sets closer
                fixed = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BUCKETS + 1, BUCKETS, dtype=np.int32)), pa.array(c.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([b.column("th").slice(i, rows), doc.slice(i, rows), pa.array(n), pa.array(signed(ids[0])), pa.array(signed(ids[1])), fixed, *lists], schema=schema)

    ddl = "doc_id long, n long, s1 long, s2 long, counts array<short>, p1 array<long>, p2 array<long>"
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return keep(texts.mapInArrow(sign, "th long, " + ddl), "ngram-signatures")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, items): the whole sets of the wanted (cid, rep, s1, s2) documents."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("items", pa.list_(pa.int64()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column(0)):
                s, _, _, _, n, first, ids = _sets(data, off, j - i, width)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(s)).astype(np.int32)), pa.array(signed(s)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(ids[0])), pa.array(signed(ids[1])), lists], schema=schema)

    keys = wanted.select(F.col("rep").alias("_rep")).distinct()
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(keys, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    sets = texts.mapInArrow(load, "s1 long, s2 long, items array<long>")
    return sets.join(wanted.select("cid", "s1", "s2"), ["s1", "s2"]).groupBy("cid").agg(F.first("items").alias("items"))


def open_tokens(g: DataFrame) -> DataFrame:
    """The rows of tokens whose documents are in several components: no other token has a pair across components, now or later."""
    spread = g.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("token")
    return g.join(spread, "token", "left_semi")


def dealt(g: DataFrame) -> DataFrame:
    """The rows (token, cid, c) of open tokens with the token's ``blocks``, each the component it is for, or -1 if it is for all small ones, and ``blk``, the row's own."""
    parts = g.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token", F.when(F.col("k") > GROUP // 2, F.col("c")).otherwise(-1).alias("c")).agg(F.sum("k").alias("k"))
    own = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("k") / F.lit(GROUP))), lambda _: F.col("c"))
    blocks = parts.groupBy("token").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("c0"), F.array_sort(F.flatten(F.collect_list(own))).alias("blocks")).filter("kinds > 1 OR c0 < 0")
    rows = g.join(blocks.drop("kinds", "c0"), "token").withColumn("bc", F.when(F.array_contains("blocks", F.col("c")), F.col("c")).otherwise(-1))
    mine = F.size(F.filter("blocks", lambda b: b == F.col("bc")))
    return rows.withColumn("blk", F.array_position("blocks", F.col("bc")) - 1 + F.pmod(F.xxhash64("cid"), mine)).drop("bc")


def near_pairs(g: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs across components that share a prefix token and pass the size, position and bucket filters.

    A token's documents are dealt into blocks of about ``GROUP`` and every two blocks meet in a task of their own, so a large
    group is spread and only pairs that pass the filters leave a task.  Components of a block or more have blocks of their
    own, which do not meet each other: a document is sent only where it can have a pair across components.
    """
    rows = dealt(g).join(traits.select("cid", "counts"), "cid")
    rows = rows.select("token", "cid", "n", "i", "c", "counts", "blk", F.posexplode("blocks").alias("x", "bc")).filter("bc < 0 OR bc <> c")
    rows = rows.select("token", F.least("blk", "x").alias("lo"), F.greatest("blk", "x").alias("hi"), "blk", "cid", "n", "i", "c", "counts")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        token, lo, hi, blk, cid, n, i, c = (t.column(k).to_numpy() for k in ("token", "lo", "hi", "blk", "cid", "n", "i", "c"))
        counts = t.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS)
        new = np.append(True, (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        end = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1]
        left_a, left_b = [], []
        for s in range(0, len(token), STEP):  # pairs of a few rows at a time
            r = np.arange(s, min(s + STEP, len(token)))
            k = end[r] - r - 1
            a = np.repeat(r, k)
            b = a + 1 + ranges(k)
            ok = (c[a] != c[b]) & ((lo[a] == hi[a]) | (blk[a] != blk[b]))
            a, b = a[ok], b[ok]
            need = -(-percent * (n[a] + n[b]) // (100 + percent))
            ok = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent) & (np.minimum(n[a] - i[a], n[b] - i[b]) >= need)
            a, b, need = a[ok], b[ok], need[ok]
            apart = np.abs(counts[a].astype(np.int32) - counts[b]).sum(1)
            ok = apart <= n[a] + n[b] - 2 * need
            left_a.append(cid[a[ok]])
            left_b.append(cid[b[ok]])
        a, b = np.concatenate(left_a), np.concatenate(left_b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            token, lo, hi = (t.column(k).to_numpy() for k in ("token", "lo", "hi"))
            cut = np.flatnonzero((token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            held = t
            if len(cut) and cut[-1] >= 4096:
                yield pairs_of(t.slice(0, int(cut[-1])))
                held = t.slice(int(cut[-1]))
        if held is not None and held.num_rows:
            yield pairs_of(held)

    spread = rows.repartition(partitions(g.sparkSession), "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return spread.mapInArrow(meet, "a long, b long").distinct()


def cells(pairs: DataFrame, sized: DataFrame) -> DataFrame:
    """(cid, place, lo, hi, partners): where the pairs (a, b) are tested; ``partners`` are the nodes b of the pairs (cid, b) of a cell.

    A pair's place is the smallest node in reach of two or three pairs, so the pairs of a group of near copies share one.  A place's nodes are dealt into blocks of about ``CELL_ITEMS`` hashes (``sized``: (cid, n)), and every two blocks with a
    pair are a cell.
    """
    two = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = two.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    least = keep(two.join(near.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m")), "ngram-places")
    p = pairs.join(least.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a").join(least.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
    p = p.select("a", "b", F.least("ma", "mb").alias("place"))
    ends = p.select("place", F.explode(F.array("a", "b")).alias("cid")).distinct().join(sized, "cid")
    blocks = ends.groupBy("place").agg(F.ceil(F.sum("n") / F.lit(CELL_ITEMS)).alias("blocks"))
    p = p.join(blocks, "place").withColumns({"x": F.pmod(F.xxhash64("a"), F.col("blocks")), "y": F.pmod(F.xxhash64("b"), F.col("blocks"))})
    sides = F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("other")), F.struct(F.col("b").alias("cid"), F.lit(None).cast("long").alias("other")))
    p = p.select("place", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), F.explode(sides).alias("s"))
    return p.groupBy(F.col("s.cid").alias("cid"), "place", "lo", "hi").agg(F.collect_list("s.other").alias("partners"))


def placed_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, place, lo, hi, partners, items): the rows of ``cells`` with their whole sets, made from the text of the document
    (rep, s1, s2); repeated documents give repeated rows."""
    schema = pa.schema([("cid", pa.int64()), ("place", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("partners", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in chunks(b.column("text")):
                s, _, _, _, _, first, ids = _sets(data, off, j - i, width)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(s)).astype(np.int32)), pa.array(signed(s)))
                rows = b.slice(i, j - i)
                mine = (signed(ids[0]) == rows.column("s1").to_numpy()) & (signed(ids[1]) == rows.column("s2").to_numpy())
                yield pa.RecordBatch.from_arrays([*(rows.column(k).cast(schema.field(k).type) for k in schema.names[:-1]), lists], schema=schema).filter(pa.array(mine))

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    if wanted.count() <= BROADCAST_CELLS:
        wanted = F.broadcast(wanted)
    else:
        keys = wanted.select(F.col("rep").alias("_rep")).distinct()
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        texts = texts.join(keys, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("rep"))).select("text", "s1", "s2", *schema.names[:-1])
    return texts.mapInArrow(load, "cid long, place long, lo long, hi long, partners array<long>, items array<long>")


def _lists(t: pa.Table, name: str, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(items, ends): the lists of a column one after the other, each in ascending order, and where they end, from 0."""
    col = t.column(name).combine_chunks()
    items, ends = col.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(col.value_lengths().to_numpy()))
    if not ordered:
        items = items[np.lexsort((items, np.repeat(np.arange(len(col)), np.diff(ends))))]
    return items, ends


def _shared(items: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs (a, b) of non-empty lists; pairs of an a stand together."""
    out = np.zeros(len(a), np.int64)
    n = np.diff(ends)
    at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(a)], strict=True) if len(a) else ():
        mine, k = items[ends[a[i]] : ends[a[i] + 1]], n[b[i:j]]
        theirs = items[np.repeat(ends[b[i:j]], k) + ranges(k)]
        out[i:j] = np.add.reduceat(_in(mine, theirs)[0].astype(np.int64), np.cumsum(k) - k)
    return out


def met(rows: DataFrame, payload: list[str], test: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): the pairs of the rows of ``cells`` that pass ``test`` (rows with ``payload``, places of the a and of the b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tested(t: pa.Table) -> pa.RecordBatch:
        place, lo, hi, cid = (t.column(k).to_numpy() for k in ("place", "lo", "hi", "cid"))
        cell = np.cumsum(np.append(False, (place[1:] != place[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        once = np.append(True, (cell[1:] != cell[:-1]) | (cid[1:] != cid[:-1]))  # repeated documents
        if not once.all():
            t, cell, cid = t.filter(pa.array(once)), cell[once], cid[once]
        known, at = np.unique(cid, return_inverse=True)
        key = cell * len(known) + at
        partners = t.column("partners").combine_chunks()
        a = np.repeat(np.arange(len(cid)), partners.value_lengths().to_numpy())
        other = partners.flatten().to_numpy()
        there, at = _in(known, other)
        here, b = _in(key, cell[a] * len(known) + at)
        a, b = a[there & here], b[there & here]
        ok = test(t, a, b) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(cid[a[ok]]), pa.array(cid[b[ok]])], schema=schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            place, lo, hi = (t.column(k).to_numpy() for k in ("place", "lo", "hi"))
            cut = np.flatnonzero((place[1:] != place[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            held = t
            if len(cut):
                yield tested(t.slice(0, int(cut[-1])))
                held = t.slice(int(cut[-1]))
        if held is not None and held.num_rows:
            yield tested(held)

    key = ["place", "lo", "hi"]
    spread = rows.select(*key, "cid", "partners", *payload).repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "cid")
    return spread.mapInArrow(meet, "a long, b long")


def _classes(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b), written; the steps on the way are removed."""
    with steps() as passing:
        comp = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    out = keep(comp, "ngram-components")
    remove(links.sparkSession, passing)
    return out


def _join(docs: DataFrame, width: int, percent: int, every_link: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, nodes, links (a, b) of nodes): all links, or enough of them for the components."""
    with steps() as signed_:
        sig = signatures(docs, width, percent)
    some = sig.filter("n > 0")
    reps = keep(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "ngram-nodes")
    same = ["s1", "s2"]

    def of_reps(nodes: DataFrame, *cols: str) -> DataFrame:
        return some.select("doc_id", "s1", "s2", *cols).join(nodes.drop("n", "copies"), same).filter(F.col("doc_id").eqNullSafe(F.col("rep")))

    post = of_reps(reps, "p1", "n").select("cid", "n", F.posexplode("p1").alias("i", "token"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("token"))
    post = keep(post.withColumn("m", shared).filter("m > 1").drop("m").distinct(), "ngram-postings")
    shares = reps.join(post.select("cid").distinct(), "cid", "left_semi")
    traits = of_reps(shares, "counts", "p2", "n").groupBy(*same, "cid").agg(*[F.first(c).alias(c) for c in ("counts", "p2", "n")])  # repeated documents; dealt by their set already
    traits = keep(traits.drop(*same), "ngram-traits")
    sig = keep(sig.select("doc_id", "th", "n", *same), "ngram-sets")
    remove(docs.sparkSession, signed_)
    q = F.lit(percent)
    sizes = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * q)

    def close(t: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs share prefix tokens under the other order and their bucket counts allow a link."""
        n = t.column("n").to_numpy()
        counts = t.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS)
        need = -(-percent * (n[a] + n[b]) // (100 + percent))  # of shared shingles
        ok = np.concatenate([np.abs(counts[a[k : k + STEP]].astype(np.int32) - counts[b[k : k + STEP]]).sum(1) for k in range(0, len(a), STEP)]) <= n[a] + n[b] - 2 * need
        ok[ok] = _shared(*_lists(t, "p2", ordered=False), a[ok], b[ok]) > 0
        return ok

    def linked(t: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        items, ends = _lists(t, "items")
        n = np.diff(ends)
        inter = _shared(items, ends, a, b)
        return 100 * inter >= percent * (n[a] + n[b] - inter)

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct (a, b) pairs: prefix tokens under the other order, bucket counts, then whole sets."""
        sized = reps.select("cid", "n")
        prefix = reps.select("cid", F.ceil(F.col("n") * (100 - percent) / 100 + BUCKETS // 4).alias("n"))
        with steps() as passing:
            near = cells(keep(pairs, "ngram-pairs"), prefix)
            c = keep(met(near.join(traits, "cid"), ["n", "counts", "p2"], close), "ngram-candidates")
            wanted = keep(cells(c, sized).join(reps.select("cid", "rep", "s1", "s2"), "cid"), "ngram-wanted")
            placed = placed_sets(docs, wanted, width)
        out = keep(met(placed, ["items"], linked), "ngram-links")
        remove(docs.sparkSession, passing)
        return out

    def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of open tokens with their components by ``links``."""
        with steps() as passing:
            comp = _classes(links)
            found = rows.drop("c").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("c", F.coalesce("component", "cid")).drop("component")
            found = keep(found, "ngram-merged")
        out = keep(open_tokens(found), "ngram-grouped")
        remove(docs.sparkSession, passing)
        return out

    def open_pairs(g: DataFrame) -> int:
        parts = g.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
        per = parts.groupBy("token").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        with released(docs.sparkSession):
            return int(per.agg(F.sum((F.col("m") * F.col("m") - F.col("kk")) / 2)).first()[0] or 0)

    links: DataFrame | None = None
    g = post.withColumn("c", F.col("cid"))
    few = 2 * post.count()
    turn, waiting = 0, 0 if every_link else open_pairs(g)
    while waiting > few:
        mark = F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), F.col("cid").alias("pivot"), F.col("n").alias("pn"), F.col("c").alias("pc"))
        pivots = g.groupBy("token").agg(F.min(mark).alias("p"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("token", "p.*")
        star = g.join(pivots, "token").filter("c <> pc").withColumns({"na": F.col("n"), "nb": F.col("pn")}).filter(sizes)
        star = star.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        new = verified(star)
        links = new if links is None else links.unionByName(new)
        g = grouped(g, links)
        turn, before, waiting = turn + 1, waiting, open_pairs(g)
        if waiting > before / 2:  # the rest does not link to a few centres
            break
    new = verified(near_pairs(g, traits, percent))
    links = new if links is None else links.unionByName(new)
    return sig, reps, links


def _common(sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs of sets (``sizes`` of them, one after the other in ``items``)."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(items, kind="stable")
    items, own = items[order], own[order]
    new = np.append(True, items[1:] != items[:-1])[: len(items)]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else np.zeros(0, bool)
    own, col = own[shared], np.cumsum(new[shared]) - 1 if shared.any() else col[:0]
    out = np.zeros((len(sizes), len(sizes)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        z, y = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(sizes), COLUMNS), np.float32)
        m[own[z:y], col[z:y] - c] = 1
        out += m @ m.T  # counts below 2**24 are exact
    return out


def link_counts(docs: DataFrame, reps: DataFrame, comp: DataFrame, width: int, percent: int) -> DataFrame:
    """(cid, far): for every node of a component (cid, component) the documents of other nodes that it links with.

    Links lie inside components.  A component's sets are dealt into blocks of about ``ITEMS`` shingles, and every two blocks meet in
    a task of their own, where all pairs are tested on whole sets; what leaves it is one count for every node, not the pairs.
    """
    members = keep(reps.join(comp, "cid"), "ngram-members")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(ITEMS)).alias("blocks"))
    sets = whole_sets(docs, members, width)
    rows = members.join(blocks, "component").select("cid", "component", "n", "copies", "blocks").join(sets, "cid")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("blk", "x").alias("lo"), F.greatest("blk", "x").alias("hi"), "blk", "cid", "n", "copies", "items")
    schema = pa.schema([("cid", pa.int64()), ("far", pa.int64())])

    def tested(t: pa.Table) -> pa.RecordBatch | None:
        lo, hi, blk, cid, n, copies = (t.column(k).to_numpy() for k in ("lo", "hi", "blk", "cid", "n", "copies"))
        items = t.column("items").combine_chunks()
        inter = _common(n, items.flatten().to_numpy())
        linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        linked &= (blk[:, None] != blk[None, :]) if lo[0] != hi[0] else ~np.eye(len(n), dtype=bool)
        far = linked @ copies
        return pa.RecordBatch.from_arrays([pa.array(cid[far > 0]), pa.array(far[far > 0])], schema=schema) if far.any() else None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            names = [b.column(k).to_numpy() for k in ("component", "lo", "hi")]
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                mine = tuple(int(x[i]) for x in names)
                if mine != key and held:
                    done = tested(pa.Table.from_batches(held))
                    held = []
                    if done is not None:
                        yield done
                key = mine
                held.append(b.slice(i, j - i))
        if held and (done := tested(pa.Table.from_batches(held))) is not None:
            yield done

    spread = rows.repartition(partitions(docs.sparkSession), "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return spread.mapInArrow(meet, "cid long, far long").groupBy("cid").agg(F.sum("far").alias("far"))


def components(docs: DataFrame, width: int = 5, percent: int = 80, every_link: bool = False) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, component) for every document, with ``n_links`` if every link is asked for.

    ``component`` names the class even where its ids are null (null for empty sets); th = xxhash64(text).  ``n_links`` counts
    the other documents that the document links with, those of equal sets included.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig, reps, links = _join(docs, width, percent, every_link=False)
    comp = _classes(links).withColumnRenamed("node", "cid")
    named = reps.join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    more = ["n_links"] if every_link else []
    if every_link:
        met = link_counts(docs, reps, comp, width, percent)
        named = named.join(met, "cid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("far", F.lit(0)))
    named = named.join(least, "component").select("s1", "s2", "component_id", "component", *more)
    some = sig.filter("n > 0").select("doc_id", "th", "n", "s1", "s2")
    out = some.join(named, ["s1", "s2"]).select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "component", *more)
    none = sig.filter("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return out.unionByName(none.withColumn("n_links", F.lit(0).cast("long")) if every_link else none)


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, members): every linked pair (a, b) of distinct sets, a < b, and (doc_id, th, node) of all documents with words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig, reps, links = _join(docs, width, percent, every_link=True)
    members = sig.filter("n > 0").select("doc_id", "th", "s1", "s2").join(reps.select("s1", "s2", F.col("cid").alias("node")), ["s1", "s2"])
    return links, members.select("doc_id", "th", "node")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows without near duplicates: the smallest (id, text) of every component stays, once.

    Documents without words are no one's duplicates and all stay.
    """
    with steps() as passing:
        classes = components(docs, width, percent)
    found = keep(classes, "ngram-classes")
    remove(docs.sparkSession, passing)
    lead = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
    stay = lead.select("doc_id", "th", F.lit(True).alias("once")).unionByName(found.filter("component IS NULL").select("doc_id", "th", F.lit(False).alias("once")).distinct())
    times = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    key = [F.col("_d"), F.col("_t")]
    stay = stay.join(times.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "c"), F.col("doc_id").eqNullSafe(key[0]) & F.col("th").eqNullSafe(key[1]))
    stay = keep(stay.select("_d", "_t", (F.col("once") & (F.col("c") > 1)).alias("_again")), "ngram-stay")
    if stay.count() <= BROADCAST_ROWS:
        stay = F.broadcast(stay)
    d = docs.select(F.col("doc_id").cast("long").alias("_i"), F.xxhash64("text").alias("_h"), carried(docs))
    d = d.join(stay, F.col("_i").eqNullSafe(key[0]) & F.col("_h").eqNullSafe(key[1]))
    again = d.filter("_again").groupBy("_i", "_h").agg(F.first("row").alias("row"))  # repeated rows: one stays
    return restored(d.filter("NOT _again").select("row").unionByName(again.select("row")), docs.columns)
