"""Exact removal of repeated byte strings by fingerprints and runs of equal rank in a sparse suffix order.

A position starts a repeat when the ``length`` bytes from it also start elsewhere (mode ``all``) or earlier in the corpus
(mode ``first``: later copies go, the first stays; earlier means smaller document id, then earlier byte).  Matches never
cross documents.

1. *Anchors.*  The start of every ``length``-byte window is owned by an anchor: the leftmost smallest of the ``gram``-byte
   fingerprints in the window.  Equal windows have equal anchors at equal places, so only the windows of anchors that occur
   more than once can repeat.  An anchor's owned windows form one fragment of text, kept as (anchor, fragment) fingerprints.
2. *Equal fragments.*  Where all fragments of an anchor are equal, or a fragment occurs more than once, all its windows
   repeat; the smallest occurrence is the first.  Long copies end here, whatever their number.
3. *Suffix order.*  Anchors with different fragments are compared by content, one representative per distinct fragment.
   A task sorts the suffixes of its fragments by prefix doubling up to ``length`` bytes; suffixes of equal rank share a
   longest common prefix of ``length`` or more, and a suffix has an earlier match iff the smallest position of its run is
   not its own.  Longest-previous-factor lengths are not computed, as only matches of ``length`` count.
4. *Large groups.*  Anchors with more than ``group_limit`` different fragments (a passage in very many contexts) would
   gather in one task; their windows are compared by 128-bit fingerprints, grouped by Spark with partial aggregation, to
   the same result.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` keep all bytes; repeated rows (same id
and text) repeat each other in mode ``all`` and are one text in mode ``first``; null ids count as smallest; an empty
table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import carried, keep, partitions
from lintlake.llm.textbuf import BYTE_CODE, U, buffers, chunks, mix, powers, prefix_sums, ranges, signed, span_hash

SLICE = 1 << 25  # longer texts are scanned in slices that overlap by a window, so places fit the key's 26 bits
ROWS = 1000  # texts that a task holds at once when it cuts or trims
TASK_BYTES = 2 << 20  # fragment bytes that are suffix-sorted at once
BROADCAST_ROWS = 1 << 19  # places of fragments are broadcast up to this many (some 50 bytes each), joined by shuffle beyond
PLACE = U((1 << 26) - 1)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    y = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(anchor, fragment, row, first window, windows, times) of all owned fragments; places are counted within a row.

    Equal fragments that follow one another (periodic text) are one entry with their number.
    """
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z, z
    sums = prefix_sums(data, BYTE_CODE)
    _, inv = powers(n + 1)
    h = mix((sums[gram:] - sums[:-gram]) * inv[: n + 1 - gram])
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(key, length - gram + 1) & PLACE).astype(np.int64)
    valid = np.ones(len(at), bool)
    for e in off[1:-1].tolist():  # windows that cross into the next text
        valid[max(0, e - length + 1) : e] = False
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(at)))
    ok = valid[start]
    start, count = start[ok], count[ok]
    row = np.searchsorted(off, start, side="right") - 1
    h, f = h[at[start]], span_hash(sums, start, start + count - 1 + length)
    lead = np.ones(len(start), bool)
    lead[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1]) | (count[1:] != count[:-1]) | (start[1:] != start[:-1] + count[:-1])
    times = np.diff(np.append(np.flatnonzero(lead), len(start)))
    return h[lead], f[lead], row[lead], start[lead] - off[row[lead]], count[lead], times


def fragments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, th, h, f, s, n, m): every anchor's fragment, m times in a row."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th = b.column("doc_id"), b.column("th")
            for i, j, data, off in chunks(b.column("text")):
                for lo in range(0, max(1, len(data) - length + 1), SLICE) if j - i == 1 else (0,):
                    part, o = (data[lo : lo + SLICE + length - 1], np.array([0, min(len(data) - lo, SLICE + length - 1)])) if j - i == 1 else (data, off)
                    h, f, row, s, n, m = anchors(part, o, length, gram)
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([doc.take(take), th.take(take), pa.array(signed(h)), pa.array(signed(f)), pa.array(s + lo), pa.array(n), pa.array(m)], schema=schema)

    return keep(docs.mapInArrow(scan, "doc_id long, th long, h long, f long, s long, n long, m long"), "repeat-anchors")


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix under the order of its first ``depth`` bytes (shorter suffixes end in a smallest byte)."""
    n = len(data)
    reach = min(7, depth)  # the first bytes fit one key
    first = np.zeros(n, np.int64)
    for k in range(reach):
        first[: max(0, n - k)] += (data[k:].astype(np.int64) + 1) << (9 * (reach - 1 - k))
    _, rank = np.unique(first, return_inverse=True)
    rank = rank.astype(np.int64) + 1

    def refine(rank: np.ndarray, step: int) -> np.ndarray:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:]
        _, out = np.unique(rank * (int(rank.max(initial=0)) + 2) + nxt, return_inverse=True)
        return out.astype(np.int64) + 1

    while 2 * reach <= depth:
        rank, reach = refine(rank, reach), 2 * reach
    return refine(rank, depth - reach) if reach < depth else rank


def previous_factors(rank: np.ndarray, group: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has another match, has an earlier match) of suffixes, from the runs of equal rank in suffix order.

    Within a run every longest common prefix reaches the depth, so a suffix's previous smaller position exists in the run
    iff it is not the run's smallest.
    """
    order = np.lexsort((position, rank, group))
    new = np.ones(len(order), bool)
    new[1:] = (rank[order][1:] != rank[order][:-1]) | (group[order][1:] != group[order][:-1])
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    other, earlier = np.zeros(len(order), bool), np.zeros(len(order), bool)
    other[order] = size[run] > 1
    earlier[order] = ~new  # sorted by position within a run: only its first has no earlier match
    return other, earlier


def _runs(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, end) of maximal runs of set flags at consecutive places."""
    at = np.flatnonzero(flags)
    o, p = owner[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return o[new], p[new], p[last[: int(new.sum())]] + 1 if len(at) else p


def _compare(reps: DataFrame, length: int, first: bool) -> DataFrame:
    """(doc_id, th, a, z): runs of repeated windows among the representatives (doc_id, th, h, s, n, seq, frag) of small groups."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("z", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.Table) -> pa.RecordBatch:
            data, off = buffers(rows.column("frag"))
            n = rows.column("n").to_numpy()
            # One separator-free rank: a window never leaves its fragment, so shared borders do not matter.
            rank = suffix_ranks(data, length)
            owner = np.repeat(np.arange(len(n)), n)
            local = ranges(n)
            at = off[owner] + local
            group = rows.column("h").to_numpy()[owner]
            seq = rows.column("seq").to_numpy()[owner]  # the corpus order of the group's representatives
            other, earlier = previous_factors(rank[at], group, seq * (int(n.max()) + 1) + local)
            o, a, z = _runs(earlier if first else other, owner, local)
            s = rows.column("s").to_numpy()[o]
            take = pa.array(o)
            return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().take(take), rows.column("th").combine_chunks().take(take), pa.array(s + a), pa.array(s + z)], schema=schema)

        for b in batches:
            h = b.column("h").to_numpy()
            cut = 0
            for i in np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)).tolist():
                piece = b.slice(cut, i - cut)
                if held and size >= TASK_BYTES and held[-1].column("h")[-1].as_py() != piece.column("h")[0].as_py():
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(piece)
                size += buffers(piece.column("frag"))[1][-1]
                cut = i
        if held:
            yield solve(pa.Table.from_batches(held))

    spread = reps.repartition(partitions(reps.sparkSession), "h").sortWithinPartitions("h")
    return spread.select("doc_id", "th", "h", "s", "n", "seq", "frag").mapInArrow(work, "doc_id long, th long, a long, z long")


def _windows(reps: DataFrame, length: int, first: bool) -> DataFrame:
    """The same for large groups, by window fingerprints."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("frag"))
            n = b.column("n").to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            at = off[owner] + ranges(n)
            one = span_hash(prefix_sums(data, BYTE_CODE), at, at + length)
            two = span_hash(prefix_sums(data, mix(BYTE_CODE ^ U(0xA0761D6478BD642F)) | U(1)), at, at + length)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), b.column("h").take(take),
                                              pa.array(b.column("s").to_numpy()[owner] + ranges(n)), pa.array(signed(one)), pa.array(signed(two))], schema=schema)

    w = keep(reps.select("doc_id", "th", "h", "s", "n", "frag").mapInArrow(work, "doc_id long, th long, h long, at long, w1 long, w2 long"), "repeat-windows")
    key = ["h", "w1", "w2"]
    shared = w.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "at")).alias("lead")).filter("c > 1")
    hit = w.join(shared, key)
    if first:
        hit = hit.filter(~F.col("lead").eqNullSafe(F.struct("doc_id", "th", "at")))
    return hit.select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + 1).alias("z"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))


def repeats(docs: DataFrame, length: int = 400, gram: int = 256, first: bool = False, group_limit: int = 32) -> DataFrame:
    """(doc_id, th, a, z): runs [a, z) of window starts that repeat; th = xxhash64(text) tells texts of one id apart."""
    d = keyed(docs)
    frag = fragments(d, length, gram)
    occ = F.struct("doc_id", "th", "s")
    groups = frag.groupBy("h").agg(F.sum("m").alias("c"), (F.min("f") != F.max("f")).alias("mixed")).filter("c > 1").drop("c")
    cand = keep(frag.join(groups, "h"), "repeat-candidates")

    def later(rows: DataFrame, key: list[str]) -> DataFrame:
        """(doc_id, th, a, z) of the rows' windows, in mode first without the first occurrence of every key."""
        z = (F.col("s") + F.col("n") * F.col("m")).alias("z")
        if not first:
            return rows.select("doc_id", "th", F.col("s").alias("a"), z)
        lead = rows.groupBy(*key).agg(F.min(occ).alias("lead"))
        a = F.col("s") + F.when(F.col("lead").eqNullSafe(occ), F.col("n")).otherwise(0)
        return rows.join(lead, key).select("doc_id", "th", a.alias("a"), z).filter("a < z")

    out = later(cand.filter("NOT mixed"), ["h"])
    mixed = cand.filter("mixed").drop("mixed")
    kinds = keep(mixed.groupBy("h", "f").agg(F.sum("m").alias("c"), F.min(F.struct("doc_id", "th", "s", "n")).alias("lead")), "repeat-kinds")
    same = mixed.join(kinds.filter("c > 1").select("h", "f"), ["h", "f"], "left_semi")
    out = out.unionByName(later(same, ["h", "f"]))

    # One representative of every distinct fragment, with its text.
    reps = kinds.select("h", "f", "c", "lead.*")
    sizes = reps.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    reps = reps.join(sizes, "h")
    wanted = reps.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "f", "s", "n", "c", "kinds")).alias("parts"))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("c", pa.int64()),
                        ("kinds", pa.int64()), ("frag", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            for r in range(b.num_rows):
                raw = b.column("text")[r].as_buffer().to_pybytes()
                rows = b.column("parts")[r].as_py()
                ids = {"doc_id": b.column("doc_id")[r].as_py(), "th": b.column("th")[r].as_py()}
                yield pa.RecordBatch.from_pylist([ids | p | {"frag": raw[p["s"] : p["s"] + p["n"] - 1 + length]} for p in rows], schema=schema)

    w = wanted.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "parts")
    if kinds.count() <= BROADCAST_ROWS:
        w = F.broadcast(w)
    texts = d.join(w, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "th", "text", "parts")
    cutout = texts.mapInArrow(cut, "doc_id long, th long, h long, f long, s long, n long, c long, kinds long, frag binary")
    cutout = keep(cutout.dropDuplicates(["h", "f"]), "repeat-fragments")  # repeated rows bring a text more than once
    small = cutout.filter(F.col("kinds") <= group_limit)
    order = small.select("h", "f", F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "th", "s").alias("o"))
    seq = order.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("o", "f"))).alias("l")).select("h", F.posexplode("l").alias("seq", "x")).select("h", F.col("x.f").alias("f"), F.col("seq").cast("long").alias("seq"))
    compared = _compare(small.join(seq, ["h", "f"]), length, first).unionByName(_windows(cutout.filter(F.col("kinds") > group_limit), length, first))
    return out.unionByName(compared)


def remove(docs: DataFrame, length: int = 400, gram: int = 256, first: bool = False, group_limit: int = 32, whole_chars: bool = False) -> DataFrame:
    """(doc_id, row, n_bytes, n_removed, n_spans, kept_sha256, kept, spans): every document without its repeated bytes.

    ``kept`` is the remaining bytes, ``spans`` the maximal removed runs as [start, stop), ``row`` the input's other columns.
    With ``whole_chars`` a run leaves the characters that it holds only in part.
    """
    runs = repeats(docs, length, gram, first, group_limit)
    spans = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "z")).alias("runs"))
    s = spans.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "runs")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"), carried(docs, "text"))
    d = d.join(s, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "row", "text", "runs")

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            data, off = buffers(b.column("text"))
            tail = (data & 0xC0) == 0x80  # bytes inside a character
            raw = data.tobytes()
            runs_ = b.column("runs")
            removed, count, sha, kept, cuts_of = [], [], [], [], []
            for r in range(b.num_rows):
                text = raw[off[r] : off[r + 1]]
                cuts: list[list[int]] = []
                if runs_[r].is_valid:
                    for a, z in sorted((x["a"], x["z"] - 1 + length) for x in runs_[r].as_py()):
                        if cuts and a <= cuts[-1][1]:
                            cuts[-1][1] = max(z, cuts[-1][1])
                        else:
                            cuts.append([a, z])
                if whole_chars:
                    inside = tail[off[r] : off[r + 1]]
                    for c in cuts:
                        while c[0] < c[1] and inside[c[0]]:
                            c[0] += 1
                        while c[0] < c[1] < len(text) and inside[c[1]]:
                            c[1] -= 1
                    cuts = [c for c in cuts if c[0] < c[1]]
                at, left = 0, []
                for a, z in cuts:
                    left.append(text[at:a])
                    at = z
                left.append(text[at:])
                rest = b"".join(left)
                removed.append(len(text) - len(rest))
                count.append(len(cuts))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
                cuts_of.append([{"start": a, "stop": z} for a, z in cuts])
            cols = [b.column("doc_id"), b.column("row"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()),
                    pa.array(kept, pa.binary()), pa.array(cuts_of, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    added = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>")
    return d.mapInArrow(trim, T.StructType([d.schema["doc_id"], d.schema["row"], *added.fields]))
