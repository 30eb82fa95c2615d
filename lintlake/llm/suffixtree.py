"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are the A-Z lower-cased words of a text and one end symbol.  The root state is the corpus' unigram distribution with
add-one smoothing; deeper states are contexts of one to ``depth`` words.

1. *Counts.*  How often every run of 1 to ``depth`` + 1 tokens occurs in the training texts.  All runs take part; the one
   threshold is an absolute support: a symbol seen fewer than ``SUPPORT`` times after a context is none of its symbols.  A
   run is therefore counted only if the two runs that are one token shorter reach the support (exact: no others can).
2. *Divergence test.*  A context stays a state if coding its symbols with its own distribution instead of its suffix' saves
   at least ``gain`` nats per occurrence.  A state's suffix must be a state, too.
3. *Smoothing.*  With N occurrences of a state, n of a symbol after it, and K those of all its symbols, the symbol's
   probability is (n + (N - K + prior) * p) / (N + prior), p being its probability in the suffix state.  It sums to 1.
4. *Scoring.*  Every token is scored in the state of the longest suffix of the words before it in the same text.

Nothing of the model is held whole anywhere: it lives in *shards* of the fingerprints' range.  The texts are read in blocks
of ``block_bytes``; a block sends each shard the sorted distinct fingerprints that it holds there with its own counts, packed
as one binary row, and gets back their corpus totals in the same order.  A frequent word or run is one entry of a block
however often it occurs, so no shard grows with a hot key.  The number of shards grows with the tokens.  Totals are written
under the shared folder, one folder per scan partition; a block finds its own by (scan partition, number), and a checksum of
the fingerprints proves that it is the same block, otherwise the job fails.

``docs`` must give the same rows in the same partitions whenever it is read (table scans do; write anything else first).
Runs are known by 64-bit fingerprints.  Defined results: a null or empty text is the end symbol alone; repeated rows are
scored, and counted, as often as they occur; null ids count as empty text for the fold; with no training text every count is
0; an empty table gives an empty result; extra columns of the input are ignored; a text longer than a block is a block.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import keep, partitions
from lintlake.llm.textbuf import BASE, U, chunks, mix, word_hashes
from lintlake.session import scratch

END = np.uint64(0xE703)  # the end symbol's fingerprint
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 2_000_000  # tokens a shard
SUPPORT = 2  # occurrences from which a symbol belongs to a state
PRIOR = 0.5
CODEC = "zstd"


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, row) of all tokens, every text closed by the end symbol."""
    h, _, _, row = word_hashes(data, off)
    rows = len(off) - 1
    n = np.bincount(row, minlength=rows)
    out = np.full(len(h) + rows, END, np.uint64)
    out[np.arange(len(h)) + row] = h
    return out, np.repeat(np.arange(rows), n + 1)


def packed(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes of small numbers vanish."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec=CODEC, asbytes=True)


def unpacked(blob: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(blob, decompressed_size=n * size, codec=CODEC, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def distinct_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of every key among them), sorting high bits and positions as one number."""
    n = len(key)
    if n < 2:
        return key.copy(), np.zeros(n, np.int32)
    low = U((1 << (n - 1).bit_length()) - 1)
    z = np.sort((key & ~low) | np.arange(n, dtype=U))
    perm = (z & low).astype(np.int64)
    ordered = key[perm]
    # Different keys of equal high bits may stand in a wrong order; there are few such runs.
    for high in np.unique(ordered[1:][ordered[1:] < ordered[:-1]] & ~low):
        i, j = np.searchsorted(z, high), np.searchsorted(z, high | low, side="right")
        o = np.argsort(ordered[i:j], kind="stable")
        perm[i:j], ordered[i:j] = perm[i:j][o], ordered[i:j][o]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(n, np.int32)
    place[perm] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


class Level:
    """A block's runs of one length: where they end, their distinct fingerprints, their totals over the training texts."""

    def __init__(self, at: np.ndarray, key: np.ndarray):
        self.at = at.astype(np.int32 if len(at) == 0 or at[-1] < 1 << 31 else np.int64)  # ends of the counted runs
        self.keys, self.place = distinct_of(key)
        self.totals = np.zeros(0, np.int64)

    def spread(self, size: int) -> np.ndarray:
        """Totals by token; 0 where no run is counted."""
        out = np.zeros(size, np.int64)
        out[self.at] = self.totals[self.place]
        return out


class Block:
    """Some whole texts with their runs up to a length."""

    def __init__(self, h: np.ndarray, row: np.ndarray, trained: np.ndarray, totals: list[Callable[[np.ndarray], np.ndarray]], length: int):
        """``totals[k]`` gives the totals of the sorted distinct fingerprints of runs of k + 1 tokens."""
        self.row, self.trained, size = row, trained[row], len(h)
        self.levels: list[Level] = []
        self.n: list[np.ndarray] = []
        at, hashes = np.arange(size), h.copy()
        for k in range(length):
            if k:
                # A run of k + 1 tokens ends at i if the runs of k tokens that end at i - 1 and i reach the support.
                often = self.n[k - 1] >= SUPPORT
                at = np.flatnonzero(often[1:] & often[:-1] & (row[1:] == row[:-1])) + 1
                longer = np.zeros(size, U)
                longer[at] = mix(hashes[at - 1] * BASE + mix(h[at] + U(k)))
                hashes = longer
            level = Level(at, hashes[at])
            self.levels.append(level)
            if k < len(totals):
                level.totals = totals[k](level.keys)
                self.n.append(level.spread(size))

    def counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The longest runs' fingerprints with this block's counts in training texts."""
        level = self.levels[-1]
        return level.keys, [np.bincount(level.place[self.trained[level.at]], minlength=len(level.keys)).astype(np.uint32)]

    def contexts(self, k: int) -> np.ndarray:
        """Places in level k - 1 of the contexts of k tokens before every token; -1 where there is none."""
        out = np.full(len(self.row), -1, np.int32)
        before = self.levels[k - 1]
        inner = before.at < len(self.row) - 1
        nxt, place = before.at[inner] + 1, before.place[inner]
        ok = self.row[nxt] == self.row[nxt - 1]
        out[nxt[ok]] = place[ok]
        return out

    def tried(self) -> list[np.ndarray]:
        """By context length - 1: places of the contexts that reach the support, in the order of their fingerprints."""
        return [np.flatnonzero(level.totals >= SUPPORT) for level in self.levels[:-1]]

    def gains(self, tokens_in_all: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Contexts' fingerprints with this block's part of (occurrences of kept symbols, nats saved)."""
        keys, kept, nats = [], [], []
        for k, tried in enumerate(self.tried(), start=1):
            n, ctx = self.n[k], self.contexts(k)
            i = np.flatnonzero((n >= SUPPORT) & self.trained & (ctx >= 0))
            size = len(self.levels[k - 1].keys)
            below = self.levels[k - 2].totals[self.contexts(k - 1)[i]] if k > 1 else np.full(len(i), tokens_in_all)
            saved = np.log(n[i] / self.levels[k - 1].totals[ctx[i]]) - np.log(self.n[k - 1][i] / below)
            keys.append(self.levels[k - 1].keys[tried])
            kept.append(np.bincount(ctx[i], minlength=size)[tried].astype(np.uint32))
            nats.append(np.bincount(ctx[i], weights=saved, minlength=size)[tried].astype(np.float32))
        key = np.concatenate(keys) if keys else np.zeros(0, U)
        o = np.argsort(key)
        return key[o], [np.concatenate(v)[o] if v else np.zeros(0, t) for v, t in ((kept, np.uint32), (nats, np.float32))]

    def logp(self, states: Callable[[np.ndarray], np.ndarray], total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """(log10 p in the root, log10 p in the longest suffix state) of every token.

        ``states`` gives the kept occurrences of the contexts that ``gains`` sent, 0 for those that are no states.
        """
        root = (self.n[0] + 1) / (total + distinct + 1)
        p, live = root.copy(), np.ones(len(root), bool)
        tried = self.tried()
        key = np.concatenate([self.levels[k].keys[t] for k, t in enumerate(tried)]) if tried else np.zeros(0, U)
        o = np.argsort(key)
        said = np.zeros(len(key), np.int64)
        said[o] = states(key[o])
        first = 0
        for k, t in enumerate(tried, start=1):
            before = self.levels[k - 1]
            kept = np.zeros(len(before.keys), np.int64)
            kept[t] = said[first : first + len(t)]
            first += len(t)
            ctx = self.contexts(k)
            live &= ctx >= 0
            live[live] = kept[ctx[live]] > 0
            i = np.flatnonzero(live)
            n = np.where(self.n[k][i] >= SUPPORT, self.n[k][i], 0)
            all_n, own = before.totals[ctx[i]], kept[ctx[i]]
            p[i] = (n + (all_n - own + PRIOR) * p[i]) / (all_n + PRIOR)
        return np.log10(root), np.log10(p)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path))


def _received(path: str, part: int) -> dict[int, list[dict]]:
    """By block of scan partition ``part``: its answers in the order of the shards."""
    fs, root = _open(path)
    folder = f"{root}/part={part}"
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return {}
    found: dict[int, list[dict]] = {}
    for r in sorted(ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["block", "shard", "m", "crc", "answer"]).to_pylist(), key=lambda r: (r["block"], r["shard"])):
        found.setdefault(r["block"], []).append(r)
    return found


def _answers(rows: list[dict]) -> Callable[[np.ndarray], np.ndarray]:
    def totals(keys: np.ndarray) -> np.ndarray:
        if sum(r["m"] for r in rows) != len(keys) or _crc(rows, keys):
            raise RuntimeError("the table was not read in the same blocks again; write it before scoring")
        return np.concatenate([unpacked(r["answer"], r["m"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    return totals


def _crc(rows: list[dict], keys: np.ndarray) -> bool:
    ends = np.cumsum([r["m"] for r in rows])
    return any(zlib.crc32(keys[e - r["m"] : e].tobytes()) != r["crc"] for r, e in zip(rows, ends, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], paths: list[str], length: int, block_bytes: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray, Block, Callable]]:
    """(scan partition, number, doc ids, trained, block, last answers) of every block; ``paths``: answers so far."""
    part = TaskContext.get().partitionId()
    received = [_received(p, part) for p in paths]
    held: list[tuple] = []
    size, number = 0, 0

    def block():
        rows = np.cumsum([0] + [len(x[1]) for x in held])
        h = np.concatenate([x[2] for x in held])
        row = np.concatenate([(x[3] + r).astype(np.int32) for x, r in zip(held, rows[:-1], strict=True)])
        trained = np.concatenate([x[1] for x in held])
        said = [_answers(f.get(number, [])) for f in received]
        return part, number, pa.concat_arrays([x[0] for x in held]), trained, Block(h, row, trained, said[:length], length), said[-1] if said else None

    for b in batches:
        for i, j, data, off in chunks(b.column("text")):
            held.append((b.column("doc_id").slice(i, j - i), b.column("trained").slice(i, j - i).fill_null(False).to_numpy(zero_copy_only=False).astype(bool), *tokens(data, off)))
            size += len(data)
            if size >= block_bytes:
                done = block()
                held, size, number = [], 0, number + 1
                yield done
                del done
                pa.default_memory_pool().release_unused()
    if held:
        done = block()
        held = []
        yield done


SENT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("m", pa.int32()), ("crc", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
SENT_DDL = "part int, block int, shard int, m int, crc long, keys binary, a binary, b binary"
BACK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("m", pa.int32()), ("crc", pa.int64()), ("answer", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])
BACK_DDL = "part int, block int, shard int, m int, crc long, answer binary, total long, distinct long"


def _exchange(d: DataFrame, paths: list[str], length: int, shards: int, block_bytes: int, tokens_in_all: int | None = None, gain: float = 0.0) -> tuple[str, int, int]:
    """(path, total, distinct): corpus totals of every block's runs of ``length`` tokens or, with ``tokens_in_all``, of the
    contexts' gains, written by scan partition."""
    testing = tokens_in_all is not None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, number, _, _, block, _ in _blocks(batches, paths, length, block_bytes):
            keys, values = block.gains(tokens_in_all) if testing else block.counts()
            shard = ((keys >> U(32)) * U(shards)) >> U(32)
            ends = np.searchsorted(shard, np.arange(shards + 1, dtype=U))
            rows = []
            for s in np.flatnonzero(np.diff(ends)):
                i, j = ends[s], ends[s + 1]
                k = keys[i:j]
                gaps = np.diff(k, prepend=U(0))
                rows.append({"part": part, "block": number, "shard": int(s), "m": int(j - i), "crc": zlib.crc32(k.tobytes()), "keys": packed(gaps),
                             "a": packed(values[0][i:j]), "b": packed(values[1][i:j]) if testing else None})
            del block, keys, values, shard  # the next block is read without this one
            yield from pa.Table.from_pylist(rows, schema=SENT).to_batches(max_chunksize=64)

    def add(sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["m"], U), dtype=U) for r in rows])
        _, place = distinct_of(keys)
        total = np.bincount(place, weights=np.concatenate([unpacked(r["a"], r["m"], np.uint32) for r in rows])).astype(np.int64)
        if testing:
            nats = np.bincount(place, weights=np.concatenate([unpacked(r["b"], r["m"], np.float32) for r in rows]))
            total = np.where(nats >= gain * total, total, 0)
        out, first = [], 0
        for k, r in enumerate(rows):
            mine = total[place[first : first + r["m"]]]
            first += r["m"]
            out.append({**{c: r[c] for c in ("part", "block", "shard", "m", "crc")}, "answer": packed(mine), "total": int(total.sum()) if k == 0 else 0,
                        "distinct": int((total > 0).sum()) if k == 0 else 0})
        return pa.Table.from_pylist(out, schema=BACK)

    sent = d.mapInArrow(send, SENT_DDL)
    path = scratch(d.sparkSession, "tree-totals")
    sent.groupBy("shard").applyInArrow(add, BACK_DDL).repartition("part").write.partitionBy("part").parquet(path)
    back = d.sparkSession.read.schema(BACK_DDL).parquet(path)
    total, distinct = back.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return path, total, distinct


def score(docs: DataFrame, training: Column, gain: float = 0.01, depth: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every text under a tree of the training texts."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", training.alias("trained"))
    # Blocks must not move if executors come or go: the scan's split size depends on the cores at hand.
    pin = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(pin, None)
    spark.conf.set(pin, before or str(spark.sparkContext.defaultParallelism))
    try:
        path, total, distinct = _exchange(d, [], 1, partitions(spark), block_bytes)
        paths = [path]
        shards = max(partitions(spark), -(-total // SHARD_TOKENS))
        for k in range(1, depth + 1):
            paths.append(_exchange(d, paths, k + 1, shards, block_bytes)[0])
        paths.append(_exchange(d, paths, depth + 1, shards, block_bytes, total, gain)[0])
        schema = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, ids, trained, block, states in _blocks(batches, paths, depth + 1, block_bytes):
                base, lp = block.logp(states, total, distinct)
                n, known, base, lp = [np.bincount(block.row, weights=w, minlength=len(ids)) for w in (None, block.n[0] > 0, base, lp)]
                del block, states
                yield pa.RecordBatch.from_arrays([ids, pa.array(trained), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lp)], schema=schema)

        ddl = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
        out = keep(d.mapInArrow(run, ddl), "tree-scores")
    finally:
        spark.conf.unset(pin) if before is None else spark.conf.set(pin, before)
    return out.select("doc_id", "trained", "n_tokens", "n_known", F.lit(int(total)).alias("train_tokens"), "base_score", "score")
