"""Language identification of whole texts, with language spans for mixed ones.

1. *Learning.*  Languages are the non-null labels of the training texts.  From a seeded sample of about ``sample`` texts per
   language (the documented bound of the fit; 2,000 by default) Spark counts hashed byte n-grams (1 to 4) inside words
   and the letters of every script.
2. *Scripts.*  Words end at white space and where the script of their letters changes.  A word's script is that of its
   letters by code-point ranges.  Only languages that write at least ``script_share`` of their training letters in that
   script are candidates for it; a word of a script that no language uses says nothing.
3. *Words.*  A word's score for a candidate is the mean log probability of its n-grams times the square root of their
   number, so long words say more, but not in proportion to their overlapping n-grams.
4. *Spans.*  Viterbi over a text's words with a penalty for every switch labels each word; equal neighbours form spans.
   The text's language is the label of the most letters (ties: the first in code-point order), its score that share of
   letters times the mean posterior of the label over its words.

Defined results: a null text or one without a letter is ``und`` with score 0; a text whose letters are in no learned script
gets the most frequent language with score 0; with no labelled training text everything is ``und``; repeated rows are
predicted alike; null ids are predicted and counted as empty text for the fold; an empty table gives an empty result;
extra columns of the input are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm import encoding
from lintlake.llm.textbuf import BYTE_CODE, U, chunks, mix, prefix_sums, ranges, span_hash, words

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
MEMO = 400_000
SLICE = 4096  # words whose n-grams are in memory together
# First code points of blocks of one script, in order; letters up to the next entry belong to it.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
           (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
           (0xFFA0, "other"), (0x20000, "han"), (0x323B0, "other"))
_FIRST = np.array([c for c, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS])


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of letters, script) of words; a word's script is that of most of its letters, -1 without letters."""
    n, script = np.zeros(len(texts), np.int64), np.full(len(texts), -1)
    for i, t in enumerate(texts):
        if t.isascii():
            k = sum(map(str.isalpha, t))
            n[i] = k
            if k:
                script[i] = NAMES.index("latin")
            continue
        points = [ord(c) for c in t if c.isalpha()]
        n[i] = len(points)
        if points:
            kinds = _SCRIPT[np.maximum(np.searchsorted(_FIRST, points, side="right") - 1, 0)]
            script[i] = np.bincount(kinds).argmax()
    return n, script


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all n-grams of the lower-cased words, each word between two marks."""
    raw = [b"\x02" + unicodedata.normalize("NFC", t.lower()).encode("utf-8") + b"\x03" for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    sums = prefix_sums(data, BYTE_CODE)
    buckets, owners = [], []
    for g in GRAMS:
        n = np.maximum(size - g + 1, 0)
        owner = np.repeat(np.arange(len(raw)), n)
        at = off[owner] + ranges(n)
        buckets.append((span_hash(sums, at, at + g) >> U(48)).astype(np.int64))
        owners.append(owner)
    return np.concatenate(buckets), np.concatenate(owners)


@cache
def _letter_scripts() -> np.ndarray:
    """Script of every code point, -1 for all that are no letters; kana counts as han, as Japanese words mix the two."""
    script = _SCRIPT[np.maximum(np.searchsorted(_FIRST, np.arange(sys.maxunicode + 1), side="right") - 1, 0)]
    script[script == NAMES.index("kana")] = NAMES.index("han")
    letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.where(letter, script, -1).astype(np.int8)


def _script_cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, byte in it) of every letter whose script differs from that of the letter before it in its span [start, end)."""
    wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
    some = np.flatnonzero(wide[end] > wide[start])
    size = (end - start)[some]
    inside = ranges(size)
    raw = data[np.repeat(start[some], size) + inside]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    script = _letter_scripts()[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    letter = np.flatnonzero(script >= 0)
    script, owner, inside = script[letter], np.repeat(some, size)[lead[letter]], inside[lead[letter]]
    cut = np.flatnonzero((script[1:] != script[:-1]) & (owner[1:] == owner[:-1])) + 1
    return owner[cut], inside[cut]


def _distinct_words(data: np.ndarray, off: np.ndarray):
    """(word code of every word, row, fingerprints and first places of the distinct words, start, end).

    What spaces part is parted again where the script of its letters changes; other characters stay with the letter before.
    """
    start, end, row = words(data, off)
    sums = prefix_sums(data, BYTE_CODE)
    code, uniq = pd.factorize(span_hash(sums, start, end))
    at = _first_places(code, len(uniq))
    owner, cut = _script_cuts(data, start[at], end[at])
    if len(owner):
        n = 1 + np.bincount(owner, minlength=len(uniq))  # parts of every distinct word
        head = np.cumsum(n) - n
        low = np.zeros(n.sum(), np.int64)
        low[np.setdiff1d(np.arange(len(low)), head, assume_unique=True)] = cut
        high = np.append(low[1:], 0)
        high[head + n - 1] = (end - start)[at]
        base = np.repeat(start[at], n)
        part, uniq = pd.factorize(span_hash(sums, base + low, base + high))
        times = n[code]
        which = np.repeat(head[code], times) + ranges(times)
        base, row, code = np.repeat(start, times), np.repeat(row, times), part[which]
        start, end = base + low[which], base + high[which]
        at = _first_places(code, len(uniq))
    return code, row, uniq, start, end, at


def _first_places(code: np.ndarray, n: int) -> np.ndarray:
    at = np.zeros(n, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    return at


@dataclass
class Model:
    langs: list[str]
    prior: int  # the most frequent language
    logp: np.ndarray  # bucket x language
    uses: np.ndarray  # script x language


def learn(texts: DataFrame, sample: int = 2000, script_share: float = 0.02, seed: int = 11) -> Model:
    """Fits on about ``sample`` texts of every language of (doc_id, text, lang)."""
    t = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("mark"))
    per = t.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("c"))
    u = F.shiftrightunsigned("mark", 11) / F.lit(float(1 << 53))
    picked = t.join(F.broadcast(per.select(F.col("lang").alias("_l"), share.alias("share"))), F.col("lang") == F.col("_l")).filter(u < F.col("share")).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, kinds = pd.factorize(b.column("lang").to_pandas())
            for i, j, data, off in chunks(b.column("text")):
                code, row, uniq, start, end, at = _distinct_words(data, off)
                if not len(uniq):
                    continue
                raw = data.tobytes()
                texts_ = [raw[a:z].decode("utf-8") for a, z in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                letters, script = _letters(texts_)
                bucket, owner = _grams(texts_)
                for k in np.unique(lang[i:j]):
                    times = np.bincount(code[lang[i:j][row] == k], minlength=len(uniq))
                    times = np.where(letters > 0, times, 0)
                    n = np.bincount(bucket, weights=times[owner], minlength=BUCKETS).astype(np.int64)
                    s = np.bincount(np.maximum(script, 0), weights=times * letters, minlength=len(NAMES)).astype(np.int64)
                    for kind, v in ((0, n), (1, s)):
                        hit = np.flatnonzero(v)
                        yield pa.RecordBatch.from_arrays([pa.array([kinds[k]] * len(hit), pa.string()), pa.array(np.full(len(hit), kind, np.int32)), pa.array(hit), pa.array(v[hit])], schema=schema)

    found = picked.mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toArrow()  # buckets x languages
    sizes = {r["lang"]: r["c"] for r in per.toLocalIterator()}
    langs = sorted(sizes)
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    if found.num_rows:
        at = np.searchsorted(langs, found.column("lang").to_pylist())
        kind, key, n = (found.column(c).to_numpy() for c in ("kind", "key", "n"))
        grams[key[kind == 0], at[kind == 0]] = n[kind == 0]
        scripts[key[kind == 1], at[kind == 1]] = n[kind == 1]
    total = grams.sum(0)
    logp = np.log((grams + 0.5) / (total + 0.5 * BUCKETS))
    uses = scripts >= np.maximum(script_share * scripts.sum(0), 1)
    return Model(langs, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)) if langs else -1, logp, uses)


def viterbi(scores: np.ndarray, row: np.ndarray, rows: int, penalty: float) -> np.ndarray:
    """Best label of every word: the path of the highest total score less ``penalty`` a switch, per row.

    Rows go through the steps side by side, the longest first, so a step costs what its live rows cost.
    """
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    n, first = n[order], first[order]
    k = scores.shape[1]
    live = np.searchsorted(-n, -np.arange(1, (n[0] if rows else 0) + 1), side="right")  # rows with more than t words
    best = np.zeros((rows, k))
    stay = np.ones((len(scores), k), bool)
    came = np.zeros(len(scores), np.int64)
    for t, m in enumerate(live.tolist()):
        at = first[:m] + t
        v = best[:m]
        if t:
            top = v.max(1)
            came[at] = v.argmax(1)
            stay[at] = v >= (top - penalty)[:, None]
            v = np.maximum(v, (top - penalty)[:, None])
        best[:m] = v + scores[at]
    label = np.zeros(len(scores), np.int64)
    now = best.argmax(1) if rows else np.zeros(0, np.int64)
    for t in range(len(live) - 1, -1, -1):
        m = int(live[t])
        at = first[:m] + t
        label[at] = now[:m]
        now[:m] = np.where(stay[at, now[:m]], now[:m], came[at])
    return label


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])


class Labeller:
    """Labels texts by a model; scores of words already met are kept, up to ``MEMO`` of them."""

    def __init__(self, model: Model, penalty: float):
        self.m, self.penalty, self.k = model, penalty, max(1, len(model.langs))
        self.names = np.array([*model.langs, "und"], dtype=object)
        self.memo: dict[int, int] = {}
        self.table, self.letters = np.zeros((1 << 16, self.k)), np.zeros(1 << 16, np.int64)

    def texts(self, col: pa.Array, with_spans: bool) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array | None]]:
        """(first row, rows, lang_pred, score, spans) of successive runs of rows; no spans unless they are asked for."""
        m, k, names, penalty = self.m, self.k, self.names, self.penalty
        for i, j, data, off in chunks(col):
            rows = j - i
            code, row, uniq, start, end, at = _distinct_words(data, off)
            if len(self.memo) + len(uniq) > MEMO:
                self.memo = {}
            slot = np.array([self.memo.get(x, -1) for x in uniq.tolist()], dtype=np.int64)
            new = np.flatnonzero(slot < 0)
            if len(new):
                raw = data.tobytes()
                texts = [raw[a:z].decode("utf-8") for a, z in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
                n, script = _letters(texts)
                s = np.zeros((len(new), k))
                if m.langs:
                    count = np.zeros(len(new))
                    for a in range(0, len(new), SLICE):
                        bucket, owner = _grams(texts[a : a + SLICE])
                        z = min(a + SLICE, len(new))
                        count[a:z] = np.bincount(owner, minlength=z - a)
                        for c in range(k):
                            s[a:z, c] = np.bincount(owner, weights=m.logp[bucket, c], minlength=z - a)
                    s /= np.sqrt(np.maximum(count, 1))[:, None]
                    can = m.uses[np.maximum(script, 0)] & (n > 0)[:, None]
                    s -= s.max(1, keepdims=True)
                    low = np.minimum(s.min(1, keepdims=True), 0) - 8
                    s = np.where(can, s, low)
                    s = np.where(can.any(1)[:, None], s - s.max(1, keepdims=True), 0.0)
                    n = np.where(can.any(1), n, -n)  # letters of no learned script count, but say nothing
                slot[new] = np.arange(len(self.memo), len(self.memo) + len(new))
                while len(self.memo) + len(new) > len(self.letters):
                    self.table, self.letters = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
                self.table[slot[new]], self.letters[slot[new]] = s, n
                self.memo.update(zip(uniq[new].tolist(), slot[new].tolist(), strict=True))
            sc, le = self.table[slot[code]], self.letters[slot[code]]
            label = viterbi(sc, row, rows, penalty)
            post = np.exp(sc)
            post = post[np.arange(len(sc)), label] / post.sum(1)
            said = np.maximum(le, 0)
            mass = np.bincount(row * k + label, weights=said, minlength=rows * k).reshape(rows, k)
            all_ = np.bincount(row, weights=np.abs(le), minlength=rows)
            lang = mass.argmax(1)
            mine = label == lang[row]
            weight = np.bincount(row, weights=said * mine, minlength=rows)
            sure = np.bincount(row, weights=said * mine * post, minlength=rows) / np.maximum(weight, 1)
            score = np.where(all_ > 0, weight / np.maximum(all_, 1) * sure, 0.0)
            pick = np.where((all_ > 0) & bool(m.langs), np.where(mass.sum(1) > 0, lang, m.prior), len(m.langs))
            spans = None
            if with_spans:
                cut = np.ones(len(label), bool)
                cut[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                cut &= bool(m.langs)
                s0 = np.flatnonzero(cut)
                last = np.append(s0[1:], len(label)) - 1 if len(s0) else s0
                base = off[row[s0]]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[s0], minlength=rows))]).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(start[s0] - base, pa.int64()), pa.array(end[last] - base, pa.int64()), pa.array(names[label[s0]], pa.string())], fields=list(SPAN))
                spans = pa.ListArray.from_arrays(pa.array(ends), parts)
            yield i, rows, pa.array(names[pick], pa.string()), pa.array(np.clip(np.nan_to_num(score), 0, 1)), spans


def predict(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """The input's columns (among them ``text``) with lang_pred, score and spans (start, stop, lang) in bytes of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names_out = [*docs.columns, "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value, penalty)
        for b in batches:
            for i, rows, lang, score, spans in labeller.texts(b.column("text"), True):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, rows) for c in b.columns), lang, score, spans], names=names_out)

    added = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start:long,stop:long,lang:string>>")
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added.fields))


def labels(docs: DataFrame, out: str, model: Model, penalty: float = 12.0) -> DataFrame:
    """The input's columns with the struct ``out`` (lang_pred, score): only ``text`` goes to Python, only labels come back."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding.forget()  # a reused worker need not hold both
        labeller = Labeller(held.value, penalty)
        for t in texts:
            found = list(labeller.texts(t, False))
            yield pa.StructArray.from_arrays([pa.concat_arrays([x[c] for x in found]) if found else pa.array([], kind) for c, kind in ((2, pa.string()), (3, pa.float64()))], names=["lang_pred", "score"])

    return docs.withColumn(out, label.asNondeterministic()("text"))  # else a filter on it would run it again


def identify(docs: DataFrame, training: Column, sample: int = 2000, penalty: float = 12.0) -> DataFrame:
    """``predict`` with a model of the rows of (doc_id, text, lang) that ``training`` selects."""
    model = learn(docs.filter(training).select("doc_id", "text", "lang"), sample)
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, penalty)
