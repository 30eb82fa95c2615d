"""Token ids in fixed-width bit-packed files with random access.

A file holds whole documents in ascending order.  Every id takes the fewest bits that the vocabulary needs; ids are packed
least significant bit first in blocks of ``block_ids`` ids, each block ending on a whole byte.  Layout, little-endian:

    header   8 bytes magic, u32 bits, u32 ids per block, u64 ids, u64 documents
    body     the blocks
    index    u64 offset of every block in the body, then per document: i64 id, u64 first id, u8 1 if the id is null

``read_header`` / ``read_ids`` fetch any run of ids by reading only its blocks; unpacking is vectorised.  Files are written
by the tasks of a range-partitioned sort, under names that follow the order, first as a temporary file and then renamed, so
a task that runs twice leaves the same file.  The folder must be one that all executors share.

Defined results: a null or empty text is the end id alone; null ids sort first; repeated rows are written as often as they
occur; an empty table leaves no files and gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import keep, partitions, running_offset
from lintlake.llm.encoding import encoder
from lintlake.session import ensure_checkpoint_dir

MAGIC = b"BITIDS01"
HEADER = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block", "<u4"), ("ids", "<u8"), ("docs", "<u8")])
BLOCK_IDS = 4096
FILE_IDS = 1 << 22


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address and the path there."""
    if re.match(r"^file:/+", path) or "://" not in path:
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    plane = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(plane.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    plane = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return plane @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> Iterator[bytes]:
    yield np.array([(MAGIC, bits, block, len(ids), len(counts))], HEADER).tobytes()
    offsets, at = [], 0
    for i in range(0, len(ids), block):
        raw = pack_bits(ids[i : i + block], bits)
        offsets.append(at)
        at += len(raw)
        yield raw
    yield np.array(offsets, "<u8").tobytes()
    yield np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    yield (np.cumsum(counts) - counts).astype("<u8").tobytes()
    yield np.array([d is None for d in doc_ids], np.uint8).tobytes()


def read_header(f) -> tuple[np.void, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(header, block offsets, document ids, first ids, null flags) of an open file."""
    h = np.frombuffer(f.read_at(HEADER.itemsize, 0), HEADER)[0]
    if h["magic"] != MAGIC:
        raise ValueError("not a packed id file")
    n, d = int(h["ids"]), int(h["docs"])
    blocks = -(-n // int(h["block"]))
    size = f.size()
    tail = f.read_at(blocks * 8 + d * 17, size - blocks * 8 - d * 17)
    a, b, c = blocks * 8, blocks * 8 + d * 8, blocks * 8 + d * 16
    return h, np.frombuffer(tail[:a], "<u8"), np.frombuffer(tail[a:b], "<i8"), np.frombuffer(tail[b:c], "<u8"), np.frombuffer(tail[c:], np.uint8).astype(bool)


def read_ids(f, header, offsets: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of an open file, from their blocks alone."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    block, bits, n = int(header["block"]), int(header["bits"]), int(header["ids"])
    lo, hi = start // block, (stop - 1) // block
    begin = int(offsets[lo])
    count = min((hi + 1) * block, n) - lo * block
    if block * bits % 8 == 0:  # whole blocks follow one another without gaps
        raw = f.read_at(-(-count * bits // 8), HEADER.itemsize + begin)
        out = unpack_bits(raw, count, bits)
    else:
        out = np.concatenate([unpack_bits(f.read_at(-(-m * bits // 8), HEADER.itemsize + int(offsets[k])), m, bits)
                              for k in range(lo, hi + 1) if (m := min((k + 1) * block, n) - k * block)])
    return out[start - lo * block : stop - lo * block]


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, keeps_space: bool = False, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes all documents in ascending id order; returns the list of files: (part, no, file, n_docs, n_ids, before)."""
    bits = bits_for(vocabulary)
    schema = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        fs, base = file_system(folder)
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = no = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, counts, parts, held, no
            name = f"part-{part:06d}-{no:06d}.ids"
            n = np.concatenate(counts)
            temp = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                for raw in file_bytes(names, n, np.concatenate(parts), bits):
                    out.write(raw)
            fs.move(temp, f"{base}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "no": no, "file": name, "n_docs": len(n), "n_ids": held}], schema=schema)
            names, counts, parts, held, no = [], [], [], 0, no + 1
            return row

        for b in batches:
            doc = b.column("doc_id")
            for i, j, ids, off in enc.batches(b.column("text"), end_id):
                names += doc.slice(i, j - i).to_pylist()
                counts.append(np.diff(off))
                parts.append(ids.astype(enc.width))
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    key = F.xxhash64("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), key.alias("mark"))
    d = d.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "mark")
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark").select("doc_id", "text")
    files = keep(d.mapInArrow(save, "part int, no int, file string, n_docs long, n_ids long"), "packed-files")
    return running_offset(files, ["part", "no"], "n_ids", "before")  # one row per file


def digest(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            for name, before in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    h, offsets, doc, first, null = read_header(f)
                    ids = read_ids(f, h, offsets, 0, int(h["ids"])).astype("<u4")
                raw = memoryview(ids.tobytes())
                first = first.astype(np.int64)
                ends = np.append(first[1:], len(ids))
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first.tolist(), ends.tolist(), strict=True)), np.int64, len(first))
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(first + before), pa.array(ends - first), pa.array(crc)], schema=schema)

    spread = files.select("file", "before").repartition(partitions(files.sparkSession), "file")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(docs: DataFrame) -> str:
    return f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/packed-ids-{uuid.uuid4().hex}"
