"""Small fixtures and plain-Python versions of the contracts."""

import re
import zlib

DDL = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, size long, h long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc(i, text, lang="en", source="a"):
    """One row with extra columns whose names operators also use inside."""
    return (i, text, lang, source, len(text) if text is not None else None, 7, "extra", 1, 2)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def remainder(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
