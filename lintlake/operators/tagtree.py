"""Elements of marked-up pages as a tree: parents, preorder ranges, places; flow edges, containment and sections over them.

A page's tags are read once, with a stack (X05):

* a start tag opens an element inside the innermost open one; void elements (``VOID``, or ``/>``) hold nothing;
* an end tag closes the innermost open element of its name and, before it, those left open inside; one without such an element
  is ignored; at the end of the page all are closed;
* between the start and the end tag of ``RAW`` elements no tag counts.

The rest are window functions over the elements of a page, sorted once: nothing compares all pairs of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>")
VOID = frozenset({"br", "img", "hr", "meta", "link", "input"})
RAW = frozenset({"script", "style"})

ELEMENT = "page_id long, n long, tag string, parent long, parent_tag string, depth int, last long, starts long, ends long"


def _tree(html: str) -> list[list]:
    """[n, tag, parent, parent_tag, depth, last, starts, ends] of every element in preorder."""
    out: list[list] = []
    stack: list[list] = []
    open_names: Counter = Counter()

    def close(element: list, at: int) -> None:
        element[5], element[7] = len(out), at
        open_names[element[1]] -= 1

    for m in TAG.finditer(html):
        name = m[2].lower()
        if stack and stack[-1][1] in RAW and not (m[1] and name == stack[-1][1]):
            continue
        if m[1]:
            if open_names[name]:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == name)
                for e in stack[k + 1 :]:
                    close(e, m.start())
                close(stack[k], m.end())
                del stack[k:]
            continue
        top = stack[-1] if stack else None
        element = [len(out) + 1, name, top and top[0], top and top[1], len(stack) + 1, len(out) + 1, m.start(), m.end()]
        out.append(element)
        if name not in VOID and not m[0].endswith("/>"):
            stack.append(element)
            open_names[name] += 1
    for e in stack:
        close(e, len(html))
    return out


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n, tag, parent, parent_tag, depth, last, starts, ends): one row per element.

    ``n`` counts start tags from 1; the elements inside are ``n + 1`` to ``last``; the element is the characters from ``starts``
    (from 0) to before ``ends``.  ``parent`` is null at the top.  Pages without tags or text have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("n", pa.int64()), ("tag", pa.string()), ("parent", pa.int64()), ("parent_tag", pa.string()), ("depth", pa.int32()),
                            ("last", pa.int64()), ("starts", pa.int64()), ("ends", pa.int64())])
        for b in batches:
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                rows = _tree(html or "")
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([page] * len(rows), pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, ELEMENT)


def kinds_by_parent(e: DataFrame) -> DataFrame:
    """(tag, parent_tag, n); the parent of a top element is an empty text."""
    return e.groupBy("tag", F.coalesce("parent_tag", F.lit("")).alias("parent_tag")).agg(F.count(F.lit(1)).alias("n"))


def deepest(e: DataFrame) -> DataFrame:
    """(page_id, depth, n, tag, starts): the first of the deepest elements of every page."""
    best = e.groupBy("page_id").agg(F.min(F.struct((-F.col("depth")).alias("up"), "n", "tag", "starts")).alias("m"))
    return best.select("page_id", (-F.col("m.up")).alias("depth"), F.col("m.n").alias("n"), F.col("m.tag").alias("tag"), F.col("m.starts").alias("starts"))


def flow_edges(e: DataFrame, repeating: tuple[str, ...]) -> DataFrame:
    """(page_id, kind, src, src_tag, dst, dst_tag): from an element to its next sibling (``next``), to its first child
    (``child``), and from the last child of a ``repeating`` element back to it (``back``)."""
    w = Window.partitionBy("page_id", "parent").orderBy("n")
    s = e.select("page_id", "n", "tag", "parent", "parent_tag", F.lead("n").over(w).alias("after"), F.lead("tag").over(w).alias("after_tag"), F.lag("n").over(w).alias("before"))
    edge = lambda kind, src, src_tag, dst, dst_tag, when: F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(src_tag).alias("src_tag"), F.col(dst).alias("dst"), F.col(dst_tag).alias("dst_tag")))
    made = F.filter(F.array(
        edge("next", "n", "tag", "after", "after_tag", F.col("after").isNotNull()),
        edge("child", "parent", "parent_tag", "n", "tag", F.col("parent").isNotNull() & F.col("before").isNull()),
        edge("back", "n", "tag", "parent", "parent_tag", F.col("after").isNull() & F.col("parent_tag").isin(*repeating))), lambda x: x.isNotNull())
    return s.select("page_id", F.explode(made).alias("x")).select("page_id", "x.*")


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The containment join: (page_id, n, outer, levels) for every point (page_id, n).

    ``ranges`` (page_id, n, last) are nested or apart, as preorder ranges are.  ``outer`` is the ``n`` of the innermost range with
    n < point <= last, null without one; ``levels`` is how many contain it.  Starts, ends and points of a page are one
    sorted run: the running sum of starts less ends is the level, and the last start on a point's level is its range.
    """
    marks = ranges.select("page_id", F.col("n").alias("at"), F.lit(1).alias("step"), F.col("n").alias("id"))
    marks = marks.unionByName(ranges.select("page_id", (F.col("last") + 1).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("id")))
    marks = marks.unionByName(points.select("page_id", F.col("n").alias("at"), F.lit(0).alias("step"), F.lit(None).cast("long").alias("id")))
    in_order = Window.partitionBy("page_id").orderBy("at", "step")  # ends, then points, then starts of the same place
    leveled = marks.withColumn("levels", F.sum("step").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("step >= 0")
    same = Window.partitionBy("page_id", "levels").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = leveled.withColumn("outer", F.last("id", ignorenulls=True).over(same)).filter("step = 0")
    return found.select("page_id", F.col("at").alias("n"), F.when(F.col("levels") > 0, F.col("outer")).alias("outer"), F.col("levels").cast("int").alias("levels"))


def slices(e: DataFrame, pages: DataFrame, tag: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n, text): the source of the first element of a name on every page."""
    first = e.filter(F.col("tag") == tag).groupBy("page_id").agg(F.min(F.struct("n", "starts", "ends")).alias("f"))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return first.join(p, "page_id").select("page_id", F.col("f.n").alias("n"), F.substr("html", (F.col("f.starts") + 1).cast("int"), (F.col("f.ends") - F.col("f.starts")).cast("int")).alias("text"))


def under_headings(e: DataFrame, headings: dict[str, str], closing: tuple[str, ...], body: Column) -> DataFrame:
    """(page_id, section, n, tag): every ``body`` element under the latest heading before it.

    A tag of ``headings`` opens the section of that name, one of ``closing`` ends it; elements outside of sections are left out.
    """
    names = F.create_map(*[F.lit(x) for kv in headings.items() for x in kv])
    mark = F.when(F.col("tag").isin(*headings), F.struct(names[F.col("tag")].alias("name"))).when(F.col("tag").isin(*closing), F.struct(F.lit(None).cast("string").alias("name")))
    w = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = e.select("page_id", "n", "tag", mark.alias("mark"), body.alias("is_body")).filter("mark IS NOT NULL OR is_body")
    return lines.withColumn("section", F.last("mark", ignorenulls=True).over(w)["name"]).filter("is_body AND section IS NOT NULL").select("page_id", "section", "n", "tag")
