"""The element tree of the given pages: kinds by parent, depth, flow, containment, slices and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import tagtree as T
from lintlake.plans.catalog import query
from lintlake.sources import corpus

# The stack walk for DuckDB: one step per tag.  ``made`` marks the steps that open an element.
TREE = r"""
WITH RECURSIVE raw AS (SELECT page_id, html, regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>', 0) AS f, regexp_split_to_array(html, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>') AS between FROM pages),
tok AS (
  SELECT page_id, f, [lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) FOR x IN f] AS name,
         [CASE WHEN starts_with(x, '</') THEN 'c' WHEN ends_with(x, '/>') OR lower(regexp_extract(x, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) IN ('br', 'img', 'hr', 'meta', 'link', 'input') THEN 'v' ELSE 'o' END FOR x IN f] AS kind
  FROM raw),
place AS (
  SELECT page_id, i, sum(len(g) + len(b)) OVER (PARTITION BY page_id ORDER BY i) - len(g) AS before
  FROM (SELECT page_id, unnest(generate_series(1, len(f))) AS i, unnest(f) AS g, unnest(between[1:len(f)]) AS b FROM raw)),
step AS (
  SELECT page_id, 0 AS i, CAST([] AS VARCHAR[]) AS tags, CAST([] AS BIGINT[]) AS ids, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS BIGINT) AS parent,
         CAST(NULL AS VARCHAR) AS parent_tag, 0 AS depth, false AS made FROM tok
  UNION ALL
  SELECT page_id, i + 1, CASE WHEN skip THEN tags WHEN kd = 'o' THEN list_append(tags, nm) WHEN kd = 'c' AND back > 0 THEN tags[1:len(tags) - back] ELSE tags END,
         CASE WHEN skip THEN ids WHEN kd = 'o' THEN list_append(ids, n + 1) WHEN kd = 'c' AND back > 0 THEN ids[1:len(ids) - back] ELSE ids END,
         CASE WHEN skip OR kd = 'c' THEN n ELSE n + 1 END, nm, ids[len(ids)], tags[len(tags)], CAST(len(tags) + 1 AS INTEGER), NOT skip AND kd <> 'c'
  FROM (
    SELECT s.*, t.name[i + 1] AS nm, t.kind[i + 1] AS kd, coalesce(list_position(list_reverse(tags), t.name[i + 1]), 0) AS back,
           coalesce(tags[len(tags)] IN ('script', 'style') AND NOT (t.kind[i + 1] = 'c' AND t.name[i + 1] = tags[len(tags)]), false) AS skip
    FROM step s JOIN tok t ON t.page_id = s.page_id WHERE s.i < len(t.f))),
el AS (SELECT page_id, i, n, tag, parent, parent_tag, depth FROM step WHERE made),
ranges AS (SELECT a.page_id, a.n, a.tag, coalesce(min(b.n) - 1, a.most) AS last
           FROM (SELECT *, max(n) OVER (PARTITION BY page_id) AS most FROM el) a LEFT JOIN el b ON b.page_id = a.page_id AND b.n > a.n AND b.depth <= a.depth GROUP BY a.page_id, a.n, a.tag, a.most)
"""
REPEATING = ("ul", "ol", "table", "tbody", "tr", "article", "nav")
HEADINGS = {"title": "title", "nav": "navigation", "h1": "article", "h2": "article", "h3": "article"}
CLOSING = ("h4", "h5", "h6", "div", "footer")


def _pages(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages")


def _elements(spark, sf_dir):
    return T.elements(_pages(spark, sf_dir))


@query("x05_page_kinds_by_parent", TREE + "SELECT tag, coalesce(parent_tag, '') AS parent_tag, count(*) AS n FROM el GROUP BY ALL")
def x05_page_kinds_by_parent(spark, sf_dir):
    """Elements by kind and kind of their parent."""
    return T.kinds_by_parent(_elements(spark, sf_dir))


@query("m06_deepest_element", TREE + """
SELECT m.page_id, depth, n, tag, CAST(before AS BIGINT) AS starts
FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, n) = 1) m JOIN place p ON p.page_id = m.page_id AND p.i = m.i""")
def m06_deepest_element(spark, sf_dir):
    """The deepest element of every page, what it is and where it starts."""
    return T.deepest(_elements(spark, sf_dir))


@query("x21_page_flow", TREE + f"""
, s AS (SELECT *, lead(tag) OVER w AS after_tag, lag(n) OVER w AS before_n, lead(n) OVER w AS after_n FROM el WINDOW w AS (PARTITION BY page_id, parent ORDER BY n))
SELECT kind, src_tag, dst_tag, count(*) AS n FROM (
  SELECT 'next' AS kind, tag AS src_tag, after_tag AS dst_tag FROM s WHERE after_n IS NOT NULL
  UNION ALL SELECT 'child', parent_tag, tag FROM s WHERE parent IS NOT NULL AND before_n IS NULL
  UNION ALL SELECT 'back', tag, parent_tag FROM s WHERE after_n IS NULL AND parent_tag IN {REPEATING}) GROUP BY ALL""")
def x21_page_flow(spark, sf_dir):
    """Flow edges between elements, by kind and the kinds they join."""
    return T.flow_edges(_elements(spark, sf_dir), REPEATING).groupBy("kind", "src_tag", "dst_tag").agg(F.count(F.lit(1)).alias("n"))


@query("p01_links_inside_lists", TREE + """
SELECT a.page_id, r.n AS list_n, r.tag AS list_tag, count(*) AS links, min(a.n) AS first_link
FROM el a JOIN ranges r ON r.page_id = a.page_id AND r.tag IN ('ul', 'ol', 'nav') AND r.n < a.n AND a.n <= r.last
WHERE a.tag = 'a' AND NOT EXISTS (SELECT 1 FROM ranges z WHERE z.page_id = a.page_id AND z.tag IN ('ul', 'ol', 'nav') AND z.n > r.n AND z.n < a.n AND a.n <= z.last)
GROUP BY ALL""")
def p01_links_inside_lists(spark, sf_dir):
    """Links inside a repeating element, counted at the innermost one."""
    e = _elements(spark, sf_dir).select("page_id", "n", "tag", "last")
    lists = e.filter(F.col("tag").isin("ul", "ol", "nav"))
    inside = T.innermost(e.filter("tag = 'a'"), lists).filter("outer IS NOT NULL").groupBy("page_id", F.col("outer").alias("list_n")).agg(F.count(F.lit(1)).alias("links"), F.min("n").alias("first_link"))
    return inside.join(lists.select("page_id", F.col("n").alias("list_n"), F.col("tag").alias("list_tag")), ["page_id", "list_n"])


@query("p02_blocks_inside_blocks", TREE + """
, o AS (SELECT i.page_id, i.n, max(r.n) AS outer_n, count(*) AS levels FROM ranges i JOIN ranges r ON r.page_id = i.page_id AND r.tag IN ('ul', 'ol', 'div', 'p') AND r.n < i.n AND i.n <= r.last
        WHERE i.tag IN ('ul', 'ol', 'div', 'p') GROUP BY ALL)
SELECT page_id, outer_n, count(*) AS blocks, min(n) AS first_inner, CAST(max(levels) AS INTEGER) AS levels FROM o GROUP BY ALL""")
def p02_blocks_inside_blocks(spark, sf_dir):
    """Blocks that directly hold blocks: how many, the first of them, and how deep they lie."""
    blocks = _elements(spark, sf_dir).filter(F.col("tag").isin("ul", "ol", "div", "p")).select("page_id", "n", "last")
    inner = T.innermost(blocks, blocks).filter("outer IS NOT NULL")
    return inner.groupBy("page_id", F.col("outer").alias("outer_n")).agg(F.count(F.lit(1)).alias("blocks"), F.min("n").alias("first_inner"), F.max("levels").alias("levels"))


@query("x15_article_source", TREE + """
, a AS (SELECT * FROM el WHERE tag = 'article' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) = 1),
z AS (SELECT a.page_id, a.n, a.i, min(s.i) AS closed FROM a LEFT JOIN step s ON s.page_id = a.page_id AND s.i > a.i AND NOT list_contains(s.ids, a.n) GROUP BY ALL)
SELECT z.page_id, z.n, CAST(len(t) AS INTEGER) AS n_chars, md5(t) AS source_md5 FROM (
  SELECT z.page_id, z.n, raw.html[b.before + 1:coalesce(c.before + CASE WHEN tok.name[z.closed] = 'article' THEN len(tok.f[z.closed]) ELSE 0 END, len(raw.html))] AS t
  FROM z JOIN raw ON raw.page_id = z.page_id JOIN tok ON tok.page_id = z.page_id JOIN place b ON b.page_id = z.page_id AND b.i = z.i LEFT JOIN place c ON c.page_id = z.page_id AND c.i = z.closed) z""")
def x15_article_source(spark, sf_dir):
    """The source of every page's first article, whole."""
    s = T.slices(_elements(spark, sf_dir), _pages(spark, sf_dir), "article")
    return s.select("page_id", "n", F.char_length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("source_md5"))


@query("c02_lines_under_headings", TREE + """
, m AS (SELECT page_id, n, tag, CASE WHEN tag = 'title' THEN 'title' WHEN tag = 'nav' THEN 'navigation' WHEN tag IN ('h1', 'h2', 'h3') THEN 'article' WHEN tag IN ('h4', 'h5', 'h6', 'div', 'footer') THEN '' END AS mark FROM el),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n) AS section FROM m)
SELECT page_id, section, n, tag FROM s WHERE tag IN ('p', 'li', 'br') AND section <> ''""")
def c02_lines_under_headings(spark, sf_dir):
    """Paragraphs and items under the latest heading; any other heading, box or footer ends its section."""
    return T.under_headings(_elements(spark, sf_dir), HEADINGS, CLOSING, F.col("tag").isin("p", "li", "br"))
