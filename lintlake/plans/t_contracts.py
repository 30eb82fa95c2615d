"""Contracts, boundaries, size guards and document metrics over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.plans.catalog import query
from lintlake.plans.t_findings import FIND, _find
from lintlake.plans.t_graph import EDGES, _graph
from lintlake.sources import corpus


def _t(spark, sf_dir, name) -> DataFrame:
    return corpus.table(spark, sf_dir, name)


_CONTRACTS = """
WITH j AS (SELECT l.*, o_orderdate, o_totalprice, o_orderkey FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey),
v AS (
  SELECT l_orderkey, l_linenumber, 'quantity_positive' AS contract, 'precondition' AS kind, NOT coalesce(l_quantity > 0, false) AS broken FROM j
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount_at_most_8_percent', 'precondition', NOT coalesce(l_discount <= 0.08, false) FROM j
  UNION ALL SELECT l_orderkey, l_linenumber, 'order_exists', 'invariant', o_orderkey IS NULL FROM j
  UNION ALL SELECT l_orderkey, l_linenumber, 'shipped_after_order', 'postcondition', NOT coalesce(l_shipdate >= o_orderdate, false) FROM j
  UNION ALL SELECT l_orderkey, l_linenumber, 'line_below_order_total', 'invariant', NOT coalesce(l_extendedprice <= o_totalprice, false) FROM j)
"""


def _contract_checks(spark, sf_dir) -> DataFrame:
    """One row per line item and contract; the contracts are expressions over one joined row."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    j = _t(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    holds = [("quantity_positive", "precondition", F.col("l_quantity") > 0), ("discount_at_most_8_percent", "precondition", F.col("l_discount") <= 0.08),
             ("order_exists", "invariant", F.col("o_orderkey").isNotNull()), ("shipped_after_order", "postcondition", F.col("l_shipdate") >= F.col("o_orderdate")),
             ("line_below_order_total", "invariant", F.col("l_extendedprice") <= F.col("o_totalprice"))]
    rows = [F.struct(F.lit(n).alias("contract"), F.lit(k).alias("kind"), (~F.coalesce(c, F.lit(False))).alias("broken")) for n, k, c in holds]
    return j.select("l_orderkey", "l_linenumber", F.inline(F.array(*rows)))


@query("c05_line_contracts", _CONTRACTS + "SELECT contract, kind, count(*) AS checked, count(*) FILTER (WHERE broken) AS broken FROM v GROUP BY contract, kind")
def c05_line_contracts(spark, sf_dir):
    """Every declared contract with the rows that it was checked on and that break it."""
    return _contract_checks(spark, sf_dir).groupBy("contract", "kind").agg(F.count(F.lit(1)).alias("checked"), F.count_if("broken").alias("broken"))


@query("c06_broken_contracts", _CONTRACTS + "SELECT l_orderkey, count(*) AS broken, min(contract) AS first_contract FROM v WHERE broken GROUP BY l_orderkey HAVING count(*) >= 3")
def c06_broken_contracts(spark, sf_dir):
    """Orders that break contracts three times or more."""
    b = _contract_checks(spark, sf_dir).filter("broken").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("broken"), F.min("contract").alias("first_contract"))
    return b.filter("broken >= 3")


@query("c14_order_invariants", """
WITH s AS (SELECT l_orderkey, count(*) AS lines, max(l_linenumber) AS top, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_orderkey)
SELECT o_orderstatus, count(*) AS orders, count(l_orderkey) AS with_lines, count(*) FILTER (WHERE lines <> numbers) AS repeated_numbers, count(*) FILTER (WHERE top > 7) AS numbers_over_7
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def c14_order_invariants(spark, sf_dir):
    """Invariants of whole orders, summarised by status; lines are aggregated before the join."""
    s = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.max("l_linenumber").alias("top"), F.size(F.collect_set("l_linenumber")).alias("numbers"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.count("l_orderkey").alias("with_lines"), F.count_if(F.col("lines") != F.col("numbers")).alias("repeated_numbers"),
                                          F.count_if(F.col("top") > 7).alias("numbers_over_7"))


@query("c02_page_sections", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs,
       CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, regexp_matches(html, '<article') AS has_article FROM pages""")
def c02_page_sections(spark, sf_dir):
    """The outline of every page; no shuffle."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return _t(spark, sf_dir, "pages").select("page_id", n("<h[1-6][^>]*>").alias("headings"), n("<p[ >]").alias("paragraphs"), n("<li[ >]").alias("items"),
                                             F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.col("html").rlike("<article").alias("has_article"))


@query("x17_page_language", r"""
SELECT declared, path_lang, count(*) AS n, declared = path_lang AS same FROM (
  SELECT regexp_extract(html, '<html lang="([a-z]*)"', 1) AS declared, regexp_extract(url, '://[^/]+/([a-z][a-z])/', 1) AS path_lang FROM pages) GROUP BY ALL""")
def x17_page_language(spark, sf_dir):
    """The language a page declares against the one its path names."""
    p = _t(spark, sf_dir, "pages").select(F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("declared"), F.regexp_extract("url", "://[^/]+/([a-z][a-z])/", 1).alias("path_lang"))
    return p.groupBy("declared", "path_lang").agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.col("declared") == F.col("path_lang"))


@query("b01_page_boundaries", r"""
SELECT kind, count(*) FILTER (WHERE n > 0) AS pages, CAST(sum(n) AS BIGINT) AS hits, CAST(max(n) AS BIGINT) AS most FROM (
  SELECT 'link_out' AS kind, len(regexp_extract_all(html, 'href="/')) AS n FROM pages UNION ALL SELECT 'script', len(regexp_extract_all(html, '<script')) FROM pages
  UNION ALL SELECT 'style', len(regexp_extract_all(html, '<style')) FROM pages UNION ALL SELECT 'comment', len(regexp_extract_all(html, '<!--')) FROM pages
  UNION ALL SELECT 'form_input', len(regexp_extract_all(html, '<(form|input|textarea)[ >]')) FROM pages) GROUP BY kind""")
def b01_page_boundaries(spark, sf_dir):
    """Where pages take in or hand out content, by kind; one scan, one aggregation."""
    kinds = (("link_out", 'href="/'), ("script", "<script"), ("style", "<style"), ("comment", "<!--"), ("form_input", "<(form|input|textarea)[ >]"))
    rows = [F.struct(F.lit(k).alias("kind"), F.regexp_count("html", F.lit(p)).cast("long").alias("n")) for k, p in kinds]
    p = _t(spark, sf_dir, "pages").select(F.inline(F.array(*rows)))
    return p.groupBy("kind").agg(F.count_if(F.col("n") > 0).alias("pages"), F.sum("n").alias("hits"), F.max("n").alias("most"))


@query("x20_size_guards", """
SELECT reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT CASE WHEN octet_length(encode(text)) > 16384 THEN 'document_too_large' WHEN len(string_split(text, chr(10))) > 200 THEN 'too_many_lines' ELSE 'checked' END AS reason,
         octet_length(encode(text)) AS size FROM documents) GROUP BY reason""")
def x20_size_guards(spark, sf_dir):
    """Documents that costly checks would leave out, by reason."""
    size = F.octet_length("text")
    reason = F.when(size > 16384, "document_too_large").when(F.size(F.split("text", "\n")) > 200, "too_many_lines").otherwise("checked")
    return _t(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


@query("m05_document_metrics", r"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_words, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS stops,
       CAST(coalesce(list_max(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS longest_word
FROM (SELECT doc_id, text, regexp_extract_all(text, '[^ \n]+') AS w FROM documents)""")
def m05_document_metrics(spark, sf_dir):
    """Size and vocabulary of every document; array functions, no shuffle."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit("[^ \n]+"), 0).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"),
                    F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("stops"), F.coalesce(F.array_max(F.transform("w", F.length)), F.lit(0)).cast("long").alias("longest_word"))


@query("q01_long_lines", """
SELECT doc_id, count(*) AS lines, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 500 GROUP BY doc_id""")
def q01_long_lines(spark, sf_dir):
    """Q01-Q03: documents with lines over 500 characters; the lines never leave their row."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), F.length), lambda n: n > 500).alias("n"))
    return d.filter(F.size("n") > 0).select("doc_id", F.size("n").cast("long").alias("lines"), F.array_max("n").cast("long").alias("longest"))


@query("d07_number_lines", """
SELECT source, count(*) AS lines, CAST(sum(n) AS BIGINT) AS numbers FROM (
  SELECT source, len(regexp_extract_all(line, '[0-9]+')) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE n > 0 GROUP BY source""")
def d07_number_lines(spark, sf_dir):
    """Lines that hold bare numbers, per source; counted on the row, then one aggregation."""
    counts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_count(x, F.lit("[0-9]+"))), lambda n: n > 0)
    d = _t(spark, sf_dir, "documents").select("source", counts.alias("n")).filter(F.size("n") > 0)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    return d.groupBy("source").agg(F.sum(F.size("n")).alias("lines"), F.sum(total).alias("numbers"))


@query("r08_findings_per_line", FIND + "SELECT doc_id, line_no, count(*) AS n FROM f GROUP BY doc_id, line_no")
def r08_findings_per_line(spark, sf_dir):
    return _find(spark, sf_dir).groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n"))


@query("r11_selected_rules", FIND + "SELECT rule, count(*) AS n FROM f WHERE category IN ('security', 'privacy') GROUP BY rule")
def r11_selected_rules(spark, sf_dir, categories: tuple[str, ...] = ("security", "privacy")):
    """Only the rules of the chosen categories are evaluated."""
    from lintlake.operators import textrules as T

    rules = tuple(r for r in T.RULES if r.category in categories)
    return T.findings(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", rules=rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("r12_contract_and_boundary_totals", _CONTRACTS + r""", b AS (SELECT CAST(sum(len(regexp_extract_all(html, '<script'))) AS BIGINT) AS n FROM pages)
SELECT 'contracts_broken' AS measure, count(*) FILTER (WHERE broken) AS value FROM v UNION ALL SELECT 'page_scripts', n FROM b""")
def r12_contract_and_boundary_totals(spark, sf_dir):
    a = _contract_checks(spark, sf_dir).agg(F.lit("contracts_broken").alias("measure"), F.count_if("broken").alias("value"))
    b = _t(spark, sf_dir, "pages").agg(F.lit("page_scripts").alias("measure"), F.sum(F.regexp_count("html", F.lit("<script"))).alias("value"))
    return reduce(DataFrame.unionByName, [a, b])


@query("g11_hub_topics", EDGES + "SELECT src AS topic, count(*) AS efferent, CASE WHEN count(*) >= 24 THEN 'critical' WHEN count(*) >= 16 THEN 'high' ELSE 'medium' END AS severity FROM e GROUP BY src HAVING count(*) >= 8")
def g11_hub_topics(spark, sf_dir):
    """Topics that link to many others, with severity."""
    g = _graph(spark, sf_dir).groupBy(F.col("src").alias("topic")).agg(F.count(F.lit(1)).alias("efferent")).filter("efferent >= 8")
    return g.withColumn("severity", F.when(F.col("efferent") >= 24, "critical").when(F.col("efferent") >= 16, "high").otherwise("medium"))


@query("g13_mutual_links", EDGES + "SELECT a.src AS one, a.dst AS other, a.n + b.n AS links FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def g13_mutual_links(spark, sf_dir):
    """Pairs of topics that link to one another; an edge meets only its own reverse."""
    g = _graph(spark, sf_dir)
    pair = g.filter("src <> dst").groupBy(F.least("src", "dst").alias("one"), F.greatest("src", "dst").alias("other")).agg(F.count(F.lit(1)).alias("ways"), F.sum("n").alias("links"))
    return pair.filter("ways = 2").select("one", "other", "links")
