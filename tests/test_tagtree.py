"""The element tree, containment and sections against plain Python and hand-made pages."""

import random
import time

from pyspark.sql import functions as F

from lintlake.operators import tagtree as T


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id long, html string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tree_of_a_hand_made_page(spark):
    html = '<html><body><ul><li>a<li>b</ul></p><br><p>x<b>y</p>z<script>if (a<b) "<p>"</script><img src="i"/></body>tail'
    e = T.elements(pages(spark, html, None, "", "no tags < here", "<P>open <Br/>"))
    assert rows(e.filter("page_id = 0"), "n", "tag", "parent", "depth", "last") == [
        (1, "html", None, 1, 10), (2, "body", 1, 2, 10), (3, "ul", 2, 3, 5), (4, "li", 3, 4, 5), (5, "li", 4, 5, 5), (6, "br", 2, 3, 6), (7, "p", 2, 3, 8), (8, "b", 7, 4, 8), (9, "script", 2, 3, 9), (10, "img", 2, 3, 10)]
    at = {r["n"]: html[r["starts"] : r["ends"]] for r in e.filter("page_id = 0").collect()}
    assert at[1] == html and at[2].endswith("</body>") and at[3] == "<ul><li>a<li>b</ul>" and at[4] == "<li>a<li>b" and at[5] == "<li>b" and at[7] == "<p>x<b>y</p>" and at[8] == "<b>y"
    assert at[9] == '<script>if (a<b) "<p>"</script>' and at[6] == "<br>" and at[10] == '<img src="i"/>'
    assert rows(e.filter("page_id > 0"), "page_id", "n", "tag", "ends") == [(4, 1, "p", 13), (4, 2, "br", 13)]
    assert rows(T.kinds_by_parent(e), "tag", "parent_tag", "n")[:3] == [("b", "p", 1), ("body", "html", 1), ("br", "body", 1)]


def test_deepest_and_slices(spark):
    p = pages(spark, "<a><b></b><c><d>é</d></c></a>", "<x/>", "plain")
    e = T.elements(p)
    assert rows(T.deepest(e), "page_id", "depth", "n", "tag", "starts") == [(0, 3, 4, "d", 13), (1, 1, 1, "x", 0)]
    assert rows(T.slices(e, p, "c"), "page_id", "n", "text") == [(0, 3, "<c><d>é</d></c>")]


def test_flow_edges(spark):
    e = T.elements(pages(spark, "<ul><li><b></b></li><li></li></ul><p></p>"))
    assert rows(T.flow_edges(e, ("ul",)), "kind", "src", "dst") == [("back", 4, 1), ("child", 1, 2), ("child", 2, 3), ("next", 1, 5), ("next", 2, 4)]


def test_sections(spark):
    e = T.elements(pages(spark, "<p></p><h1></h1><p></p><h9></h9><p></p><h2></h2><p></p><h4></h4><p></p>"))
    out = T.under_headings(e, {"h1": "one", "h2": "two"}, ("h4",), F.col("tag") == "p")
    assert rows(out, "section", "n") == [("one", 3), ("one", 5), ("two", 7)]


def brute(html):
    es = T._tree(html)
    out = []
    for n, tag, *_ in es:
        if tag == "i":
            outer = [o[0] for o in es if o[1] == "u" and o[0] < n <= o[5]]
            out.append((n, max(outer, default=None), len(outer)))
    return out


def test_containment_against_all_pairs(spark):
    rnd = random.Random(3)
    htmls = ["".join(rnd.choice(["<u>", "</u>", "<i>", "</i>", "<b>", "</b>", "<br>"]) for _ in range(rnd.randint(0, 80))) for _ in range(40)]
    e = T.elements(pages(spark, *htmls))
    got = T.innermost(e.filter("tag = 'i'"), e.filter("tag = 'u'"))
    assert sorted(map(str, rows_or_none(got))) == sorted(str((k, *r)) for k, h in enumerate(htmls) for r in brute(h))
    self = T.innermost(e.filter("tag = 'u'"), e.filter("tag = 'u'"))  # a range does not hold itself
    assert self.filter("outer >= n").count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def rows_or_none(df):
    return [(r["page_id"], r["n"], r["outer"], r["levels"]) for r in df.collect()]


def test_a_page_of_many_elements_is_linear(spark):
    """Three times the elements take far less than nine times the time of the walk; deep and flat pages."""
    took = []
    for n in (20_000, 60_000):
        t = time.time()
        assert len(T._tree("<div><p>x" * n)) == 2 * n and len(T._tree("<ul>" + "<li><a></a></li>" * n + "</ul>")) == 2 * n + 1
        took.append(time.time() - t)
    assert took[1] < 6 * took[0] + 0.5
    e = T.elements(pages(spark, "<ul>" + "<li><a></a></li>" * 10_000 + "</ul>"))
    assert T.innermost(e.filter("tag = 'a'"), e.filter("tag = 'ul'")).filter("outer = 1 AND levels = 1").count() == 10_000


def test_empty(spark):
    e = T.elements(pages(spark))
    assert e.count() == 0 and T.deepest(e).count() == 0 and T.innermost(e, e).count() == 0 and T.flow_edges(e, ()).count() == 0
