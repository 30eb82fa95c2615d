"""A link graph of the given pages: a page's topic (first heading word) points to the words its navigation links to."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import linkgraph as L
from lintlake.plans.catalog import query
from lintlake.sources import corpus

# Edges for DuckDB; lower() is applied to both sides in the same way.
EDGES = r"""
WITH RECURSIVE p AS (SELECT page_id, lower(regexp_extract(html, '<h1>([^< ]+)', 1)) AS src, regexp_extract_all(html, '<a href="/([^"]+)"', 1) AS links FROM pages),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, lower(unnest(links)) AS dst FROM p WHERE src <> '') GROUP BY ALL),
seeds AS (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)),
r AS (SELECT node AS seed, node FROM seeds UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node)
"""


def _edges(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "<h1>([^< ]+)", 1)).alias("src"), F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), 1).alias("links"))
    return p.filter("src <> ''").select("page_id", "src", F.explode("links").alias("dst")).select("page_id", "src", F.lower("dst").alias("dst"))


def _graph(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _entries(g):
    """Topics that no page links to."""
    return g.select(F.col("src").alias("node")).distinct().join(g.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def _ends(g):
    """Topics that link to no other topic."""
    known = g.select(F.col("src").alias("dst")).distinct()
    return g.select(F.col("src").alias("node")).distinct().join(g.join(known, "dst", "left_semi").select(F.col("src").alias("node")).distinct(), "node", "left_anti")


@query("g01_link_edges", EDGES + "SELECT src, dst, n FROM e")
def g01_link_edges(spark, sf_dir):
    return _graph(spark, sf_dir)


@query("g02_resolved_links", EDGES + "SELECT e.src, count(*) AS links, count(t.src) AS resolved FROM e LEFT JOIN (SELECT DISTINCT src FROM e) t ON t.src = e.dst GROUP BY e.src")
def g02_resolved_links(spark, sf_dir):
    """Per topic, its link targets and how many of them are topics of some page."""
    g = _graph(spark, sf_dir)
    known = g.select(F.col("src").alias("dst")).distinct().withColumn("hit", F.lit(1))
    return g.join(known, "dst", "left").groupBy("src").agg(F.count(F.lit(1)).alias("links"), F.count("hit").alias("resolved"))


@query("g04_reachable_topics", EDGES + "SELECT seed, count(*) AS reached FROM r GROUP BY seed")
def g04_reachable_topics(spark, sf_dir):
    """What every entry topic reaches, by appending frontiers; what hubs reach is counted once."""
    g = _graph(spark, sf_dir)
    return L.reached_counts(g, _entries(g))


@query("g05_dependent_topics", EDGES.replace("JOIN e ON e.src = r.node", "JOIN e ON e.dst = r.node").replace("SELECT r.seed, e.dst", "SELECT r.seed, e.src")
       .replace("SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)", "SELECT src AS node FROM e GROUP BY src HAVING count(*) FILTER (WHERE dst IN (SELECT src FROM e)) = 0")
       + "SELECT seed, count(*) - 1 AS dependents FROM r GROUP BY seed")
def g05_dependent_topics(spark, sf_dir):
    """The reverse closure: topics from which a topic without links to others can be reached."""
    g = _graph(spark, sf_dir)
    return L.reached_counts(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), _ends(g)).select("seed", (F.col("reached") - 1).alias("dependents"))


@query("g06_topic_cycles", EDGES.replace("r AS (SELECT node AS seed, node FROM seeds UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node)",
                "r AS (SELECT src AS seed, dst AS node, 1 AS d FROM e UNION SELECT r.seed, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.node WHERE r.node <> r.seed AND r.d < 12)")
       + "SELECT seed AS node, CAST(min(d) AS BIGINT) AS length FROM r WHERE node = seed GROUP BY seed")
def g06_topic_cycles(spark, sf_dir):
    """The shortest cycle through every topic that lies on one, after trimming everything that can't."""
    return L.shortest_cycles(_graph(spark, sf_dir))


@query("g10_topic_coupling", EDGES + """
SELECT coalesce(o.src, i.dst) AS node, coalesce(o.k, 0) AS efferent, coalesce(i.k, 0) AS afferent, round(coalesce(o.k, 0) / (coalesce(o.k, 0) + coalesce(i.k, 0)), 4) AS instability
FROM (SELECT src, count(*) AS k FROM e GROUP BY src) o FULL JOIN (SELECT dst, count(*) AS k FROM e GROUP BY dst) i ON o.src = i.dst""")
def g10_topic_coupling(spark, sf_dir):
    g = _graph(spark, sf_dir)
    ends = g.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(g.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    k = ends.groupBy("node").agg(F.sum("o").alias("efferent"), F.sum("i").alias("afferent"))
    return k.withColumn("instability", F.round(F.col("efferent") / (F.col("efferent") + F.col("afferent")), 4))


@query("s07_graph_nodes", EDGES + "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def s07_graph_nodes(spark, sf_dir):
    """The node table of the graph export (its edge table is G01)."""
    g = _graph(spark, sf_dir)
    return g.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query("g06_cycle_components", EDGES + """,
t AS (SELECT src AS seed, dst AS node FROM e UNION SELECT t.seed, e.dst FROM t JOIN e ON e.src = t.node),
scc AS (SELECT a.seed AS node, min(a.node) AS component FROM t a JOIN t b ON b.seed = a.node AND b.node = a.seed GROUP BY a.seed),
inn AS (SELECT DISTINCT a.component, e.src, e.dst FROM e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.component = b.component),
d AS (SELECT DISTINCT component, component AS node, 0 AS lvl FROM scc UNION SELECT d.component, inn.dst, d.lvl + 1 FROM d JOIN inn ON inn.component = d.component AND inn.src = d.node WHERE d.lvl < 12),
f AS (SELECT component, node, min(lvl) AS lvl FROM d GROUP BY ALL),
pred AS (SELECT i.component, i.dst, min(i.src) AS src FROM inn i JOIN f u ON u.component = i.component AND u.node = i.src JOIN f v ON v.component = i.component AND v.node = i.dst WHERE u.lvl = v.lvl - 1 GROUP BY ALL),
ends AS (SELECT i.component, min(struct_pack(lvl := f.lvl, node := i.src)) AS z FROM inn i JOIN f ON f.component = i.component AND f.node = i.src WHERE i.dst = i.component GROUP BY ALL),
way AS (SELECT component, z.node AS at, z.lvl AS lvl, [z.node, component] AS path FROM ends
      UNION ALL SELECT p.component, pred.src, p.lvl - 1, list_concat([pred.src], p.path) FROM way p JOIN pred ON pred.component = p.component AND pred.dst = p.at WHERE p.lvl > 0)
SELECT p.component, (SELECT count(*) FROM scc WHERE scc.component = p.component) AS size, CAST(len(path) - 1 AS BIGINT) AS length, array_to_string(path, ' > ') AS path FROM way p WHERE lvl = 0""")
def g06_cycle_components(spark, sf_dir):
    """The components of topics that link to each other in circles, with a shortest cycle through each one's first topic."""
    g = _graph(spark, sf_dir)
    out = L.cycles_through(g, L.cycle_components(g))
    return out.select("component", "size", "length", F.array_join("path", " > ").alias("path"))


HOST_FOLDERS = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(html, '<h1>([^< ]+)', 1)) AS topic, [lower(x) FOR x IN regexp_extract_all(html, '<a href="/([^"]+)"', 1)] AS links,
         list_concat(list_reverse(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.')),
                     string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]*/(.*/)?[^/]*$', 1), '/'), '/')) AS raw FROM pages),
b AS (SELECT page_id, topic, links, list_filter(raw, lambda x: x <> '') AS base FROM p)
"""


def _placed(spark, sf_dir):
    """Pages in a tree of folders: the host's labels from the top domain down, then the folders of the path."""
    p = corpus.table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    folders = F.trim(F.regexp_extract("url", "^[a-z]+://[^/?#]*/(.*/)?[^/]*$", 1), F.lit("/"))
    base = F.filter(F.concat(F.reverse(F.split(host, "[.]")), F.split(folders, "/")), lambda x: x != "")
    return p.select("page_id", F.lower(F.regexp_extract("html", "<h1>([^< ]+)", 1)).alias("topic"), base.alias("base"), F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), 1), F.lower).alias("links"))


@query("g02_links_near_to_far", HOST_FOLDERS + """,
k AS (SELECT DISTINCT list_concat(base[1:len(base) - u], [topic]) AS path FROM (SELECT base, topic, unnest(range(0, len(base) + 1)) AS u FROM b WHERE topic <> '')),
l AS (SELECT DISTINCT page_id, name, base FROM (SELECT page_id, base, unnest(links) AS name FROM b)),
t AS (SELECT page_id, base, name, u, list_concat(base[1:len(base) - u], [name]) AS path FROM (SELECT page_id, base, name, unnest(range(0, len(base) + 1)) AS u FROM l)),
h AS (SELECT page_id, base, name, min(u) AS level, arg_min(t.path, u) AS path FROM t JOIN k ON k.path = t.path GROUP BY ALL)
SELECT l.page_id, l.name, array_to_string(h.path, '/') AS target, CAST(h.level AS INTEGER) AS level
FROM l LEFT JOIN h ON h.page_id = l.page_id AND h.name = l.name AND h.base = l.base""")
def g02_links_near_to_far(spark, sf_dir):
    """A link's topic is looked up in the page's folder, then in every folder above, up to the whole web; each folder
    knows the topics of all pages below it.  Unresolved links stay with null."""
    p = _placed(spark, sf_dir)
    scopes = p.filter("topic <> ''").select("topic", "base", F.explode(F.sequence(F.lit(0), F.size("base"))).alias("u"))
    known = scopes.select(F.concat(F.slice("base", F.lit(1), F.size("base") - F.col("u")), F.array("topic")).alias("path"))
    links = p.select("page_id", "base", F.explode("links").alias("n")).select("page_id", F.col("n").alias("text"), "base", F.array("n").alias("name")).distinct()
    out = L.resolve_near_to_far(links, known)
    return out.select("page_id", F.col("text").alias("name"), F.array_join("target", "/").alias("target"), "level")
