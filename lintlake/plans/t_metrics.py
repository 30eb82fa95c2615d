"""Structure, metrics, hotspots and rollups over the given tables: documents, pages, conversations, events, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.plans.catalog import query
from lintlake.sources import corpus

TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>"


def _t(spark, sf_dir, name) -> DataFrame:
    return corpus.table(spark, sf_dir, name)


@query("s01_table_scan", "SELECT 'documents.parquet' AS file, count(*) AS n_rows, CAST(sum(octet_length(encode(text))) AS BIGINT) AS text_bytes, count(DISTINCT source) AS n_sources FROM documents")
def s01_table_scan(spark, sf_dir):
    """The given folder as it is: rows and bytes per table of files, no tree is written."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "source", F.col("_metadata.file_path").alias("path"))
    file = F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]*)?$", 1)
    return d.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("text")).alias("text_bytes"), F.count_distinct("source").alias("n_sources"))


@query("s02_event_quarantine", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_valid(props)) AS good, count(*) FILTER (WHERE NOT json_valid(props)) AS bad, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def s02_event_quarantine(spark, sf_dir):
    """Rows whose properties do not parse are counted apart and the rest go on."""
    ev = _t(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p.k").isNotNull()).alias("good"), F.count_if(F.col("p.k").isNull()).alias("bad"), F.sum("p.k").alias("total"))


@query("x01_document_lines", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS total_lines, CAST(count(*) FILTER (WHERE trim(line) <> '') AS BIGINT) AS nonblank_lines,
       CAST(count(DISTINCT line) AS BIGINT) AS distinct_lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def x01_document_lines(spark, sf_dir):
    """Lines of every document; array functions on the row, no shuffle."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("total_lines"), F.size(F.filter("l", lambda x: F.trim(x) != "")).cast("long").alias("nonblank_lines"),
                    F.size(F.array_distinct("l")).cast("long").alias("distinct_lines"))


@query("m06_page_tag_depth", r"""
WITH t AS (
  SELECT page_id, unnest(generate_series(1, len(tags))) AS pos, unnest(tags) AS tag
  FROM (SELECT page_id, regexp_extract_all(html, '<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 0) AS tags FROM pages)),
d AS (
  SELECT page_id, pos, sum(CASE WHEN starts_with(tag, '</') THEN -1 WHEN regexp_matches(lower(tag), '^<(br|img|hr|meta|link|input)\b') OR ends_with(tag, '/>') THEN 0
                                ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM t)
SELECT p.page_id, CAST(greatest(coalesce(max(d.depth), 0), 0) AS BIGINT) AS max_depth FROM pages p LEFT JOIN d ON d.page_id = p.page_id GROUP BY p.page_id""")
def m06_page_tag_depth(spark, sf_dir):
    """Deepest tag nesting of every page, one pass over the page's own tags, no shuffle."""
    step = lambda t: (F.when(t.startswith("</"), -1).when(F.lower(t).rlike(r"^<(br|img|hr|meta|link|input)\b") | t.endswith("/>"), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def walk(s, t):
        depth = s["depth"] + step(t)
        return F.struct(depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"))

    tags = F.regexp_extract_all("html", F.lit(TAG), 0)
    return _t(spark, sf_dir, "pages").select("page_id", F.aggregate(tags, start, walk)["deepest"].cast("long").alias("max_depth"))


@query("x05_page_tag_kinds", r"""
SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag""")
def x05_page_tag_kinds(spark, sf_dir):
    """Kinds of markup over all pages; counted per page first, so a hot kind is aggregated before the shuffle."""
    t = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag"))
    per = t.groupBy(F.lower("tag").alias("tag"), "page_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("tag").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("pages"))


@query("v03_page_scripts", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<script[^>]*>')) AS BIGINT) AS scripts, CAST(len(regexp_extract_all(html, ' on[a-z]+=')) AS BIGINT) AS handlers,
       regexp_matches(html, '<script[^>]*>[^<]*</p>') AS closes_in_script FROM pages""")
def v03_page_scripts(spark, sf_dir):
    """Inline scripts and handlers of every page, and scripts that hold a closing tag in a string."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return _t(spark, sf_dir, "pages").select("page_id", n("<script[^>]*>").alias("scripts"), n(" on[a-z]+=").alias("handlers"), F.col("html").rlike("<script[^>]*>[^<]*</p>").alias("closes_in_script"))


@query("l05_turn_order", """
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(turn) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = before) AS repeated_roles, count(*) FILTER (WHERE turn <> coalesce(last, -1) + 1) AS gaps,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM t GROUP BY conv_id""")
def l05_turn_order(spark, sf_dir):
    """Conversations whose turns repeat a role, leave a gap, or start or end with the wrong side."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lag("turn").over(w).alias("last"))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == F.col("before")).alias("repeated_roles"),
                                    F.count_if(F.col("turn") != F.coalesce("last", F.lit(-1)) + 1).alias("gaps"),
                                    F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"))


@query("x22_answer_facts", r"""
SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^ \n]+')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(text, '[.!?]( |\n|$)')) AS BIGINT) AS n_sentences,
       contains(text, '?') AS asks, trim(split_part(text, '.', 1)) AS opening FROM conversations WHERE role = 'assistant'""")
def x22_answer_facts(spark, sf_dir):
    """Facts parsed from every assistant turn; a filtered scan without a shuffle."""
    a = _t(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return a.select("conv_id", "turn", F.regexp_count("text", F.lit("[^ \n]+")).cast("long").alias("n_words"), F.regexp_count("text", F.lit("[.!?]( |\n|$)")).cast("long").alias("n_sentences"),
                    F.contains("text", F.lit("?")).alias("asks"), F.trim(F.split_part("text", F.lit("."), F.lit(1))).alias("opening"))


@query("d10_turn_duplication", """
SELECT role, count(*) AS turns, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS repeated, count(*) FILTER (WHERE n > 1) AS groups, max(n) AS largest FROM (
  SELECT role, sha256(text) AS h, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY role""")
def d10_turn_duplication(spark, sf_dir):
    """Share of turns whose text occurs more than once, per role (hash first, two aggregations)."""
    g = _t(spark, sf_dir, "conversations").groupBy("role", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("repeated"), F.count_if(F.col("n") > 1).alias("groups"), F.max("n").alias("largest"))


# Hotspots over customers: metric, threshold, and the bounds of medium, high and critical.
LIMITS = (("orders", 12.0, 15.0, 18.0, 22.0), ("open_value", 1000000.0, 1500000.0, 2000000.0, 3000000.0), ("max_discount_share", 0.35, 0.4, 0.5, 0.6))
ADVICE = {"critical": "review the account today", "high": "review the account this week", "medium": "watch the account", "low": "nothing to do"}
_METRICS = """
WITH li AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount >= 0.08) AS deep FROM lineitem GROUP BY l_orderkey),
m AS (
  SELECT o_custkey, CAST(count(*) AS DOUBLE) AS orders, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0.0) AS open_value,
         coalesce(CAST(sum(deep) AS DOUBLE) / sum(n), 0.0) AS max_discount_share FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY o_custkey),
v AS (SELECT o_custkey, 'orders' AS metric, orders AS value FROM m UNION ALL SELECT o_custkey, 'open_value', open_value FROM m UNION ALL SELECT o_custkey, 'max_discount_share', max_discount_share FROM m),
hs AS (
  SELECT o_custkey, metric, round(value, 4) AS value, l.threshold, CASE WHEN value >= l.critical THEN 'critical' WHEN value >= l.high THEN 'high' WHEN value >= l.medium THEN 'medium' ELSE 'low' END AS severity
  FROM v JOIN (VALUES ('orders', {t0}, 15.0, 18.0, 22.0), ('open_value', 1000000.0, 1500000.0, 2000000.0, 3000000.0), ('max_discount_share', 0.35, 0.4, 0.5, 0.6))
    l(name, threshold, medium, high, critical) ON l.name = metric WHERE value > l.threshold)
"""


def _customer_metrics(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") >= 0.08).alias("deep"))
    o = _t(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    zero = F.lit(0.0)
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), zero).alias("open_value"),
                                      F.coalesce(F.sum("deep").cast("double") / F.sum("n"), zero).alias("max_discount_share"))


def _hotspots(spark, sf_dir, override: dict[str, float] | None = None) -> DataFrame:
    """One row per customer and metric over its threshold, with the band; thresholds can be overridden by name."""
    rows = []
    for name, threshold, medium, high, critical in LIMITS:
        v = F.col(name)
        band = F.when(v >= critical, "critical").when(v >= high, "high").when(v >= medium, "medium").otherwise("low")
        rows.append(F.struct(F.lit(name).alias("metric"), v.alias("raw"), F.round(v, 4).alias("value"), F.lit(float((override or {}).get(name, threshold))).alias("threshold"), band.alias("severity")))
    return _customer_metrics(spark, sf_dir).select("o_custkey", F.inline(F.filter(F.array(*rows), lambda r: r["raw"] > r["threshold"]))).drop("raw")


def _sql(text: str, orders: str = "12.0") -> str:
    return _METRICS.format(t0=orders) + text


_CASE = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query("h01_h07_customer_hotspots", _sql("SELECT o_custkey, metric, value, CAST(threshold AS DOUBLE) AS threshold, severity FROM hs"))
def h01_h07_customer_hotspots(spark, sf_dir):
    """Every metric of every customer against its threshold, with severity bands."""
    return _hotspots(spark, sf_dir)


@query("h08_top_hotspots_per_nation", _sql(f"""
SELECT c_nationkey, rank, o_custkey, metric, severity, value FROM (
  SELECT c_nationkey, o_custkey, metric, severity, value, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_CASE}, metric, value DESC, o_custkey) AS rank
  FROM hs JOIN customer ON c_custkey = o_custkey) WHERE rank <= 3"""))
def h08_top_hotspots_per_nation(spark, sf_dir):
    """H08 and flagship: the three worst hotspots of every nation (a top-k report)."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    hs = _hotspots(spark, sf_dir).join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(order, "metric", F.col("value").desc(), "o_custkey"))
    return hs.withColumn("rank", rank.cast("long")).filter("rank <= 3").select("c_nationkey", "rank", "o_custkey", "metric", "severity", "value")


@query("h09_customer_advice", _sql("""
SELECT metric, severity, count(*) AS n, CASE severity WHEN 'critical' THEN 'review the account today' WHEN 'high' THEN 'review the account this week'
       WHEN 'medium' THEN 'watch the account' ELSE 'nothing to do' END AS advice FROM hs GROUP BY metric, severity"""))
def h09_customer_advice(spark, sf_dir):
    """Hotspots per band with the band's advice."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return _hotspots(spark, sf_dir).groupBy("metric", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("advice", advice[F.col("severity")])


@query("h10_customer_overrides", _sql("SELECT o_custkey, metric, value, CAST(threshold AS DOUBLE) AS threshold FROM hs", "8.0"))
def h10_customer_overrides(spark, sf_dir):
    """A stricter threshold for one metric, the others as they are."""
    return _hotspots(spark, sf_dir, {"orders": 8.0}).drop("severity")


@query("m08_nation_summary", _sql("""
SELECT c_nationkey, count(*) AS customers, round(avg(orders), 4) AS avg_orders, max(orders) AS max_orders, round(sum(open_value), 2) AS open_value
FROM m JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey"""))
def m08_nation_summary(spark, sf_dir):
    m = _customer_metrics(spark, sf_dir).join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return m.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("orders"), 4).alias("avg_orders"), F.max("orders").alias("max_orders"),
                                        F.round(F.sum("open_value"), 2).alias("open_value"))


@query("m09_severity_heatmap", _sql("SELECT c_mktsegment, metric, severity, count(*) AS n FROM hs JOIN customer ON c_custkey = o_custkey GROUP BY ALL"))
def m09_severity_heatmap(spark, sf_dir):
    hs = _hotspots(spark, sf_dir).join(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return hs.groupBy("c_mktsegment", "metric", "severity").agg(F.count(F.lit(1)).alias("n"))
