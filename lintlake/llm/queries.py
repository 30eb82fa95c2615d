"""The registered queries of this subpackage: name -> (Spark plan builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm import decontam, hardnegatives, langid, mixing, ngramjoin, nndescent, packedids, packing, shardedlloyd, suffixdedup, suffixtree, threshold, urlfilter
from lintlake.llm.common import id_remainder, table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    out = langid.identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, least(len(ws), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x AS u, y AS v FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, (SELECT count(*) FROM e WHERE e.u = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


@query("op2_ngram_join", OP2_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, Jaccard of at least 0.9."""
    return ngramjoin.components(table(spark, sf_dir, "documents"), width=3, percent=90, every_link=True).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 1024 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sainte-Laguë mix of all documents by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_packed_ids")
def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as bit-packed ids in files, read back."""
    docs = table(spark, sf_dir, "documents")
    folder = packedids.new_folder(docs)
    files = packedids.write(docs, folder, tokenizer_path("word_bpe_49k.json"), vocabulary=49408)
    return packedids.digest(files, folder)


@query("op6_suffix_tree")
def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a probabilistic suffix tree of six sevenths of them."""
    out = suffixtree.score(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.col("train_tokens").cast("long").alias("train_tokens"), "base_score", "score")


@query("op7_nn_descent")
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, found by graph search, of every twentieth vector."""
    return nndescent.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q, v c WHERE c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) <= 20
"""


@query("op8_threshold", OP8_SQL)
def op8_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    return threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and path templates over all page urls."""
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) AS i FROM d)),
s AS (SELECT r, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s),
q AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
c AS (SELECT r, span, min(i) AS a, max(i) + 400 AS z FROM q GROUP BY ALL),
k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS after FROM c),
j AS (SELECT k.r, count(*) AS n_spans, sum(z - a) AS gone, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS head, max(z) AS last FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j ON j.r = d.r
"""


@query("op10_suffix_dedup", OP10_SQL)
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of a 400-byte string that starts twice is removed."""
    out = suffixdedup.remove(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP11_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i FROM bw WHERE len(ws) > 0)),
grams AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT r, g.n, i, item FROM grams g JOIN win ON win.n = g.n AND win.w = g.w),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos ON pos.r = dw.r LEFT JOIN it ON it.r = dw.r
"""


@query("op11_decontamination", OP11_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any ten consecutive words of a benchmark item."""
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def _lloyd_sql(rounds: int) -> str:
    """One pair of steps per round: the nearest centroid of every vector, then the floored means."""
    near = """a{i} AS MATERIALIZED (
  SELECT r, vec_id, e, c, d FROM (
    SELECT v.r, v.vec_id, v.e, c.c, list_sum(list_transform(list_zip(v.e, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    move = """c{j} AS MATERIALIZED (
  SELECT p.c, coalesce(q.m, p.m) AS m FROM c{i} p LEFT JOIN (
    SELECT c, list(CAST(s - ((s % n + n) % n) AS BIGINT) // n ORDER BY j) AS m
    FROM (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) q ON q.c = p.c)"""
    steps = [t.format(i=i, j=i + 1) for i in range(rounds) for t in (near, move)] + [near.format(i=rounds)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e AS m FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) <= 8),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


@query("op12_clustering", _lloyd_sql(10))
def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten exact Lloyd rounds."""
    assigned, clusters = shardedlloyd.cluster(table(spark, sf_dir, "embeddings"))
    # One row per centroid.
    clusters = clusters.withColumn("total", F.sum("inertia").over(Window.partitionBy()))
    out = assigned.join(F.broadcast(clusters), "cluster")
    return out.select("vec_id", "cluster", "distance", F.col("inertia").alias("cluster_inertia"), F.col("total").alias("inertia"), "centroid_sha256")


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT min(r) AS r, vec_id, label, e FROM v WHERE vec_id % 100 = 0 GROUP BY ALL) a, v c WHERE c.vec_id <> a.vec_id),
p AS (SELECT ar, anchor_id, vec_id AS positive_id, score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS pr FROM s WHERE same QUALIFY pr <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score almost as high as an anchor's positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
