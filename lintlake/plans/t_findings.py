"""Findings, reports, gates, export and repair over the given texts (documents, labels)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lintlake.operators import textrules as T
from lintlake.plans.catalog import query
from lintlake.session import scratch
from lintlake.sources import corpus

# The rules once more, written out for DuckDB; the Spark side has its own in operators/textrules.py.
FIND = r"""
WITH ln AS (
  SELECT doc_id, source, unnest(generate_series(1, len(arr))) AS line_no, unnest(arr) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS arr FROM documents)),
hit AS (
  SELECT doc_id, source, line_no, 'secret' AS rule, 'security' AS category, 'critical' AS severity,
         regexp_extract_all(line, '(token|secret|password|api_key) = "[^"]*"') AS m, 'revoke it and remove it from the text' AS advice FROM ln
  UNION ALL SELECT doc_id, source, line_no, 'email', 'privacy', 'high', regexp_extract_all(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][A-Za-z]+'), 'mask the address' FROM ln
  UNION ALL SELECT doc_id, source, line_no, 'long_number', 'privacy', 'high', regexp_extract_all(line, '[0-9]{13,19}'), 'mask the number' FROM ln
  UNION ALL SELECT doc_id, source, line_no, 'ip_address', 'privacy', 'medium', regexp_extract_all(line, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'), 'mask the address' FROM ln
  UNION ALL SELECT doc_id, source, line_no, 'junk_marks', 'quality', 'medium', regexp_extract_all(line, '(###|%%%|[$][$][$]|[*][*][*]|&&&)'), 'drop the marks' FROM ln
  UNION ALL SELECT doc_id, source, line_no, 'license_line', 'legal', 'low', regexp_extract_all(line, '[Ll]icen[sc]e'), 'check the terms' FROM ln),
f AS (SELECT doc_id, source, CAST(line_no AS BIGINT) AS line_no, rule, category, severity, CAST(len(m) AS BIGINT) AS matches, m[1] AS evidence, advice,
             CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sev,
             CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END AS weight FROM hit WHERE len(m) > 0),
rep AS (
  SELECT d.doc_id, d.source, count(f.rule) AS total, count(*) FILTER (WHERE f.severity = 'critical') AS critical, count(*) FILTER (WHERE f.severity = 'high') AS high,
         count(*) FILTER (WHERE f.severity = 'medium') AS medium, count(*) FILTER (WHERE f.severity = 'low') AS low, CAST(coalesce(sum(f.weight), 0) AS BIGINT) AS score
  FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id, d.source),
gate AS (SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'none' END AS worst,
                critical = 0 AND high <= 1 AS passed FROM rep)
"""


def _docs(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents")


def _find(spark, sf_dir):
    return T.findings(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")


def _reports(spark, sf_dir):
    return T.reports(_docs(spark, sf_dir), _find(spark, sf_dir), "doc_id")


@query("t11_document_findings", FIND + "SELECT doc_id, line_no, rule, category, severity, matches, evidence, advice FROM f")
def t11_document_findings(spark, sf_dir):
    """Every rule over every line of every document in one pass, with evidence and advice."""
    return _find(spark, sf_dir)


@query("r02_document_summary", FIND + "SELECT category, severity, count(*) AS findings, CAST(sum(matches) AS BIGINT) AS matches, count(DISTINCT doc_id) AS texts FROM f GROUP BY ALL")
def r02_document_summary(spark, sf_dir):
    return T.summary(_find(spark, sf_dir), "doc_id")


@query("r03_source_metrics", FIND + """
SELECT source, count(*) AS n_docs, CAST(sum(total) AS BIGINT) AS findings, CAST(sum(score) AS BIGINT) AS score, round(sum(score) / count(*), 4) AS score_per_doc
FROM gate GROUP BY source""")
def r03_source_metrics(spark, sf_dir):
    per = _reports(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("total").alias("findings"), F.sum("score").alias("score"),
                                     F.round(F.sum("score") / F.count(F.lit(1)), 4).alias("score_per_doc"))


@query("r04_clean_properties", FIND + """
SELECT d.doc_id, p.property FROM documents d, (VALUES ('no_security', 'security'), ('no_privacy', 'privacy'), ('no_legal', 'legal')) p(property, category)
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.category = p.category)""")
def r04_clean_properties(spark, sf_dir):
    """Properties that a document holds because no finding contradicts them."""
    has = _find(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("category").alias("has"))
    d = _docs(spark, sf_dir).select("doc_id").join(has, "doc_id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    held = [F.when(~F.array_contains("has", c), F.lit("no_" + c)) for c in ("security", "privacy", "legal")]
    return d.select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("property"))


@query("r05_document_reports", FIND + "SELECT doc_id, total, critical, high, medium, low, score, worst, passed FROM gate")
def r05_document_reports(spark, sf_dir):
    """The report and the gate of every document, clean ones included."""
    return _reports(spark, sf_dir)


@query("r06_ordered_document_findings", FIND + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sev, line_no, rule) AS rank, rule, severity, line_no, evidence FROM f""")
def r06_ordered_document_findings(spark, sf_dir):
    """A document's findings, worst first, each with its first evidence."""
    return T.ordered(_find(spark, sf_dir), "doc_id").select("doc_id", "rank", "rule", "severity", "line_no", "evidence")


@query("r07_top_documents", FIND + """
SELECT source, rank, doc_id, score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM gate WHERE score > 0) WHERE rank <= 5""")
def r07_top_documents(spark, sf_dir):
    """The five worst documents of every source (a top-k report)."""
    from pyspark.sql import Window

    per = _reports(spark, sf_dir).filter("score > 0").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("score").desc(), "doc_id"))
    return per.select("source", rank.cast("long").alias("rank"), "doc_id", "score").filter("rank <= 5")


@query("r10_source_gates", FIND + """
SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE passed) >= 0.95 * count(*) AS passed FROM gate GROUP BY source""")
def r10_source_gates(spark, sf_dir):
    per = _reports(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    ok = F.count_if("passed")
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), ok.alias("n_passed"), (ok >= 0.95 * F.count(F.lit(1))).alias("passed"))


@query("s04_finding_round_trip", FIND + "SELECT doc_id, count(*) AS n, max(evidence) AS last_evidence, CAST(sum(matches) AS BIGINT) AS matches FROM f GROUP BY doc_id")
def s04_finding_round_trip(spark, sf_dir):
    """Nested JSON reports of the findings, written, read back and parsed again."""
    f = _find(spark, sf_dir)
    nested = f.groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct("rule", "line_no", "matches", "evidence"))).alias("report"))
    path = scratch(spark, "finding-reports")
    nested.write.parquet(path)
    kind = "array<struct<rule:string,line_no:long,matches:long,evidence:string>>"
    back = spark.read.parquet(path).select("doc_id", F.explode(F.from_json("report", kind)).alias("f")).select("doc_id", "f.*")
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("evidence").alias("last_evidence"), F.sum("matches").alias("matches"))


@query("s06_finding_locations", FIND + """
SELECT rule AS rule_id, CASE WHEN sev < 2 THEN 'error' WHEN sev = 2 THEN 'warning' ELSE 'note' END AS level, 'documents/' || doc_id AS uri, line_no AS start_line,
       rule || ': ' || evidence AS message FROM f""")
def s06_finding_locations(spark, sf_dir):
    """Findings as result rows with rule, level, location and message."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return _find(spark, sf_dir).select(F.col("rule").alias("rule_id"), level.alias("level"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("uri"),
                                       F.col("line_no").alias("start_line"), F.concat_ws(": ", "rule", "evidence").alias("message"))


@query("s08_finding_tables", FIND + "SELECT severity, category, count(*) AS n, min(line_no) AS first_line FROM f WHERE severity IN ('critical', 'high') GROUP BY ALL")
def s08_finding_tables(spark, sf_dir):
    """Findings written as a table partitioned by severity; the read prunes to two partitions."""
    path = scratch(spark, "finding-tables")
    _find(spark, sf_dir).write.partitionBy("severity").parquet(path)
    return spark.read.parquet(path).filter(F.col("severity").isin("critical", "high")).groupBy("severity", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


@query("f01_routed_fixes", FIND + """
SELECT rule, CASE WHEN rule = 'license_line' THEN 'review' WHEN rule = 'junk_marks' THEN 'remove' ELSE 'mask' END AS route, count(*) AS findings, count(DISTINCT doc_id) AS texts
FROM f GROUP BY rule""")
def f01_routed_fixes(spark, sf_dir):
    """Findings by the fix they are routed to; rules without a replacement go to review."""
    route = None
    for r in T.RULES:
        kind = "review" if r.replacement is None else "remove" if r.replacement == "" else "mask"
        route = F.when(F.col("rule") == r.name, kind) if route is None else route.when(F.col("rule") == r.name, kind)
    return _find(spark, sf_dir).groupBy("rule", route.alias("route")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("texts"))


FIXED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(token|secret|password|api_key) = "[^"]*"', '\1 = "[secret]"', 'g'),
  '[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][A-Za-z]+', '[email]', 'g'), '[0-9]{13,19}', '[number]', 'g'),
  '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '[ip]', 'g'), '(###|%%%|[$][$][$]|[*][*][*]|&&&)', '', 'g')"""


@query("f04_repaired_documents", f"SELECT doc_id, fixed <> text AS changed, sha256(fixed) AS fixed_sha256, length(text) - length(fixed) AS chars_less FROM (SELECT doc_id, text, {FIXED} AS fixed FROM documents)")
def f04_repaired_documents(spark, sf_dir):
    """Every document with all fixes applied; a per-row expression without any shuffle."""
    d = _docs(spark, sf_dir).select("doc_id", "text", T.repaired(F.col("text")).alias("fixed"))
    return d.select("doc_id", (F.col("fixed") != F.col("text")).alias("changed"), F.sha2("fixed", 256).alias("fixed_sha256"),
                    (F.length("text") - F.length("fixed")).cast("long").alias("chars_less"))


FIX_ROWS = r"""
, x AS (
  SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, unnest([
    {'seq': 0, 'rule': 'secret', 'fixed': regexp_replace(line, '(token|secret|password|api_key) = "[^"]*"', '\1 = "[secret]"', 'g')},
    {'seq': 1, 'rule': 'email', 'fixed': regexp_replace(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][A-Za-z]+', '[email]', 'g')},
    {'seq': 2, 'rule': 'long_number', 'fixed': regexp_replace(line, '[0-9]{13,19}', '[number]', 'g')},
    {'seq': 3, 'rule': 'ip_address', 'fixed': regexp_replace(line, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '[ip]', 'g')},
    {'seq': 4, 'rule': 'junk_marks', 'fixed': regexp_replace(line, '(###|%%%|[$][$][$]|[*][*][*]|&&&)', '', 'g')}]) AS s FROM ln),
fx AS (SELECT doc_id, line_no, s.seq AS seq, s.rule AS rule, line AS original, s.fixed AS fixed FROM x JOIN f USING (doc_id, line_no) WHERE f.rule = s.rule)
"""


@query("f03_fix_rows", FIND + FIX_ROWS + "SELECT doc_id, line_no, seq, rule, original, fixed, CASE WHEN rule = 'junk_marks' THEN 0.6 ELSE 0.9 END AS confidence, rule = 'junk_marks' AS review FROM fx")
def f03_fix_rows(spark, sf_dir):
    """one fix per line and rule, with the line before and after."""
    return T.fix_rows(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")


@query("f04_patched_documents", FIND + FIX_ROWS + """
, w AS (SELECT doc_id, line_no, arg_max(fixed, seq) AS fixed FROM fx GROUP BY ALL)
SELECT l.doc_id, sha256(string_agg(coalesce(w.fixed, l.line), chr(10) ORDER BY l.line_no)) AS fixed_sha256, count(w.doc_id) AS applied
FROM ln l LEFT JOIN w ON w.doc_id = l.doc_id AND w.line_no = l.line_no GROUP BY l.doc_id""")
def f04_patched_documents(spark, sf_dir):
    """every document with its fix rows applied; where rules meet on a line, the fix listed last wins."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    return T.patched(d, T.fix_rows(d, "doc_id"), "doc_id").select("doc_id", F.sha2("text", 256).alias("fixed_sha256"), "applied")


@query("f05_fix_previews", FIND + f"""
SELECT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no, l.line[1:100] AS before, ({FIXED.replace("(text,", "(l.line,")})[1:100] AS after
FROM ln l WHERE EXISTS (SELECT 1 FROM f WHERE f.doc_id = l.doc_id AND f.line_no = l.line_no AND f.severity IN ('critical', 'high'))""")
def f05_fix_previews(spark, sf_dir):
    """lines with serious findings before and after repair, 100 characters each (the preview's length)."""
    serious = tuple(r for r in T.RULES if r.severity in ("critical", "high"))
    hit = reduce(lambda a, b: a | b, [r.matches(F.col("line")) for r in serious])
    ln = T.lines(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").filter(hit)
    return ln.select("doc_id", "line_no", F.substring("line", 1, 100).alias("before"), F.substring(T.repaired(F.col("line")), 1, 100).alias("after"))


@query("k01_label_claims", FIND + """
SELECT l.quality, l.toxic, count(*) AS n_docs, count(*) FILTER (WHERE g.worst = 'none') AS n_clean, count(*) FILTER (WHERE l.quality = 1 AND NOT g.passed) AS n_contradicted
FROM labels l JOIN gate g ON g.doc_id = l.doc_id GROUP BY l.quality, l.toxic""")
def k01_label_claims(spark, sf_dir):
    """Labels as claims about documents, held against the computed findings."""
    j = corpus.table(spark, sf_dir, "labels").join(_reports(spark, sf_dir), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("worst") == "none").alias("n_clean"),
                                             F.count_if((F.col("quality") == 1) & ~F.col("passed")).alias("n_contradicted"))
