"""Inferred contracts, lenient parsing, folder scan and order rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import mining as M
from lintlake.plans.catalog import query
from lintlake.sources import corpus, quarantine

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PAIRS = [("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey"), ("l_suppkey", "l_partkey"), ("l_returnflag", "l_linestatus"), ("l_linestatus", "l_returnflag"), ("l_quantity", "l_extendedprice")]
PART_PAIRS = [("p_brand", "p_type"), ("p_type", "p_brand"), ("p_size", "p_retailprice"), ("p_name", "p_type")]
DECLARED = [("l_quantity", "positive"), ("l_discount", "unit_interval"), ("l_tax", "unit_interval"), ("l_linenumber", "whole"), ("l_extendedprice", "whole"), ("l_tax", "positive"),
            ("l_orderkey in o_orderkey", "included"), ("l_partkey in p_partkey", "included"), ("o_custkey in c_custkey", "included"), ("l_suppkey in s_suppkey", "included"), ("c_custkey in o_custkey", "included")]


def _t(spark, sf_dir, name):
    return corpus.table(spark, sf_dir, name)


_RULE_SQL = {"not_null": None, "not_negative": "{c} >= 0", "positive": "{c} > 0", "whole": "{c} = floor({c})", "unit_interval": "{c} >= 0 AND {c} <= 1"}
VALUES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS subject, '{k}' AS kind, {'count(*)' if rule is None else f'count({c})'} AS support, {f'count({c})' if rule is None else 'count(*) FILTER (WHERE ' + rule.format(c=c) + ')'} AS holds, "
    f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem" for c in NUMBERS for k, rule in _RULE_SQL.items())
VALUES_SQL = f"SELECT *, round(holds / support, 6) AS confidence FROM ({VALUES_SQL}) WHERE support > 0 AND round(holds / support, 6) >= 0.95"


def _fd_sql(table: str, pairs: list[tuple[str, str]], least: float) -> str:
    each = " UNION ALL ".join(f"SELECT '{a} -> {b}' AS subject, CAST({a} AS VARCHAR) AS a, count(*) AS n FROM {table} GROUP BY {a}, {b}" for a, b in pairs)
    return f"""
SELECT subject, 'determines' AS kind, CAST(sum(n) AS BIGINT) AS support, CAST(sum(most) AS BIGINT) AS holds, round(sum(most) / sum(n), 6) AS confidence, count(*) AS groups, count(*) FILTER (WHERE kinds > 1) AS broken_groups
FROM (SELECT subject, a, sum(n) AS n, max(n) AS most, count(*) AS kinds FROM ({each}) GROUP BY subject, a) GROUP BY subject HAVING round(sum(most) / sum(n), 6) >= {least} AND count(*) < sum(n)"""


_IN = [("l_orderkey", "lineitem", "o_orderkey", "orders"), ("l_partkey", "lineitem", "p_partkey", "part"), ("l_suppkey", "lineitem", "s_suppkey", "supplier"), ("o_custkey", "orders", "c_custkey", "customer"),
       ("c_custkey", "customer", "o_custkey", "orders"), ("c_nationkey", "customer", "n_nationkey", "nation"), ("s_nationkey", "supplier", "n_nationkey", "nation"), ("user_id", "events", "c_custkey", "customer")]


def _in_sql(least: float) -> str:
    each = " UNION ALL ".join(f"SELECT '{a} in {b}' AS subject, count(*) AS support, count(r.v) AS holds FROM (SELECT DISTINCT {a} AS v FROM {t} WHERE {a} IS NOT NULL) l LEFT JOIN (SELECT DISTINCT {b} AS v FROM {u}) r ON r.v = l.v" for a, t, b, u in _IN)
    return f"SELECT subject, 'included' AS kind, support, holds, round(holds / support, 6) AS confidence FROM ({each}) WHERE support > 0 AND round(holds / support, 6) >= {least}"


def _values(spark, sf_dir):
    return M.value_rules(_t(spark, sf_dir, "lineitem"), NUMBERS)


def _inclusions(spark, sf_dir, least=0.5):
    return M.inclusions([(a, F.col(a), _t(spark, sf_dir, t), b, F.col(b), _t(spark, sf_dir, u)) for a, t, b, u in _IN], least)


@query("c12_inferred_value_rules", VALUES_SQL)
def c12_inferred_value_rules(spark, sf_dir):
    """What the numeric columns of the order lines promise, with the share of values that keep it."""
    return _values(spark, sf_dir)


@query("c14_inferred_inclusions", _in_sql(0.5))
def c14_inferred_inclusions(spark, sf_dir):
    """C14: columns whose values come from another table's column."""
    return _inclusions(spark, sf_dir)


@query("c15_inferred_dependencies", _fd_sql("lineitem", PAIRS, 0.1) + " UNION ALL " + _fd_sql("part", PART_PAIRS, 0.1))
def c15_inferred_dependencies(spark, sf_dir):
    """How far one column determines another, by partition refinement."""
    return M.dependencies(_t(spark, sf_dir, "lineitem"), PAIRS, 0.1).unionByName(M.dependencies(_t(spark, sf_dir, "part"), PART_PAIRS, 0.1))


MERGED_SQL = f"""
WITH i AS (SELECT subject, kind, support, holds, confidence FROM ({VALUES_SQL}) UNION ALL SELECT subject, kind, support, holds, confidence FROM ({_in_sql(0.5)})),
d AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{k}')" for s, k in DECLARED)}) t(subject, kind)),
m AS (SELECT coalesce(d.subject, i.subject) AS subject, coalesce(d.kind, i.kind) AS kind, support, confidence,
             CASE WHEN d.subject IS NULL THEN 'new' WHEN i.subject IS NULL THEN 'unsupported' WHEN holds = support THEN 'confirmed' ELSE 'violated' END AS state
      FROM d FULL JOIN i ON i.subject = d.subject AND i.kind = d.kind)
"""


def _merged(spark, sf_dir):
    inferred = _values(spark, sf_dir).drop("lo", "hi").unionByName(_inclusions(spark, sf_dir))
    return M.merged(spark.createDataFrame(DECLARED, "subject string, kind string"), inferred)


@query("c13_merged_contracts", MERGED_SQL + "SELECT subject, kind, state, support, confidence FROM m")
def c13_merged_contracts(spark, sf_dir):
    """The declared contracts of the order tables against the inferred ones."""
    return _merged(spark, sf_dir)


@query("c18_contract_report", MERGED_SQL + "SELECT k.kind, s.state, count(m.kind) AS n FROM (SELECT DISTINCT kind FROM m) k, (VALUES ('confirmed'), ('violated'), ('unsupported'), ('new')) s(state) LEFT JOIN m ON m.kind = k.kind AND m.state = s.state GROUP BY ALL")
def c18_contract_report(spark, sf_dir):
    """Contracts by kind and state, empty states at 0."""
    return M.contract_report(_merged(spark, sf_dir))


@query("l01_purchases_before_views", """
WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase') AS first_use, min(ts) FILTER (WHERE event_type = 'view') AS first_check FROM events GROUP BY user_id)
SELECT f.user_id, first_use, first_check, count(*) AS uses_before FROM f JOIN events e ON e.user_id = f.user_id AND e.event_type = 'purchase' AND (first_check IS NULL OR e.ts < first_check)
WHERE first_use < first_check OR first_check IS NULL AND first_use IS NOT NULL GROUP BY ALL""")
def l01_purchases_before_views(spark, sf_dir):
    """Users who bought before they had viewed anything: the first pair, and how many purchases came too early."""
    ev = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.used_before(ev, "user_id", F.col("ts"), F.col("event_type") == "purchase", F.col("event_type") == "view")


@query("l02_activity_without_signup", """
SELECT user_id, min(ts) AS first_use, count(*) AS uses_before FROM events e WHERE event_type IN ('purchase', 'click', 'view')
AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) GROUP BY user_id""")
def l02_activity_without_signup(spark, sf_dir):
    """Users who were active before any sign-up."""
    ev = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.used_before(ev, "user_id", F.col("ts"), F.col("event_type").isin("purchase", "click", "view"), F.col("event_type") == "signup").drop("first_check")


@query("l03_answers_before_questions", """
WITH f AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant') AS first_use, min(turn) FILTER (WHERE role = 'user') AS first_check FROM conversations GROUP BY conv_id)
SELECT f.conv_id, first_use, first_check, count(*) AS uses_before FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.role = 'assistant' AND (first_check IS NULL OR c.turn < first_check)
WHERE first_use < first_check OR first_check IS NULL AND first_use IS NOT NULL GROUP BY ALL""")
def l03_answers_before_questions(spark, sf_dir):
    """Conversations in which an answer stands before the first question."""
    return M.used_before(_t(spark, sf_dir, "conversations"), "conv_id", F.col("turn"), F.col("role") == "assistant", F.col("role") == "user")


@query("s01_folder_scan")
def s01_folder_scan(spark, sf_dir):
    """Every file below the given folder, with its size."""
    f = corpus.scan_files(spark, sf_dir)
    return f.groupBy("top", "suffix").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


PARSED_SQL = """
WITH v AS (SELECT event_id, event_type, props, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
                  CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS raw FROM events),
p AS (SELECT *, CASE WHEN props IS NULL THEN 'no_text' WHEN NOT json_valid(props) THEN 'not_json' WHEN raw IS NULL THEN 'missing:k' WHEN k IS NULL THEN 'not_a_number:k' WHEN k NOT BETWEEN 0 AND 89 THEN 'out_of_range:k' END AS reason FROM v)
"""


def _parsed(spark, sf_dir):
    return quarantine.parsed(_t(spark, sf_dir, "events").select("event_id", "event_type", "props"), "props", {"k": (0, 89)})


@query("s02_error_rows", PARSED_SQL + "SELECT event_id, event_type, props, k, reason, CASE WHEN reason IN ('no_text', 'not_json') THEN 'low' ELSE 'medium' END AS confidence FROM p WHERE reason IS NOT NULL")
def s02_error_rows(spark, sf_dir):
    """The events whose properties break the declared range, as rows of their own."""
    return quarantine.split(_parsed(spark, sf_dir))[1]


@query("x23_parsed_events", PARSED_SQL + "SELECT event_type, CASE WHEN reason IS NULL THEN 'high' WHEN reason IN ('no_text', 'not_json') THEN 'low' ELSE 'medium' END AS confidence, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM p GROUP BY ALL")
def x23_parsed_events(spark, sf_dir):
    """Events by how far their properties can be trusted."""
    return _parsed(spark, sf_dir).groupBy("event_type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))
