"""Queries for contracts and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import contracts as C
from lintlake.plans.catalog import code_query
from lintlake.plans.oracle import _lit, with_facts
from lintlake.plans.substrate import for_corpus

_HEAD_CASE = "CASE text " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in C.SECTIONS.items()) + " END"
_TAG_PART = "CASE " + " ".join(f"WHEN contains(lower(text), ':{t}:') THEN '{p}'" for t, p in C.TAGS) + " END"
_TAG_ITEM = "CASE " + " ".join(
    f"WHEN contains(lower(text), ':{t}:') THEN trim(regexp_extract(text, {_lit('(?i):' + t + ':' + (r'\s*(\w+)' if t == 'raises' else r'\s*(.+)'))}, 1))"
    for t, _p in C.TAGS) + " END"

CONTRACT_CTES = f"""
c_dl0 AS (
  SELECT l.file_id, f.ln_start AS fn_ln, l.ln,
         trim(regexp_replace(regexp_replace(l.line, '\"\"\"', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS text
  FROM lines l JOIN functions f ON f.file_id = l.file_id AND f.doc_region = l.str_region),
c_dl1 AS (SELECT *, CASE WHEN regexp_matches(text, {_lit(C.HEADING)}) THEN coalesce({_HEAD_CASE}, 'none') END AS marker FROM c_dl0),
c_dl AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY file_id, fn_ln ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
         FROM c_dl1),
c_items AS (
  SELECT file_id, fn_ln, section AS part,
         CASE WHEN section = 'raises' THEN CASE WHEN regexp_matches(text, '^(\\w+):') THEN regexp_extract(text, '^(\\w+):', 1)
                                                ELSE regexp_split_to_array(text, '\\s+')[1] END ELSE text END AS item, 'docstring' AS source
  FROM c_dl WHERE marker IS NULL AND text <> '' AND section IN ('pre', 'post', 'raises')
  UNION ALL
  SELECT file_id, fn_ln, part, item, 'tag' FROM (SELECT file_id, fn_ln, {_TAG_PART} AS part, {_TAG_ITEM} AS item FROM c_dl)
  WHERE part IS NOT NULL AND item <> ''
  UNION ALL
  SELECT file_id, fn_ln, 'pre', trim(regexp_extract(code, '^assert\\s+(.*)$', 1)), 'assert' FROM fst WHERE kind = 'assert'
  UNION ALL
  SELECT file_id, fn_ln, 'raises_in_code', regexp_extract(code, {_lit(C.RAISE_NAME)}, 1), 'code' FROM fst
  WHERE kind = 'raise' AND regexp_extract(code, {_lit(C.RAISE_NAME)}, 1) <> ''),
c_table AS (
  SELECT f.file_id, f.ln_start AS fn_ln, f.name, f.qualified_name,
    coalesce((SELECT list_sort(list(DISTINCT item)) FROM c_items i WHERE i.file_id = f.file_id AND i.fn_ln = f.ln_start AND part = 'pre'), []) AS pre,
    coalesce((SELECT list_sort(list(DISTINCT item)) FROM c_items i WHERE i.file_id = f.file_id AND i.fn_ln = f.ln_start AND part = 'post'), []) AS post,
    coalesce((SELECT list_sort(list(DISTINCT item)) FROM c_items i WHERE i.file_id = f.file_id AND i.fn_ln = f.ln_start AND part = 'raises'), []) AS raises,
    coalesce((SELECT list_sort(list(DISTINCT item)) FROM c_items i WHERE i.file_id = f.file_id AND i.fn_ln = f.ln_start AND part = 'raises_in_code'), []) AS raises_in_code
  FROM functions f),
c_viol AS (
  SELECT file_id, fn_ln, name, 'undocumented_raise' AS violation_type, exc, 'low' AS severity
  FROM (SELECT *, unnest(list_filter(raises_in_code, lambda x: x NOT IN ('Exception', 'BaseException') AND NOT list_contains(raises, x))) AS exc FROM c_table)
  UNION ALL
  SELECT file_id, fn_ln, name, 'unreachable_raise', exc, 'low'
  FROM (SELECT *, unnest(list_filter(raises, lambda x: NOT list_contains(raises_in_code, x))) AS exc FROM c_table)
  UNION ALL
  SELECT file_id, fn_ln, name, 'missing_contract', NULL, 'medium' FROM c_table t
  WHERE (SELECT count(*) FROM fst s WHERE s.file_id = t.file_id AND s.fn_ln = t.fn_ln AND s.kind IN ('if', 'elif', 'for', 'while', 'try')) > 3
    AND len(pre) = 0 AND len(post) = 0
  UNION ALL
  SELECT file_id, fn_ln, name, 'undocumented_precondition', NULL, 'low' FROM c_table t
  WHERE EXISTS (SELECT 1 FROM fst s WHERE s.file_id = t.file_id AND s.fn_ln = t.fn_ln AND s.kind = 'assert')
    AND NOT EXISTS (SELECT 1 FROM c_items i WHERE i.file_id = t.file_id AND i.fn_ln = t.fn_ln AND i.part = 'pre' AND i.source <> 'assert')),
c_inv AS (
  SELECT s.file_id, f.class_name, CAST(s.ln AS BIGINT) AS ln, trim(regexp_extract(s.code, '^assert\\s+(.*)$', 1)) AS invariant
  FROM fst s JOIN functions f ON f.file_id = s.file_id AND f.ln_start = s.fn_ln
  WHERE f.name = '__init__' AND f.class_name IS NOT NULL AND s.kind = 'assert' AND s.parent_ln = s.fn_ln
    AND contains(trim(regexp_extract(s.code, '^assert\\s+(.*)$', 1)), 'self.')),
c_pres AS (
  SELECT f.file_id, f.class_name, f.name AS method, 'invariant_not_checked' AS violation_type, 'medium' AS severity
  FROM functions f WHERE f.class_name IS NOT NULL AND f.name <> '__init__'
    AND EXISTS (SELECT 1 FROM c_inv i WHERE i.file_id = f.file_id AND i.class_name = f.class_name)
    AND (SELECT count(*) FROM fst s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start AND s.kind IN ('assign', 'augassign')
         AND regexp_matches(s.code, '^self\\.')) > 0
    AND (SELECT count(*) FROM fst s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start AND s.kind = 'assert') = 0)
"""


def _c(sql):
    return with_facts(sql, CONTRACT_CTES)


def _sub(spark, sf_dir):
    return for_corpus(spark, sf_dir)


def _items(sub):
    return sub.contract_items


def _table(sub):
    return C.contract_table(sub.functions, _items(sub))


def _j(col):
    return F.array_join(col, " | ")


@code_query("c01_declared_types", _c("""
SELECT file_id, qualified_name AS function, name, type_hint AS type FROM params WHERE type_hint IS NOT NULL
UNION ALL SELECT file_id, qualified_name, 'return', return_type FROM functions WHERE return_type IS NOT NULL
"""))
def c01_declared_types(spark, sf_dir):
    f = _sub(spark, sf_dir).functions
    p = f.select("file_id", F.col("qualified_name").alias("function"), F.explode("params").alias("p")).filter(
        F.col("p.type_hint").isNotNull()).select("file_id", "function", F.col("p.name").alias("name"), F.col("p.type_hint").alias("type"))
    r = f.filter(F.col("return_type").isNotNull()).select("file_id", F.col("qualified_name").alias("function"),
                                                           F.lit("return").alias("name"), F.col("return_type").alias("type"))
    return p.unionByName(r)


@code_query("c02_docstring_sections", _c("""
SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, CAST(ln AS BIGINT) AS ln, text, section FROM c_dl
WHERE marker IS NULL AND text <> '' AND section IS NOT NULL
"""))
def c02_docstring_sections(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    dl = C.doc_lines(sub.lines, sub.functions)
    return dl.filter(F.col("marker").isNull() & (F.col("text") != "") & F.col("section").isNotNull()).select(
        "file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), F.col("ln").cast("bigint").alias("ln"), "text", "section")


@code_query("c03_c04_contract_items", _c("SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, part, item, source FROM c_items"))
def c03_c04_contract_items(spark, sf_dir):
    """C03 inline tags, C04 asserts and raised types, with C02 section entries, as rows."""
    it = _items(_sub(spark, sf_dir))
    return it.select("file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), "part", "item", "source")


@code_query("c05_contracts", _c("""
SELECT file_id, qualified_name, array_to_string(pre, ' | ') AS pre, array_to_string(post, ' | ') AS post,
       array_to_string(raises, ' | ') AS raises, array_to_string(raises_in_code, ' | ') AS raises_in_code FROM c_table
"""))
def c05_contracts(spark, sf_dir):
    t = _table(_sub(spark, sf_dir))
    return t.select("file_id", "qualified_name", _j("pre").alias("pre"), _j("post").alias("post"), _j("raises").alias("raises"),
                    _j("raises_in_code").alias("raises_in_code"))


def _viol(sub):
    return C.violations(_table(sub), _items(sub), sub.fn_stmts)


@code_query("c06_c09_contract_violations", _c("""
SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, name AS function, violation_type, exc, severity FROM c_viol
"""))
def c06_c09_contract_violations(spark, sf_dir):
    """C06 undocumented raise, C07 documented never raised, C08 complex without contract, C09 asserts undocumented."""
    v = _viol(_sub(spark, sf_dir))
    return v.select("file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), F.col("name").alias("function"), "violation_type", "exc", "severity")


@code_query("c10_contract_report", _c("""
SELECT 'coverage' AS dimension, 'functions' AS key, CAST(count(*) AS BIGINT) AS n FROM c_table
UNION ALL SELECT 'coverage', 'with_preconditions', CAST(count(*) FILTER (WHERE len(pre) > 0) AS BIGINT) FROM c_table
UNION ALL SELECT 'coverage', 'with_postconditions', CAST(count(*) FILTER (WHERE len(post) > 0) AS BIGINT) FROM c_table
UNION ALL SELECT 'coverage', 'with_raises_documented', CAST(count(*) FILTER (WHERE len(raises) > 0) AS BIGINT) FROM c_table
UNION ALL SELECT CASE WHEN grouping(violation_type) = 0 THEN 'by_type' ELSE 'by_severity' END, coalesce(violation_type, severity),
                 CAST(count(*) AS BIGINT) FROM c_viol GROUP BY GROUPING SETS ((violation_type), (severity))
"""))
def c10_contract_report(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    t = _table(sub)
    cov = t.agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.size("pre") > 0).alias("with_preconditions"),
                F.count_if(F.size("post") > 0).alias("with_postconditions"), F.count_if(F.size("raises") > 0).alias("with_raises_documented"))
    cov = cov.unpivot([], ["functions", "with_preconditions", "with_postconditions", "with_raises_documented"], "key", "n").select(
        F.lit("coverage").alias("dimension"), "key", "n")
    v = _viol(sub).groupingSets([["violation_type"], ["severity"]], "violation_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("violation_type").alias("g"))
    v = v.select(F.when(F.col("g") == 0, "by_type").otherwise("by_severity").alias("dimension"),
                 F.coalesce("violation_type", "severity").alias("key"), "n")
    return cov.unionByName(v)


@code_query("c11_assert_positions", _c("""
SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, CAST(ln AS BIGINT) AS ln, role, condition FROM (
  SELECT *, 'precondition' AS role FROM (
    SELECT file_id, fn_ln, ln, kind, trim(regexp_extract(code, '^assert\\s+(.*)$', 1)) AS condition,
           row_number() OVER (PARTITION BY file_id, fn_ln ORDER BY ln) AS ra,
           min(CASE WHEN kind = 'assert' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, fn_ln ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_a
    FROM fst WHERE parent_ln = fn_ln) WHERE ra <= 5 AND run_a = 1
  UNION ALL
  SELECT *, 'postcondition' FROM (
    SELECT file_id, fn_ln, ln, kind, trim(regexp_extract(code, '^assert\\s+(.*)$', 1)) AS condition,
           row_number() OVER (PARTITION BY file_id, fn_ln ORDER BY ln DESC) AS rd,
           min(CASE WHEN kind = 'return' OR kind = 'assert' THEN 1 ELSE 0 END)
             OVER (PARTITION BY file_id, fn_ln ORDER BY ln DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_d
    FROM fst WHERE parent_ln = fn_ln) WHERE rd <= 5 AND run_d = 1 AND kind = 'assert')
"""))
def c11_assert_positions(spark, sf_dir):
    a = C.assert_positions(_sub(spark, sf_dir).fn_stmts)
    return a.select("file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), F.col("ln").cast("bigint").alias("ln"), "role", "condition")


@code_query("c12_inferred_contracts", _c("""
SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, 'pre' AS part, trim(regexp_extract(code, '^assert\\s+(.*)$', 1)) AS item FROM fst
WHERE kind = 'assert' AND ln - fn_ln <= 5
UNION ALL SELECT file_id, CAST(fn_ln AS BIGINT), 'raises', regexp_extract(code, '^raise\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1) FROM fst
WHERE kind = 'raise' AND regexp_extract(code, '^raise\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1) <> ''
UNION ALL SELECT file_id, CAST(ln_start AS BIGINT), 'assumption', name || ' is ' || type_hint FROM params WHERE type_hint IS NOT NULL
UNION ALL SELECT file_id, CAST(ln_start AS BIGINT), 'post', 'returns a boolean' FROM functions WHERE return_type = 'bool'
"""))
def c12_inferred_contracts(spark, sf_dir):
    """Static inference: early asserts, raised types, type-hint assumptions, boolean return."""
    sub = _sub(spark, sf_dir)
    fst, f = sub.fn_stmts, sub.functions
    pre = fst.filter((F.col("kind") == "assert") & (F.col("ln") - F.col("fn_ln") <= 5)).select(
        "file_id", "fn_ln", F.lit("pre").alias("part"), F.trim(F.regexp_extract("code", r"^assert\s+(.*)$", 1)).alias("item"))
    rs = fst.filter(F.col("kind") == "raise").select("file_id", "fn_ln", F.lit("raises").alias("part"),
                                                     F.regexp_extract("code", C.RAISE_NAME, 1).alias("item")).filter(F.col("item") != "")
    asm = f.select("file_id", F.col("ln_start").alias("fn_ln"), F.explode("params").alias("p")).filter(F.col("p.type_hint").isNotNull()).select(
        "file_id", "fn_ln", F.lit("assumption").alias("part"), F.concat(F.col("p.name"), F.lit(" is "), F.col("p.type_hint")).alias("item"))
    bl = f.filter(F.col("return_type") == "bool").select("file_id", F.col("ln_start").alias("fn_ln"), F.lit("post").alias("part"),
                                                        F.lit("returns a boolean").alias("item"))
    out = pre.unionByName(rs).unionByName(asm).unionByName(bl)
    return out.select("file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), "part", "item")


@code_query("c13_merged_contracts", _c("""
SELECT file_id, fn_ln, part, item, bool_or(declared) AS declared, bool_or(inferred) AS inferred FROM (
  SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, part, item, true AS declared, false AS inferred FROM c_items WHERE part IN ('pre', 'post', 'raises')
  UNION ALL
  SELECT file_id, CAST(fn_ln AS BIGINT), 'pre', trim(regexp_extract(code, '^assert\\s+(.*)$', 1)), false, true FROM fst WHERE kind = 'assert' AND ln - fn_ln <= 5
  UNION ALL
  SELECT file_id, CAST(fn_ln AS BIGINT), 'raises', regexp_extract(code, '^raise\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1), false, true FROM fst
  WHERE kind = 'raise' AND regexp_extract(code, '^raise\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1) <> ''
  UNION ALL SELECT file_id, CAST(ln_start AS BIGINT), 'post', 'returns a boolean', false, true FROM functions WHERE return_type = 'bool')
GROUP BY file_id, fn_ln, part, item
"""))
def c13_merged_contracts(spark, sf_dir):
    """Declared and inferred contracts merged per (function, part, item) with their origin."""
    sub = _sub(spark, sf_dir)
    dec = _items(sub).filter(F.col("part").isin("pre", "post", "raises")).select(
        "file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), "part", "item", F.lit(True).alias("declared"), F.lit(False).alias("inferred"))
    inf = c12_inferred_contracts(spark, sf_dir).filter(F.col("part") != "assumption").select(
        "file_id", "fn_ln", "part", "item", F.lit(False).alias("declared"), F.lit(True).alias("inferred"))
    return dec.unionByName(inf).groupBy("file_id", "fn_ln", "part", "item").agg(
        F.bool_or("declared").alias("declared"), F.bool_or("inferred").alias("inferred"))


@code_query("c14_loop_facts", _c("""
SELECT l.file_id, CAST(l.fn_ln AS BIGINT) AS fn_ln, CAST(l.ln AS BIGINT) AS ln, l.kind, regexp_extract(l.code, '^for\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS loop_var,
  coalesce((SELECT string_agg(DISTINCT regexp_extract(a.code, '^([A-Za-z_][A-Za-z0-9_.]*)', 1), ',' ORDER BY regexp_extract(a.code, '^([A-Za-z_][A-Za-z0-9_.]*)', 1))
            FROM fst a JOIN blocks b ON b.file_id = a.file_id AND b.ln = l.ln
            WHERE a.file_id = l.file_id AND a.kind = 'augassign' AND regexp_matches(a.code, '^[A-Za-z_][A-Za-z0-9_.]*\\s*(\\+|\\*)=')
              AND a.ln > b.ln AND a.ln <= b.ln_end AND a.indent > b.indent AND l.kind = 'for'), '') AS accumulators,
  l.kind = 'while' AND contains(l.code, '<') AS bounded
FROM fst l WHERE l.kind IN ('for', 'while')
"""))
def c14_loop_facts(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return C.loop_facts(sub.fn_stmts, sub.blocks)


@code_query("c15_class_invariants", _c("SELECT * FROM c_inv"))
def c15_class_invariants(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return C.class_invariants(sub.fn_stmts, sub.functions)


@code_query("c16_data_structures", _c("""
SELECT file_id, name, structure FROM (
  SELECT c.file_id, c.name, CASE
    WHEN list_contains(m, 'push') AND list_contains(m, 'pop') THEN 'stack'
    WHEN (list_contains(m, 'enqueue') AND list_contains(m, 'dequeue')) OR (list_contains(m, 'put') AND list_contains(m, 'get')) THEN 'queue'
    WHEN list_has_any(m, ['insert', 'traverse', 'search']) AND regexp_matches(c.name, 'Tree|Node') THEN 'tree'
    WHEN list_has_any(m, ['__len__', '__contains__', '__iter__']) THEN 'container' END AS structure
  FROM (SELECT c.*, coalesce((SELECT list(d.name) FROM defs d WHERE d.file_id = c.file_id AND d.kind = 'def' AND d.parent_kind = 'class'
                              AND d.parent_ln = c.ln_start), []) AS m FROM classes c) c)
WHERE structure IS NOT NULL
"""))
def c16_data_structures(spark, sf_dir):
    return C.data_structures(_sub(spark, sf_dir).classes)


@code_query("c17_invariant_preservation", _c("SELECT * FROM c_pres"))
def c17_invariant_preservation(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return C.preservation(C.class_invariants(sub.fn_stmts, sub.functions), sub.fn_stmts, sub.functions)


@code_query("c18_invariant_report", _c("""
SELECT 'invariants' AS dimension, class_name AS key, CAST(count(*) AS BIGINT) AS n FROM c_inv GROUP BY class_name
UNION ALL SELECT 'violations', severity, CAST(count(*) AS BIGINT) FROM c_pres GROUP BY severity
"""))
def c18_invariant_report(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    inv = C.class_invariants(sub.fn_stmts, sub.functions)
    pres = C.preservation(inv, sub.fn_stmts, sub.functions)
    a = inv.groupBy(F.col("class_name").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("invariants").alias("dimension"), "key", "n")
    b = pres.groupBy(F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("violations").alias("dimension"), "key", "n")
    return a.unionByName(b)
