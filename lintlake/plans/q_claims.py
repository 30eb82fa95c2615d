"""Queries for claims (K01-K04), answers and prompts (X22-X24), language (X17-X19), guards (X20), flow edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import claims as K
from lintlake.operators import flow as FL
from lintlake.operators import language as LG
from lintlake.plans.catalog import code_query, query
from lintlake.plans.oracle import _lit, with_facts
from lintlake.plans.substrate import for_corpus
from lintlake.sources import corpus

_STOP = "[" + ", ".join(_lit(w) for w in K.STOP_WORDS) + "]"

CLAIM_CTES = f"""
k_claims AS (
  SELECT f.file_id, f.qualified_name, f.function_name, f.line_start,
    CASE (f.file_id + f.line_start) % 4 WHEN 0 THEN 'SAFE: all parameters handled'
         WHEN 1 THEN 'UNSAFE: ' || coalesce((SELECT arg_min(p.name, p.pos) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.line_start), 'value') || ' (calls .upper())'
         WHEN 2 THEN 'UNCLEAR' ELSE 'Function has a bare except or broad handler around ' || f.function_name END AS response
  FROM ffacts f),
k_ids AS (
  SELECT *, regexp_matches(trim(response), {_lit(K.UNSAFE_RE)}) AS is_unsafe,
    list_filter(regexp_extract_all(regexp_extract(trim(response), {_lit(K.UNSAFE_RE)}, 1), {_lit(K.IDENT_RE)}, 0),
                lambda x: NOT list_contains({_STOP}, lower(x)) AND length(x) > 1) AS ids0
  FROM k_claims),
k_parsed AS (
  SELECT file_id, qualified_name, function_name, line_start, response,
    CASE WHEN is_unsafe THEN 'UNSAFE' WHEN regexp_matches(trim(response), {_lit(K.SAFE_RE)}) THEN 'SAFE' ELSE 'UNCLEAR' END AS answer,
    CASE WHEN is_unsafe THEN list_slice(list_filter(ids0, lambda x, i: list_position(ids0, x) = i), 1, 5) ELSE [] END AS unsafe_params
  FROM k_ids),
k_valid AS (
  SELECT c.*, f.has_return_on_all_paths, f.has_bare_except, f.has_broad_except,
    CASE WHEN c.answer = 'UNCLEAR' THEN 'inconclusive|no_data'
         WHEN c.answer = 'SAFE' THEN CASE WHEN NOT EXISTS (SELECT 1 FROM params p WHERE p.file_id = c.file_id AND p.ln_start = c.line_start
                                                            AND NOT list_contains(string_split(f.none_checks, ','), p.name))
                                          THEN 'high|confirmed' ELSE 'low|contradicted' END
         ELSE CASE WHEN len(list_intersect(c.unsafe_params, string_split(f.none_checks, ','))) > 0 THEN 'low|contradicted' ELSE 'high|confirmed' END
    END AS k01,
    CASE WHEN c.answer = 'UNCLEAR' THEN 'inconclusive|no_data'
         WHEN (c.answer = 'SAFE' AND f.has_return_on_all_paths) OR (c.answer = 'UNSAFE' AND NOT f.has_return_on_all_paths) THEN 'high|confirmed'
         ELSE 'low|contradicted' END AS k02,
    CASE WHEN c.response = 'UNCLEAR' THEN 'inconclusive|no_data'
         WHEN contains(lower(c.response), 'bare except') AND f.has_bare_except THEN 'high|confirmed'
         WHEN contains(lower(c.response), 'bare except') THEN 'low|contradicted'
         WHEN contains(lower(c.response), 'broad') AND f.has_broad_except THEN 'high|confirmed'
         WHEN contains(lower(c.response), 'broad') THEN 'low|contradicted' ELSE 'medium|no_data' END AS k03
  FROM k_parsed c JOIN ffacts f ON f.file_id = c.file_id AND f.line_start = c.line_start)
"""


def _k(sql):
    return with_facts(sql, CLAIM_CTES)


def _validated(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return K.validate(K.claims(f), f)


@code_query("x22_parsed_answers", _k("SELECT file_id, qualified_name, response, answer, array_to_string(unsafe_params, ',') AS unsafe_params FROM k_parsed"))
def x22_parsed_answers(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    c = K.claims(f)
    a, p = K.parse_answer(F.col("response"))
    return c.select("file_id", "qualified_name", "response", a.alias("answer"), F.array_join(p, ",").alias("unsafe_params"))


def _pair(col):
    return F.concat_ws("|", F.col(f"{col}.c"), F.col(f"{col}.r"))


@code_query("k01_null_safety_claims", _k("SELECT file_id, qualified_name, answer, k01 AS validation FROM k_valid"))
def k01_null_safety_claims(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("file_id", "qualified_name", "answer", _pair("null_safety").alias("validation"))


@code_query("k02_return_claims", _k("SELECT file_id, qualified_name, answer, k02 AS validation FROM k_valid"))
def k02_return_claims(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("file_id", "qualified_name", "answer", _pair("return_paths").alias("validation"))


@code_query("k03_exception_claims", _k("SELECT file_id, qualified_name, response, k03 AS validation FROM k_valid"))
def k03_exception_claims(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("file_id", "qualified_name", "response", _pair("exceptions").alias("validation"))


@code_query("k04_null_safety_findings", _k("""
SELECT file_id, qualified_name || ':null_safety' AS issue_id, CASE WHEN split_part(k01, '|', 2) = 'confirmed' THEN 'high' ELSE 'medium' END AS severity,
       'logic' AS category, 'Null safety issue: ' || array_to_string(unsafe_params, ', ') AS title,
       function_name || ':' || CAST(line_start AS VARCHAR) AS location, 'tier3_semantic' AS tier, split_part(k01, '|', 1) AS confidence
FROM k_valid WHERE answer = 'UNSAFE' AND len(unsafe_params) > 0
"""))
def k04_null_safety_findings(spark, sf_dir):
    return K.null_safety_findings(_validated(spark, sf_dir)).drop("llm_metadata")


@code_query("x23_contract_answers", _k("""
SELECT file_id, qualified_name,
  CAST(CASE WHEN json_valid(response) THEN coalesce(json_array_length(json_extract(response, '$.preconditions')), 0) ELSE 0 END AS BIGINT) AS n_pre,
  CAST(CASE WHEN json_valid(response) THEN coalesce(json_array_length(json_extract(response, '$.postconditions')), 0) ELSE 0 END AS BIGINT) AS n_post,
  CAST(CASE WHEN json_valid(response) THEN coalesce(json_array_length(json_extract(response, '$.assumptions')), 0) ELSE 0 END AS BIGINT) AS n_assumptions,
  CAST(CASE WHEN json_valid(response) THEN coalesce(json_array_length(json_extract(response, '$.raises')), 0) ELSE 0 END AS BIGINT) AS n_raises,
  CASE WHEN NOT json_valid(response) THEN 'low'
       WHEN tot >= 4 AND loc < 30 THEN 'high' WHEN tot >= 2 AND loc < 50 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, CASE WHEN json_valid(response) THEN
        coalesce(json_array_length(json_extract(response, '$.preconditions')), 0) + coalesce(json_array_length(json_extract(response, '$.postconditions')), 0)
        + coalesce(json_array_length(json_extract(response, '$.assumptions')), 0) + coalesce(json_array_length(json_extract(response, '$.raises')), 0)
        ELSE 0 END AS tot
      FROM (SELECT file_id, qualified_name, loc, CASE (file_id + line_start) % 3
              WHEN 0 THEN '{"preconditions": ["' || function_name || ' input is valid"], "postconditions": ["returns"], "raises": ["ValueError", "TypeError"]}'
              WHEN 1 THEN '{"preconditions": [], "assumptions": ["a", "b"]}' ELSE 'not json' END AS response FROM ffacts))
"""))
def x23_contract_answers(spark, sf_dir):
    return K.parse_contract_answers(K.json_answers(for_corpus(spark, sf_dir).facts))


@code_query("x24_prompts", _k("""
SELECT f.file_id, f.qualified_name,
  'Function: ' || f.qualified_name || chr(10) || 'Parameters: ' ||
  coalesce((SELECT string_agg(p.name || ': ' || coalesce(p.type_hint, 'untyped') || ', ' || CASE WHEN p.has_default THEN 'optional' ELSE 'required' END,
                              '; ' ORDER BY p.pos) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.line_start), 'none') || chr(10) ||
  'Tests: ' || CASE WHEN f.none_checks = '' THEN 'no parameter is tested' ELSE 'tested parameters: ' || replace(f.none_checks, ',', ', ') END || chr(10) ||
  'Calls: ' || CASE WHEN f.calls = '' THEN 'none' ELSE array_to_string(list_slice(string_split(f.calls, ','), 1, 10), ', ') ||
     CASE WHEN len(string_split(f.calls, ',')) > 10 THEN ' + ' || CAST(len(string_split(f.calls, ',')) - 10 AS VARCHAR) || ' others' ELSE '' END END AS prompt
FROM ffacts f
"""))
def x24_prompts(spark, sf_dir):
    return K.prompts(for_corpus(spark, sf_dir).facts)


def _kw_sql(table: dict, src: str, id_col: str, text_col: str) -> str:
    vals = ", ".join(f"({_lit(w.lower())}, {_lit(lang)})" for lang, ws in table.items() for w in ws)
    return f"""(SELECT d.{id_col}, CASE WHEN trim(d.{text_col}) = '' THEN 'unknown' ELSE coalesce(g.guess, 'unknown') END AS guess
  FROM {src} d LEFT JOIN (
    SELECT {id_col}, arg_min(lang, (-score, lang)) AS guess FROM (
      SELECT t.{id_col}, k.lang, sum(1.0) AS score
      FROM (SELECT {id_col}, unnest(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM {src}) t
      JOIN (VALUES {vals}) k(word, lang) ON k.word = t.word GROUP BY t.{id_col}, k.lang) GROUP BY {id_col}) g ON g.{id_col} = d.{id_col})"""


_EXT_VALUES = ", ".join(f"({_lit(e)}, {_lit(LG.ALIASES.get(n, n))})" for e, n in LG.EXTENSIONS.items())
_CYCLE = "[" + ", ".join(_lit(e) for e in LG.EXT_CYCLE) + "]"
LANG_CTES = f"""
mixed AS (SELECT file_id, regexp_replace(path, '\\.py$', '') || '.' || {_CYCLE}[file_id % {len(LG.EXT_CYCLE)} + 1] AS path, content FROM code_files),
detected AS (
  SELECT m.file_id, m.path, coalesce(e.language, g.guess) AS language, CASE WHEN e.language IS NOT NULL THEN 'extension' ELSE 'content' END AS method
  FROM mixed m LEFT JOIN (VALUES {_EXT_VALUES}) e(ext, language) ON e.ext = lower(regexp_extract(m.path, '[^.]*$', 0))
  JOIN {_kw_sql(LG.CODE_KEYWORDS, 'mixed', 'file_id', 'content')} g ON g.file_id = m.file_id)
"""


@code_query("x17_language_by_extension", with_facts("SELECT * FROM detected", LANG_CTES))
def x17_language_by_extension(spark, sf_dir):
    files = LG.mixed_paths(for_corpus(spark, sf_dir).files)
    return LG.detect(spark, files)


@query("x18_text_language", "SELECT d.doc_id, g.guess, d.lang, g.guess = d.lang AS correct FROM documents d JOIN "
       + _kw_sql(LG.TEXT_KEYWORDS, "documents", "doc_id", "text") + " g ON g.doc_id = d.doc_id")
def x18_text_language(spark, sf_dir):
    """Keyword-score language guess of every document against ``documents.lang``; array functions, no shuffle."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.split(F.lower("text"), r"[^\p{L}\p{N}_]+").alias("w"))

    def hits(keywords: list[str]):
        return F.size(F.filter("w", lambda x: x.isin(*keywords)))

    scores = [F.struct((-hits(ws)).alias("s"), F.lit(lang).alias("l")) for lang, ws in LG.TEXT_KEYWORDS.items()]
    best = F.array_min(F.array(*scores))
    guess = F.when((F.trim("text") == "") | (best["s"] == 0), "unknown").otherwise(best["l"])
    return docs.select("doc_id", guess.alias("guess"), "lang").withColumn("correct", F.col("guess") == F.col("lang"))


@code_query("x19_supported_share", with_facts("""
SELECT language, CAST(count(*) AS BIGINT) AS n, language IN ('python') AS supported,
       round(count(*) / sum(count(*)) OVER (), 4) AS share FROM detected GROUP BY language
""", LANG_CTES))
def x19_supported_share(spark, sf_dir):
    d = x17_language_by_extension(spark, sf_dir)
    g = d.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.count(F.lit(1)).alias("t"))
    return g.crossJoin(F.broadcast(total)).select("language", "n", F.col("language").isin(*LG.SUPPORTED).alias("supported"),
                                                  F.round(F.col("n") / F.col("t"), 4).alias("share"))


@code_query("x20_size_guards", with_facts(f"""
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'file_too_large' AS reason FROM code_files WHERE octet_length(encode(content)) > {LG.MAX_FILE_BYTES}
  UNION ALL SELECT CASE WHEN loc > {LG.MAX_LLM_LOC} THEN 'function_too_long' ELSE 'function_checked' END FROM fmetrics)
GROUP BY reason
"""))
def x20_size_guards(spark, sf_dir):
    sub = for_corpus(spark, sf_dir)
    return LG.size_guards(sub.files, sub.fn_metrics)


_CFG_CTES = """
c_st AS (SELECT file_id, fn_ln, ln, indent, kind, parent_ln FROM fst WHERE kind <> 'docstring'),
c_edges AS (
  SELECT file_id, fn_ln, src, dst, kind FROM (
    SELECT file_id, fn_ln, ln AS src, lead(ln) OVER (PARTITION BY file_id, fn_ln, parent_ln ORDER BY ln) AS dst, 'sequence' AS kind, kind AS k0 FROM c_st)
  WHERE k0 NOT IN ('return', 'raise', 'break', 'continue') AND dst IS NOT NULL
  UNION
  SELECT h.file_id, h.fn_ln, h.ln, (SELECT min(c.ln) FROM c_st c WHERE c.file_id = h.file_id AND c.fn_ln = h.fn_ln AND c.parent_ln = h.ln), 'enter'
  FROM c_st h WHERE h.kind IN ('if', 'elif', 'else', 'for', 'while', 'try', 'except', 'finally', 'with')
    AND EXISTS (SELECT 1 FROM c_st c WHERE c.file_id = h.file_id AND c.fn_ln = h.fn_ln AND c.parent_ln = h.ln)
  UNION
  SELECT h.file_id, h.fn_ln, (SELECT max(c.ln) FROM c_st c WHERE c.file_id = h.file_id AND c.fn_ln = h.fn_ln AND c.parent_ln = h.ln), h.ln, 'back'
  FROM c_st h WHERE h.kind IN ('for', 'while')
    AND EXISTS (SELECT 1 FROM c_st c WHERE c.file_id = h.file_id AND c.fn_ln = h.fn_ln AND c.parent_ln = h.ln)
  UNION
  SELECT file_id, fn_ln, ln, 0, 'exit' FROM c_st WHERE kind IN ('return', 'raise')
  UNION
  SELECT j.file_id, j.fn_ln, j.ln, (SELECT b.ln FROM blocks b WHERE b.file_id = j.file_id AND b.kind IN ('for', 'while') AND b.ln < j.ln
                                    AND b.ln_end >= j.ln AND b.indent < j.indent ORDER BY b.ln DESC LIMIT 1), j.kind
  FROM c_st j WHERE j.kind IN ('break', 'continue')
    AND EXISTS (SELECT 1 FROM blocks b WHERE b.file_id = j.file_id AND b.kind IN ('for', 'while') AND b.ln < j.ln AND b.ln_end >= j.ln AND b.indent < j.indent))
"""


@code_query("x21_cfg_edges", with_facts("""
SELECT file_id, CAST(fn_ln AS BIGINT) AS fn_ln, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, kind FROM c_edges
""", _CFG_CTES))
def x21_cfg_edges(spark, sf_dir):
    """Control-flow edges of every function."""
    sub = for_corpus(spark, sf_dir)
    return FL.cfg_edges(sub.fn_stmts, sub.blocks)


@code_query("x21_cfg_edge_counts", with_facts("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM c_edges GROUP BY kind", _CFG_CTES))
def x21_cfg_edge_counts(spark, sf_dir):
    """Edge counts by type over the corpus."""
    return x21_cfg_edges(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
