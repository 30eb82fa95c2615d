"""DuckDB oracle: the same substrate written independently as plain SQL.

The oracle uses the straightforward formulations (inequality joins, correlated
subqueries) that the Spark plans avoid, so agreement checks the linear Spark versions.
Patterns come from ``lintlake.functions.patterns`` so both sides read the same regex.
"""

from __future__ import annotations

from lintlake.functions import patterns as P


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


BASE_CTES = f"""
raw_lines AS (
  SELECT file_id, unnest(generate_series(1, len(arr))) AS ln, unnest(arr) AS line
  FROM (SELECT file_id, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS arr FROM code_files)
),
l1 AS (
  SELECT file_id, ln, line,
         length(replace(line, chr(9), '    ')) - length(ltrim(replace(line, chr(9), '    '))) AS indent,
         trim(replace(line, chr(9), '    ')) AS s,
         (length(line) - length(replace(line, '\"\"\"', ''))) // 3 AS q
  FROM raw_lines
),
l2 AS (
  SELECT *, coalesce(sum(q) OVER (PARTITION BY file_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q_before
  FROM l1
),
l3 AS (
  SELECT *, q_before % 2 = 1 AS in_str, s = '' AS is_blank,
         regexp_replace(s, {_lit(P.TRAILING_COMMENT)}, '') AS code
  FROM l2
),
l4 AS (
  SELECT *, starts_with(s, '#') AND NOT in_str AS is_comment,
         (s <> '') AND (in_str OR NOT starts_with(s, '#')) AS is_content,
         CASE WHEN in_str OR q > 0 THEN NULL ELSE regexp_replace(code, {_lit(P.STRING_LITERAL)}, '', 'g') END AS bare
  FROM l3
),
l5 AS (
  SELECT *, CASE WHEN bare IS NULL THEN 0
                 ELSE (length(bare) - length(translate(bare, '([{{', ''))) - (length(bare) - length(translate(bare, ')]}}', ''))) END AS bal
  FROM l4
),
lines AS (
  SELECT *, coalesce(sum(bal) OVER (PARTITION BY file_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS cont,
         CASE WHEN in_str OR q > 0 THEN q_before // 2 + 1 END AS str_region,
         regexp_extract(code, {_lit(P.FIRST_WORD)}, 1) AS word
  FROM l5
),
stmt0 AS (
  SELECT *,
    CASE WHEN starts_with(code, '@') THEN 'decorator'
         WHEN starts_with(code, '\"\"\"') THEN 'docstring'
         WHEN word = 'async' THEN regexp_extract(code, {_lit(P.ASYNC_WORD)}, 1)
         WHEN word IN {_list(P.KEYWORD_KINDS)} THEN word
         WHEN regexp_matches(code, {_lit(P.AUG_ASSIGN)}) THEN 'augassign'
         WHEN regexp_matches(code, {_lit(P.ASSIGN)}) THEN 'assign'
         ELSE 'expr' END AS kind,
    word = 'async' AS is_async
  FROM lines
  WHERE NOT is_blank AND NOT is_comment AND NOT in_str AND NOT cont
),
stmts AS (
  SELECT *, lead(ln) OVER (PARTITION BY file_id ORDER BY ln) AS next_ln,
         lead(kind) OVER (PARTITION BY file_id ORDER BY ln) AS next_kind,
         lead(str_region) OVER (PARTITION BY file_id ORDER BY ln) AS next_region,
         lead(code) OVER (PARTITION BY file_id ORDER BY ln) AS next_code,
         lag(kind) OVER (PARTITION BY file_id, indent ORDER BY ln) AS prev_sibling_kind
  FROM stmt0
),
heads AS (
  SELECT h.*, (SELECT min(x.ln) FROM stmts x WHERE x.file_id = h.file_id AND x.ln > h.ln AND x.indent <= h.indent) AS stop
  FROM stmts h WHERE h.kind IN {_list(P.HEADER_KINDS)}
),
blocks AS (
  SELECT h.*, greatest(h.ln, coalesce((SELECT max(c.ln) FROM lines c WHERE c.file_id = h.file_id AND c.is_content
                                        AND c.ln < coalesce(h.stop, 2147483647)), h.ln)) AS ln_end
  FROM heads h
),
defs0 AS (
  SELECT file_id, ln, ln_end, indent, kind, code, next_kind, next_region,
         CASE WHEN kind = 'def' THEN regexp_extract(code, {_lit(P.DEF_NAME)}, 2)
              ELSE regexp_extract(code, {_lit(P.CLASS_NAME)}, 1) END AS name
  FROM blocks WHERE kind IN ('def', 'class')
),
defs AS (
  SELECT d.*,
    (SELECT p.kind FROM defs0 p WHERE p.file_id = d.file_id AND p.ln < d.ln AND p.ln_end >= d.ln AND p.indent < d.indent
      ORDER BY p.ln DESC LIMIT 1) AS parent_kind,
    (SELECT p.name FROM defs0 p WHERE p.file_id = d.file_id AND p.ln < d.ln AND p.ln_end >= d.ln AND p.indent < d.indent
      ORDER BY p.ln DESC LIMIT 1) AS parent_name,
    (SELECT p.ln FROM defs0 p WHERE p.file_id = d.file_id AND p.ln < d.ln AND p.ln_end >= d.ln AND p.indent < d.indent
      ORDER BY p.ln DESC LIMIT 1) AS parent_ln,
    EXISTS (SELECT 1 FROM defs0 p WHERE p.file_id = d.file_id AND p.ln < d.ln AND p.ln_end >= d.ln
            AND p.indent < d.indent AND p.kind = 'def') AS in_def
  FROM defs0 d
),
docstrings AS (
  SELECT file_id, str_region, min(ln) AS doc_start, max(ln) AS doc_end,
    trim(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY ln), '^\\s*\"\"\"', ''), '\"\"\"\\s*$', '')) AS docstring
  FROM lines WHERE str_region IS NOT NULL GROUP BY file_id, str_region
),
functions AS (
  SELECT d.file_id, d.name,
    CASE WHEN d.parent_kind = 'class' THEN d.parent_name END AS class_name,
    CASE WHEN d.parent_kind = 'class' THEN d.parent_name || '.' || d.name ELSE d.name END AS qualified_name,
    d.ln AS ln_start, d.ln_end, d.indent, d.code,
    nullif(trim(regexp_extract(d.code, {_lit(P.DEF_PARAMS)}, 1)), '') AS params_txt,
    nullif(trim(regexp_extract(d.code, {_lit(P.DEF_RETURN)}, 1)), '') AS return_type,
    ds.docstring, ds.doc_end - ds.doc_start + 1 AS doc_lines,
    CASE WHEN d.next_kind = 'docstring' THEN d.next_region END AS doc_region
  FROM defs d
  LEFT JOIN docstrings ds ON ds.file_id = d.file_id AND d.next_kind = 'docstring' AND ds.str_region = d.next_region
  WHERE d.kind = 'def' AND NOT d.in_def
),
params AS (
  SELECT f.file_id, f.ln_start, f.qualified_name, f.class_name, f.name AS function_name, p.pos, p.ptxt,
    regexp_extract(p.ptxt, {_lit(P.PARAM_NAME)}, 1) AS name,
    nullif(trim(regexp_extract(p.ptxt, {_lit(P.PARAM_HINT)}, 1)), '') AS type_hint,
    contains(p.ptxt, '=') AS has_default,
    regexp_matches(p.ptxt, {_lit(P.MUTABLE_DEFAULT)}) AS default_is_mutable
  FROM functions f,
    LATERAL (SELECT unnest(generate_series(1, len(string_split(f.params_txt, ',')))) AS pos,
                    trim(unnest(string_split(f.params_txt, ','))) AS ptxt) p
  WHERE f.params_txt IS NOT NULL AND p.ptxt <> '' AND regexp_extract(p.ptxt, {_lit(P.PARAM_NAME)}, 1) NOT IN ('', '*')
),
classes AS (
  SELECT d.file_id, d.name, d.ln AS ln_start, d.ln_end, d.indent,
    regexp_extract(d.code, {_lit(P.CLASS_BASES)}, 1) AS bases_txt,
    ds.docstring,
    (SELECT count(*) FROM defs m WHERE m.file_id = d.file_id AND m.kind = 'def' AND m.parent_kind = 'class' AND m.parent_ln = d.ln) AS n_methods
  FROM defs d
  LEFT JOIN docstrings ds ON ds.file_id = d.file_id AND d.next_kind = 'docstring' AND ds.str_region = d.next_region
  WHERE d.kind = 'class'
),
imports AS (
  SELECT file_id, ln, pos, regexp_extract(trim(item), '^([A-Za-z0-9_.]+)', 1) AS module,
         regexp_extract(trim(item), '^([A-Za-z0-9_.]+)', 1) AS name,
         nullif(regexp_extract(item, '\\sas\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS alias, false AS is_from
  FROM (SELECT file_id, ln, unnest(generate_series(0, len(string_split(regexp_extract(code, {_lit(P.IMPORT_LINE)}, 1), ',')) - 1)) AS pos,
               unnest(string_split(regexp_extract(code, {_lit(P.IMPORT_LINE)}, 1), ',')) AS item
        FROM stmts WHERE kind = 'import')
  UNION ALL
  SELECT file_id, ln, pos, module, regexp_extract(trim(item), '^([A-Za-z0-9_*]+)', 1) AS name,
         nullif(regexp_extract(item, '\\sas\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), '') AS alias, true AS is_from
  FROM (SELECT file_id, ln, regexp_extract(code, {_lit(P.FROM_LINE)}, 1) AS module,
               unnest(generate_series(0, len(string_split(regexp_extract(code, {_lit(P.FROM_LINE)}, 2), ',')) - 1)) AS pos,
               unnest(string_split(regexp_extract(code, {_lit(P.FROM_LINE)}, 2), ',')) AS item
        FROM stmts WHERE kind = 'from' AND regexp_matches(code, {_lit(P.FROM_LINE)}))
)
"""


def with_base(select_sql: str, extra_ctes: str = "") -> str:
    """A full oracle statement: the substrate CTEs, optional extra CTEs, then the query."""
    ctes = BASE_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    head = "WITH RECURSIVE" if "RECURSIVE_CTE" in extra_ctes else "WITH"
    return f"{head} {ctes}\n{select_sql}"


def _occ(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), {_lit(pattern)}, 0))"


_NEST = _list(P.NEST_KINDS)
_COG = _list(P.COG_NEST_KINDS)
_LOOP = _list(P.LOOP_KINDS)

METRIC_CTES = f"""
sdepth AS (
  SELECT s.file_id, s.ln,
    (SELECT count(*) FROM blocks b WHERE b.file_id = s.file_id AND b.kind IN {_NEST} AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent) AS d_all,
    (SELECT count(*) FROM blocks b WHERE b.file_id = s.file_id AND b.kind IN {_COG} AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent) AS d_cog,
    (SELECT count(*) FROM blocks b WHERE b.file_id = s.file_id AND b.kind IN {_LOOP} AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent) AS d_loop,
    (SELECT count(*) FROM blocks b WHERE b.file_id = s.file_id AND b.kind = 'for' AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent) AS d_for,
    (SELECT count(*) FROM blocks b WHERE b.file_id = s.file_id AND b.kind = 'with' AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent) AS d_with
  FROM stmts s
),
fst AS (
  SELECT s.*, f.ln_start AS fn_ln, f.qualified_name,
         (SELECT b.ln FROM blocks b WHERE b.file_id = s.file_id AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent
           ORDER BY b.ln DESC LIMIT 1) AS parent_ln,
         d.d_all - h.d_all AS nest, d.d_cog - h.d_cog AS nest_cog, d.d_loop - h.d_loop > 0 AS in_loop,
         d.d_for - h.d_for > 0 AS in_for, d.d_with - h.d_with > 0 AS in_with
  FROM stmts s
  JOIN functions f ON f.file_id = s.file_id AND s.ln > f.ln_start AND s.ln <= f.ln_end AND s.indent > f.indent
  JOIN sdepth d ON d.file_id = s.file_id AND d.ln = s.ln
  JOIN sdepth h ON h.file_id = s.file_id AND h.ln = f.ln_start
),
fper AS (
  SELECT file_id, fn_ln, ln, kind,
    CASE WHEN kind <> 'docstring' THEN {_occ('bare', P.DECISION_WORDS)} ELSE 0 END
      + CASE WHEN kind = 'else' AND prev_sibling_kind IN ('for', 'while', 'except') THEN 1 ELSE 0 END AS dec,
    CASE WHEN kind IN ('if', 'elif', 'for', 'while', 'try') THEN 1 + nest_cog ELSE 0 END
      + CASE WHEN kind = 'except' THEN 1 ELSE 0 END
      + CASE WHEN kind <> 'docstring' THEN {_occ('bare', P.COMPREHENSION)} ELSE 0 END * (1 + nest_cog)
      + CASE WHEN kind = 'expr' THEN {_occ('bare', P.BOOL_WORDS)} ELSE 0 END AS cog,
    (CASE WHEN kind IN ('if', 'elif', 'for', 'while', 'try', 'with') THEN 1 ELSE 0 END) AS node,
    (CASE WHEN kind <> 'docstring' AND {_occ('bare', P.COMPREHENSION)} + {_occ('bare', P.LAMBDA)} > 0 THEN 1 ELSE 0 END) AS comp,
    nest
  FROM fst
),
fper2 AS (
  SELECT *, CASE WHEN node + comp > 0 THEN nest + node + comp ELSE 0 END AS depth FROM fper
),
fagg AS (
  SELECT file_id, fn_ln, 1 + sum(dec) AS cyclomatic, sum(cog) AS cognitive, max(depth) AS max_nesting
  FROM fper2 GROUP BY file_id, fn_ln
),
fmax AS (
  SELECT p.file_id, p.fn_ln, min(p.ln) AS nesting_ln
  FROM fper2 p JOIN fagg a ON a.file_id = p.file_id AND a.fn_ln = p.fn_ln AND p.depth = a.max_nesting
  WHERE a.max_nesting > 0 GROUP BY p.file_id, p.fn_ln
),
fmetrics AS (
  SELECT f.*, f.ln_end - f.ln_start + 1 AS loc,
    (SELECT count(*) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start) AS n_params,
    CAST(coalesce(a.cyclomatic, 1) AS BIGINT) AS cyclomatic, CAST(coalesce(a.cognitive, 0) AS BIGINT) AS cognitive,
    CAST(coalesce(a.max_nesting, 0) AS BIGINT) AS max_nesting, m.nesting_ln,
    (SELECT p.kind FROM fper2 p WHERE p.file_id = f.file_id AND p.fn_ln = f.ln_start AND p.ln = m.nesting_ln) AS nesting_kind
  FROM functions f
  LEFT JOIN fagg a ON a.file_id = f.file_id AND a.fn_ln = f.ln_start
  LEFT JOIN fmax m ON m.file_id = f.file_id AND m.fn_ln = f.ln_start
)
"""


def with_metrics(select_sql: str, extra_ctes: str = "") -> str:
    ctes = METRIC_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return with_base(select_sql, ctes)


from lintlake.operators import facts as _FX  # noqa: E402

FACT_CTES = f"""
parent AS (
  SELECT s.file_id, s.ln,
    (SELECT b.ln FROM blocks b WHERE b.file_id = s.file_id AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent
      ORDER BY b.ln DESC LIMIT 1) AS parent_ln,
    (SELECT b.kind FROM blocks b WHERE b.file_id = s.file_id AND b.ln < s.ln AND b.ln_end >= s.ln AND b.indent < s.indent
      ORDER BY b.ln DESC LIMIT 1) AS parent_kind
  FROM stmts s
),
fcalls AS (
  SELECT file_id, fn_ln, qualified_name, ln, kind, code, pos, call FROM (
    SELECT file_id, fn_ln, qualified_name, ln, kind, code, unnest(generate_series(1, len(cs))) AS pos, unnest(cs) AS call
    FROM (SELECT *, regexp_extract_all(coalesce(bare, ''), {_lit(P.CALL)}, 1) AS cs FROM fst))
  WHERE call NOT IN {_list(_FX.NOT_CALLS)}
),
fcall_first AS (
  SELECT file_id, fn_ln, call, min(ln * 100000 + pos) AS first_at FROM fcalls GROUP BY file_id, fn_ln, call
),
fst2 AS (
  SELECT s.*, p.parent_kind,
    s.kind = 'except' AND regexp_matches(s.code, '^except\\s*:') AS bare_except,
    CASE WHEN s.kind = 'except' THEN nullif(trim(regexp_extract(s.code, {_lit(_FX.EXCEPT_TYPE)}, 1)), '') END AS caught,
    CASE WHEN s.kind = 'raise' THEN nullif(trim(regexp_extract(s.code, {_lit(_FX.RAISE_TYPE)}, 1)), '') END AS raised,
    nullif(regexp_extract(s.code, {_lit(_FX.TYPE_CHECK)}, 2), '') AS type_var,
    regexp_matches(s.code, {_lit(_FX.COMMAND_FSTRING)}) AS cmd_fstring,
    (s.kind IN ('return', 'raise') AND p.parent_kind IN ('if', 'elif', 'for', 'while', 'with', 'try')
      AND EXISTS (SELECT 1 FROM fst n WHERE n.file_id = s.file_id AND n.ln = s.next_ln AND n.indent = s.indent)) AS unreach
  FROM fst s LEFT JOIN parent p ON p.file_id = s.file_id AND p.ln = s.ln
),
fnone AS (
  SELECT file_id, fn_ln, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(_FX.NONE_CHECK)}, 2)) AS v FROM fst
),
ffacts AS (
  SELECT f.file_id, f.name AS function_name, f.qualified_name, f.class_name, f.ln_start AS line_start, f.ln_end AS line_end,
    f.return_type AS return_annotation, f.loc, f.cyclomatic, f.n_params,
    coalesce((SELECT bool_or(bare_except) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), false) AS has_bare_except,
    coalesce((SELECT bool_or(caught IN ('Exception', 'BaseException')) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), false) AS has_broad_except,
    coalesce((SELECT string_agg(DISTINCT caught, ',' ORDER BY caught) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), '') AS caught_types,
    coalesce((SELECT string_agg(DISTINCT raised, ',' ORDER BY raised) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), '') AS raise_types,
    coalesce((SELECT string_agg(DISTINCT type_var, ',' ORDER BY type_var) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), '') AS type_checks,
    coalesce((SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM fnone s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), '') AS none_checks,
    coalesce((SELECT bool_or(cmd_fstring) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), false) AS command_execution_has_fstring,
    coalesce((SELECT bool_or(kind = 'return') FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), false) AS has_return_on_all_paths,
    coalesce((SELECT bool_or(unreach) FROM fst2 s WHERE s.file_id = f.file_id AND s.fn_ln = f.ln_start), false) AS has_unreachable_code,
    coalesce((SELECT string_agg(call, ',' ORDER BY first_at) FROM fcall_first c WHERE c.file_id = f.file_id AND c.fn_ln = f.ln_start), '') AS calls,
    coalesce((SELECT bool_or(call = 'open' AND kind <> 'with') FROM fcalls c WHERE c.file_id = f.file_id AND c.fn_ln = f.ln_start), false) AS uses_open_without_with,
    coalesce((SELECT bool_or(call IN {_list(P.COMMAND_CALLS)}) FROM fcalls c WHERE c.file_id = f.file_id AND c.fn_ln = f.ln_start), false) AS uses_command_execution,
    coalesce((SELECT bool_or(default_is_mutable) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start), false) AS has_mutable_default_args,
    coalesce((SELECT string_agg(name, ',' ORDER BY pos) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start
              AND NOT starts_with(name, '*') AND name IN {_list(P.BUILTINS)}), '') AS shadows_builtin,
    EXISTS (SELECT 1 FROM imports i WHERE i.file_id = f.file_id AND i.name = '*') AS star_imports_used
  FROM fmetrics f
)
"""


def with_facts(select_sql: str, extra_ctes: str = "") -> str:
    ctes = FACT_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return with_metrics(select_sql, ctes)
