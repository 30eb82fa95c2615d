"""Queries for graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import graph as G
from lintlake.operators.critics import ATTR_BASE, FREE_NAME
from lintlake.plans.catalog import code_query, query
from lintlake.plans.oracle import _lit, with_base, with_facts
from lintlake.plans.substrate import for_corpus
from lintlake.sources import corpus

_STD = "(" + ", ".join(_lit(m) for m in G.STDLIB) + ")"

GRAPH_CTES = f"""
RECURSIVE_CTE_MARK AS (SELECT 1 AS x),
g_mods AS (SELECT DISTINCT i.file_id, i.module, c.path AS src_path FROM imports i JOIN code_files c ON c.file_id = i.file_id
           WHERE i.module <> '' AND i.module NOT IN {_STD}),
g_m1 AS (SELECT *, string_split(regexp_extract(src_path, '^(.*)/[^/]*$', 1), '/') AS parts,
                CASE WHEN contains(src_path, '/') THEN len(string_split(regexp_extract(src_path, '^(.*)/[^/]*$', 1), '/')) ELSE 0 END AS depth
         FROM g_mods),
g_m2 AS (SELECT *, unnest(generate_series(depth, 0, -1)) AS k FROM g_m1),
g_cand AS (
  SELECT file_id, module, src_path, 2 * (depth - k) AS prio,
         CASE WHEN k = 0 THEN '' ELSE array_to_string(list_slice(parts, 1, k), '/') || '/' END || module || '.py' AS cand FROM g_m2
  UNION ALL
  SELECT file_id, module, src_path, 2 * (depth - k) + 1 AS prio,
         CASE WHEN k = 0 THEN '' ELSE array_to_string(list_slice(parts, 1, k), '/') || '/' END || module || '/__init__.py' AS cand FROM g_m2),
g_resolved AS (
  SELECT g.file_id, g.module, g.src_path, arg_min(g.cand, g.prio) AS dst_path, arg_min(c.file_id, g.prio) AS dst_id
  FROM g_cand g JOIN code_files c ON c.path = g.cand GROUP BY g.file_id, g.module, g.src_path),
g_edges AS (SELECT DISTINCT src_path AS src, dst_path AS dst FROM g_resolved),
g_reach(src, dst) AS (SELECT src, dst FROM g_edges UNION SELECT r.src, e.dst FROM g_reach r JOIN g_edges e ON r.dst = e.src),
g_cls AS (SELECT file_id, name AS dst, ln_start AS dst_ln FROM classes),
g_bases AS (SELECT file_id, name AS src, ln_start AS at, regexp_extract(trim(b), {_lit(G.TYPE_NAME)}, 1) AS dst
            FROM (SELECT *, unnest(string_split(bases_txt, ',')) AS b FROM classes) WHERE trim(b) <> ''),
g_ptypes AS (SELECT p.file_id, p.class_name AS src, p.ln_start AS at, regexp_extract(p.type_hint, {_lit(G.TYPE_NAME)}, 1) AS dst
             FROM params p WHERE p.class_name IS NOT NULL AND p.type_hint IS NOT NULL
             UNION ALL
             SELECT file_id, class_name, ln_start, regexp_extract(return_type, {_lit(G.TYPE_NAME)}, 1) FROM functions
             WHERE class_name IS NOT NULL AND return_type IS NOT NULL),
g_cedges AS (SELECT c.file_id, f.class_name AS src, c.ln AS at, split_part(c.call, '.', 1) AS dst
             FROM fcalls c JOIN functions f ON f.file_id = c.file_id AND f.ln_start = c.fn_ln
             WHERE f.class_name IS NOT NULL AND contains(c.call, '.') AND split_part(c.call, '.', 1) <> f.class_name),
g_cedge_all AS (SELECT DISTINCT e.file_id, e.src, e.dst FROM (SELECT * FROM g_bases UNION ALL SELECT * FROM g_ptypes UNION ALL SELECT * FROM g_cedges) e
                JOIN g_cls k ON k.file_id = e.file_id AND k.dst = e.dst WHERE k.dst_ln <= e.at),
g_acc AS (SELECT file_id, class_name, fn_ln, obj, count(*) AS n FROM (
            SELECT s.file_id, f.class_name, s.fn_ln, s.ln, unnest(regexp_extract_all(coalesce(s.bare, ''), {_lit(ATTR_BASE)}, 2)) AS obj
            FROM fst s JOIN functions f ON f.file_id = s.file_id AND f.ln_start = s.fn_ln WHERE f.class_name IS NOT NULL) a
          WHERE EXISTS (SELECT 1 FROM g_cls k WHERE k.file_id = a.file_id AND k.dst = a.obj AND k.dst_ln <= a.ln) AND a.obj <> a.class_name
          GROUP BY file_id, class_name, fn_ln, obj),
g_cp AS (
  SELECT c.file_id, c.name, c.n_methods,
    CAST((SELECT count(DISTINCT dst) FROM g_cedge_all e WHERE e.file_id = c.file_id AND e.src = c.name) AS BIGINT) AS efferent,
    CAST((SELECT count(DISTINCT src) FROM g_cedge_all e WHERE e.file_id = c.file_id AND e.dst = c.name AND e.src <> e.dst) AS BIGINT) AS afferent,
    coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM g_cedge_all e WHERE e.file_id = c.file_id AND e.src = c.name), '') AS dependencies,
    coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM g_cedge_all e WHERE e.file_id = c.file_id AND e.dst = c.name AND e.src <> e.dst), '') AS dependents
  FROM classes c),
g_cp2 AS (SELECT *, CASE WHEN efferent + afferent > 0 THEN efferent / (efferent + afferent) ELSE 0.0 END AS instability FROM g_cp)
"""


def _g(sql):
    return with_facts(sql, GRAPH_CTES)


def _sub(spark, sf_dir):
    return for_corpus(spark, sf_dir)


@code_query("g01_import_edges", with_base("""
SELECT DISTINCT regexp_replace(regexp_replace(c.path, '(/__init__)?\\.py$', ''), '/', '.', 'g') AS src, i.module AS dst
FROM imports i JOIN code_files c ON c.file_id = i.file_id WHERE i.module <> ''
"""))
def g01_import_edges(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return G.import_edges(sub.files, sub.imports)


@code_query("g02_resolved_imports", _g("SELECT file_id, module, src_path, dst_path, dst_id FROM g_resolved"))
def g02_resolved_imports(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return G.resolve_imports(spark, sub.files, sub.imports)


@code_query("g03_stdlib_imports", with_base(f"""
SELECT file_id, CAST(ln AS BIGINT) AS ln, module, module IN {_STD} AS is_stdlib FROM imports WHERE module <> ''
"""))
def g03_stdlib_imports(spark, sf_dir):
    im = _sub(spark, sf_dir).imports.filter(F.col("module") != "")
    std = G.stdlib_table(spark).withColumn("is_stdlib", F.lit(True))
    return im.join(F.broadcast(std), "module", "left").select(
        "file_id", F.col("ln").cast("bigint").alias("ln"), "module", F.coalesce("is_stdlib", F.lit(False)).alias("is_stdlib"))


def _reach(spark, sf_dir):
    return _sub(spark, sf_dir).reach


@code_query("g04_transitive_dependencies", _g("""
SELECT src AS module, dst AS dependency FROM g_reach UNION SELECT path, path FROM code_files
"""))
def g04_transitive_dependencies(spark, sf_dir):
    nodes = _sub(spark, sf_dir).files.select(F.col("path").alias("node"))
    r = G.with_self(_reach(spark, sf_dir), nodes)
    return r.select(F.col("src").alias("module"), F.col("dst").alias("dependency"))


@code_query("g05_reverse_dependencies", _g("""
SELECT dst AS module, src AS dependent FROM g_reach UNION SELECT path, path FROM code_files
"""))
def g05_reverse_dependencies(spark, sf_dir):
    nodes = _sub(spark, sf_dir).files.select(F.col("path").alias("node"))
    r = G.with_self(_reach(spark, sf_dir), nodes)
    return r.select(F.col("dst").alias("module"), F.col("src").alias("dependent"))


@code_query("g06_cycles", _g("""
SELECT a.src AS node, least(a.src, min(a.dst)) AS component, CAST(count(*) AS BIGINT) AS cycle_size
FROM g_reach a JOIN g_reach b ON a.src = b.dst AND a.dst = b.src
WHERE EXISTS (SELECT 1 FROM g_reach s WHERE s.src = a.src AND s.dst = a.src)
GROUP BY a.src
"""))
def g06_cycles(spark, sf_dir):
    return G.cycles(_reach(spark, sf_dir))


_G07_CTES = f"""
used AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(coalesce(bare, ''), {_lit(FREE_NAME)}, 2)) AS name
         FROM stmts WHERE kind NOT IN ('import', 'from')),
rec AS (SELECT file_id, ln, module, is_from,
               CASE WHEN is_from THEN list_sort(list(name)) ELSE [] END AS names, arg_min(alias, pos) AS alias
        FROM imports GROUP BY file_id, ln, module, is_from)
"""


@code_query("g07_unused_imports", with_base("""
SELECT r.file_id, CAST(r.ln AS BIGINT) AS ln, r.module, array_to_string(r.names, ',') AS names, r.alias, r.is_from FROM rec r
WHERE NOT list_contains(r.names, '*')
  AND NOT EXISTS (SELECT 1 FROM used u WHERE u.file_id = r.file_id
                  AND (list_contains(r.names, u.name) OR u.name = r.alias OR (len(r.names) = 0 AND u.name = r.module)))
""", _G07_CTES))
def g07_unused_imports(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    return G.unused_imports(sub.imports, sub.stmts)


def _cedges(sub):
    return G.class_edges(sub.classes, sub.functions, sub.calls)


@code_query("g08_class_edges", _g("SELECT file_id, src, dst FROM g_cedge_all"))
def g08_class_edges(spark, sf_dir):
    return _cedges(_sub(spark, sf_dir))


@code_query("g09_class_accesses", _g("SELECT file_id, class_name, CAST(fn_ln AS BIGINT) AS fn_ln, obj, CAST(n AS BIGINT) AS n FROM g_acc"))
def g09_class_accesses(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    a = G.class_accesses(sub.classes, sub.fn_stmts, sub.functions)
    return a.select("file_id", "class_name", F.col("fn_ln").cast("bigint").alias("fn_ln"), "obj", F.col("n").cast("bigint").alias("n"))


def _cp(sub):
    return G.coupling(sub.classes, _cedges(sub))


@code_query("g10_coupling", _g("""
SELECT file_id, name, efferent, afferent, round(instability, 4) AS instability, dependencies, dependents FROM g_cp2
"""))
def g10_coupling(spark, sf_dir):
    cp = _cp(_sub(spark, sf_dir))
    return cp.select("file_id", "name", "efferent", "afferent", F.round("instability", 4).alias("instability"),
                     F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


@query("g10_supplier_part_coupling", """
WITH e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem),
o AS (SELECT src AS node, count(*) AS efferent FROM e GROUP BY src),
i AS (SELECT dst AS node, count(*) AS afferent FROM e GROUP BY dst)
SELECT coalesce(o.node, i.node) AS node, CAST(coalesce(efferent, 0) AS BIGINT) AS efferent, CAST(coalesce(afferent, 0) AS BIGINT) AS afferent,
       round(coalesce(efferent, 0) / (coalesce(efferent, 0) + coalesce(afferent, 0)), 4) AS instability
FROM o FULL OUTER JOIN i ON o.node = i.node
""")
def g10_supplier_part_coupling(spark, sf_dir):
    """G10 at size over ``lineitem``: supplier -> part edges."""
    return G.supplier_part_coupling(corpus.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"))


@code_query("g11_god_classes", _g("""
SELECT file_id, name AS class_name,
  CASE WHEN efferent >= 16 OR n_methods >= 10 THEN 'critical' WHEN efferent >= 12 OR n_methods >= 7.5 THEN 'high' ELSE 'medium' END AS severity,
  concat_ws('; ', CASE WHEN efferent >= 8 THEN printf('high efferent coupling (%d dependencies)', efferent) END,
                  CASE WHEN n_methods >= 5 THEN printf('many methods (%d methods)', n_methods) END) AS reasons,
  efferent, CAST(n_methods AS BIGINT) AS method_count
FROM g_cp WHERE efferent >= 8 OR n_methods >= 5
"""))
def g11_god_classes(spark, sf_dir):
    return G.god_classes(_cp(_sub(spark, sf_dir)))


@code_query("g12_feature_envy", _g("""
SELECT file_id, class_name, method_name, envied_class, ratio, CASE WHEN ratio >= 0.85 THEN 'high' ELSE 'medium' END AS severity FROM (
  SELECT a.file_id, a.class_name, f.name AS method_name, arg_max(a.obj, (a.n, a.obj)) AS envied_class,
         round(sum(a.n) / (sum(a.n) + coalesce((SELECT sum(len(regexp_extract_all(coalesce(s.bare, ''), '(^|[^A-Za-z0-9_.])self\\.', 0)))
                                                FROM fst s WHERE s.file_id = a.file_id AND s.fn_ln = a.fn_ln), 0)), 4) AS ratio
  FROM g_acc a JOIN functions f ON f.file_id = a.file_id AND f.ln_start = a.fn_ln
  GROUP BY a.file_id, a.class_name, a.fn_ln, f.name)
WHERE ratio >= 0.7
"""))
def g12_feature_envy(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    acc = G.class_accesses(sub.classes, sub.fn_stmts, sub.functions)
    return G.feature_envy(acc, sub.fn_stmts, sub.functions)


@code_query("g13_intimacy", _g("""
SELECT a.file_id, a.src AS source, a.dst AS target, s.efferent + t.efferent AS access_count,
       CASE WHEN s.efferent + t.efferent >= 20 THEN 'high' ELSE 'medium' END AS severity
FROM g_cedge_all a JOIN g_cedge_all b ON a.file_id = b.file_id AND a.src = b.dst AND a.dst = b.src
JOIN g_cp s ON s.file_id = a.file_id AND s.name = a.src JOIN g_cp t ON t.file_id = a.file_id AND t.name = a.dst
WHERE s.efferent + t.efferent >= 10
"""))
def g13_intimacy(spark, sf_dir):
    sub = _sub(spark, sf_dir)
    e = _cedges(sub)
    return G.intimacy(e, G.coupling(sub.classes, e))


@code_query("g14_coupling_report", _g("""
SELECT file_id, CAST(count(*) AS BIGINT) AS total_classes, round(avg(afferent), 2) AS avg_afferent, round(avg(efferent), 2) AS avg_efferent,
       round(avg(instability), 2) AS avg_instability, CAST(count(*) FILTER (WHERE instability > 0.8) AS BIGINT) AS high_instability,
       CAST(count(*) FILTER (WHERE instability < 0.2) AS BIGINT) AS low_instability
FROM g_cp2 GROUP BY file_id
"""))
def g14_coupling_report(spark, sf_dir):
    return G.coupling_report(_cp(_sub(spark, sf_dir)), ["file_id"])
