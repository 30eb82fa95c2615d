"""Graph operators (G01-G14): import edges, resolution, closure, cycles, unused imports, class coupling.

Closure is an iterative frontier join: each round joins the new pairs to the edge list,
removes pairs already known with an anti join and cuts lineage by writing the round's
result into the session's checkpoint folder (computed once, re-read on executor loss).  It stops on an empty frontier.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.critics import ATTR_BASE, FREE_NAME
from lintlake.session import materialize

# Standard-library module names come from the running interpreter (a rule, not a copied list).
STDLIB = sorted(set(sys.stdlib_module_names))
TYPE_NAME = r"^(?:[A-Za-z_][A-Za-z0-9_]*\.)*([A-Za-z_][A-Za-z0-9_]*)"


def stdlib_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in STDLIB], "module string")


def module_of(path_col):
    """Dotted module name of a file path (``pkg1/m12.py`` -> ``pkg1.m12``)."""
    return F.regexp_replace(F.regexp_replace(path_col, r"(/__init__)?\.py$", ""), "/", ".")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct (src module, imported module) edges; empty targets dropped."""
    return imports.join(files.select("file_id", module_of(F.col("path")).alias("src")), "file_id").select(
        "src", F.col("module").alias("dst")).filter(F.col("dst") != "").distinct()


def resolve_imports(spark: SparkSession, files: DataFrame, imports: DataFrame) -> DataFrame:
    """Resolve each (file, module) to a corpus file.

    Candidates: same folder module, same folder package, then every parent folder from
    near to far; the first existing candidate wins.  Standard-library modules are removed
    first with a broadcast anti join (the list is bounded by the interpreter's module set).
    """
    mods = imports.select("file_id", "module").filter(F.col("module") != "").distinct()
    mods = mods.join(F.broadcast(stdlib_table(spark)), "module", "left_anti")
    src = files.select("file_id", F.col("path").alias("src_path"))
    m = mods.join(src, "file_id")
    parts = F.split(F.regexp_extract(F.col("src_path"), r"^(.*)/[^/]*$", 1), "/")
    depth = F.when(F.col("src_path").contains("/"), F.size(parts)).otherwise(F.lit(0))
    m = m.select("*", F.explode(F.sequence(depth, F.lit(0), F.lit(-1))).alias("k"))
    folder = F.when(F.col("k") == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.col("k")), "/"), F.lit("/")))
    cand = m.select(
        "file_id", "module", "src_path",
        F.explode(F.array(
            F.struct((2 * (depth - F.col("k"))).alias("prio"), F.concat(folder, F.col("module"), F.lit(".py")).alias("cand")),
            F.struct((2 * (depth - F.col("k")) + 1).alias("prio"), F.concat(folder, F.col("module"), F.lit("/__init__.py")).alias("cand")),
        )).alias("c"),
    ).select("file_id", "module", "src_path", "c.prio", "c.cand")
    hit = cand.join(files.select(F.col("path").alias("cand"), F.col("file_id").alias("dst_id")), "cand")
    best = hit.groupBy("file_id", "module", "src_path").agg(F.min_by(F.struct("cand", "dst_id"), "prio").alias("b"))
    return best.select("file_id", "module", "src_path", F.col("b.cand").alias("dst_path"), F.col("b.dst_id").alias("dst_id"))


def file_edges(resolved: DataFrame) -> DataFrame:
    return resolved.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) pairs with dst reachable from src in one or more steps.

    For the small import graphs of one code base; large graphs use ``linkgraph.reachable`` from seeds.
    """
    e = edges.select("src", "dst").distinct()
    reach = materialize(e, "reach")
    frontier = reach
    while True:
        step = frontier.alias("f").join(e.alias("e"), F.col("f.dst") == F.col("e.src")).select(
            F.col("f.src").alias("src"), F.col("e.dst").alias("dst")).distinct()
        new = materialize(step.join(reach, ["src", "dst"], "left_anti"), "frontier")
        if new.isEmpty():
            return reach
        reach = materialize(reach.unionByName(new), "reach")
        frontier = new


def with_self(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closure with the start node included (the reference's transitive set contains the start)."""
    return reach.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()


def cycles(reach: DataFrame) -> DataFrame:
    """Nodes on a cycle with their component (min node of the mutually reachable set)."""
    on_cycle = reach.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    mutual = reach.alias("a").join(reach.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).select(
        F.col("a.src").alias("node"), F.col("a.dst").alias("other"))
    comp = mutual.groupBy("node").agg(F.min("other").alias("m"), F.count(F.lit(1)).alias("size"))
    return on_cycle.join(comp, "node").select(
        "node", F.least(F.col("node"), F.col("m")).alias("component"), F.col("size").cast("bigint").alias("cycle_size"))


def used_free_names(stmts: DataFrame) -> DataFrame:
    """Names used in a file: free identifiers and attribute bases, import lines excluded."""
    st = stmts.filter(~F.col("kind").isin("import", "from"))
    return st.select("file_id", F.explode(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(FREE_NAME), 2)).alias("name")).distinct()


def unused_imports(imports: DataFrame, stmts: DataFrame) -> DataFrame:
    """An import is unused when none of its names, its alias or its module is used; ``*`` counts as used.

    ``import a, b`` gives one record per module; ``from m import x, y`` is one record
    whose names are all its items (the alias is the first item's alias).
    """
    used = used_free_names(stmts).withColumn("u", F.lit(True))
    rec = imports.groupBy("file_id", "ln", "module", "is_from").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "alias"))).alias("items"))
    rec = rec.select("file_id", "ln", "module", "is_from",
                     F.when(F.col("is_from"), F.array_sort(F.transform("items", lambda x: x["name"])))
                     .otherwise(F.array().cast("array<string>")).alias("names"),
                     F.col("items")[0]["alias"].alias("alias"))
    cand = rec.select("file_id", "ln", "module", F.explode(F.array_compact(F.concat(
        F.col("names"), F.array(F.col("alias")),
        F.when(F.size("names") == 0, F.array(F.col("module"))).otherwise(F.array().cast("array<string>"))))).alias("name"))
    hit = cand.join(used, ["file_id", "name"]).select("file_id", "ln", "module").distinct()
    star = rec.filter(F.array_contains("names", "*")).select("file_id", "ln", "module")
    return rec.join(hit.unionByName(star), ["file_id", "ln", "module"], "left_anti").select(
        "file_id", F.col("ln").cast("bigint").alias("ln"), "module", F.array_join("names", ",").alias("names"), "alias", "is_from")


# --- class coupling ---------------------------------------------------------------

def class_edges(classes: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Class -> class edges from bases, parameter / return types and ``Class.method()`` calls."""
    cls = classes.select("file_id", F.col("name").alias("dst"), F.col("ln_start").alias("dst_ln"))
    bases = classes.select("file_id", F.col("name").alias("src"), F.col("ln_start").alias("at"),
                           F.explode("bases").alias("t")).select("file_id", "src", "at", F.regexp_extract("t", TYPE_NAME, 1).alias("dst"))
    meth = functions.filter(F.col("class_name").isNotNull())
    ptypes = meth.select("file_id", F.col("class_name").alias("src"), F.col("ln_start").alias("at"),
                         F.explode(F.concat(F.transform("params", lambda p: p["type_hint"]), F.array("return_type"))).alias("t")).filter(
        F.col("t").isNotNull()).select("file_id", "src", "at", F.regexp_extract("t", TYPE_NAME, 1).alias("dst"))
    cl = calls.join(functions.select("file_id", F.col("ln_start").alias("fn_ln"), "class_name"), ["file_id", "fn_ln"]).filter(
        F.col("class_name").isNotNull() & F.col("call").contains("."))
    cedges = cl.select("file_id", F.col("class_name").alias("src"), F.col("ln").alias("at"),
                       F.substring_index("call", ".", 1).alias("dst")).filter(F.col("src") != F.col("dst"))
    e = bases.unionByName(ptypes).unionByName(cedges)
    # The target must be a class of the same file declared before the reference point.
    return e.join(cls, ["file_id", "dst"]).filter(F.col("dst_ln") <= F.col("at")).select("file_id", "src", "dst").distinct()


def class_accesses(classes: DataFrame, fst: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, source class, method, target class, accesses) for ``Target.attr`` inside methods."""
    meth = functions.filter(F.col("class_name").isNotNull()).select("file_id", F.col("ln_start").alias("fn_ln"), "class_name")
    acc = fst.join(meth, ["file_id", "fn_ln"]).select(
        "file_id", "fn_ln", "class_name", "ln", F.explode(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(ATTR_BASE), 2)).alias("obj"))
    cls = classes.select("file_id", F.col("name").alias("obj"), F.col("ln_start").alias("obj_ln"))
    ext = acc.join(cls, ["file_id", "obj"]).filter((F.col("obj_ln") <= F.col("ln")) & (F.col("obj") != F.col("class_name")))
    return ext.groupBy("file_id", "class_name", "fn_ln", "obj").agg(F.count(F.lit(1)).alias("n"))


def coupling(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Efferent / afferent coupling with their sets and instability Ce / (Ca + Ce)."""
    ce = edges.groupBy("file_id", F.col("src").alias("name")).agg(
        F.count_distinct("dst").alias("ce"), F.array_sort(F.collect_set("dst")).alias("dependencies"))
    ca = edges.filter(F.col("src") != F.col("dst")).groupBy("file_id", F.col("dst").alias("name")).agg(
        F.count_distinct("src").alias("ca"), F.array_sort(F.collect_set("src")).alias("dependents"))
    empty = F.array().cast("array<string>")
    out = classes.select("file_id", "name", F.size("methods").alias("n_methods")).join(ce, ["file_id", "name"], "left").join(
        ca, ["file_id", "name"], "left")
    ce_c, ca_c = F.coalesce("ce", F.lit(0)), F.coalesce("ca", F.lit(0))
    return out.select(
        "file_id", "name", "n_methods", ce_c.cast("bigint").alias("efferent"), ca_c.cast("bigint").alias("afferent"),
        F.when(ce_c + ca_c > 0, ce_c / (ce_c + ca_c)).otherwise(F.lit(0.0)).alias("instability"),
        F.coalesce("dependencies", empty).alias("dependencies"), F.coalesce("dependents", empty).alias("dependents"))


def god_classes(cp: DataFrame, coupling_t: int = 8, method_t: int = 5) -> DataFrame:
    """High efferent coupling or many methods; severity by 1x / 1.5x / 2x of the thresholds."""
    reasons = F.array_compact(F.array(
        F.when(F.col("efferent") >= coupling_t, F.format_string("high efferent coupling (%d dependencies)", F.col("efferent"))),
        F.when(F.col("n_methods") >= method_t, F.format_string("many methods (%d methods)", F.col("n_methods")))))
    sev = (F.when((F.col("efferent") >= 2 * coupling_t) | (F.col("n_methods") >= 2 * method_t), "critical")
           .when((F.col("efferent") >= 1.5 * coupling_t) | (F.col("n_methods") >= 1.5 * method_t), "high").otherwise("medium"))
    return cp.select("file_id", "name", "efferent", "n_methods", reasons.alias("reasons")).filter(F.size("reasons") > 0).select(
        "file_id", F.col("name").alias("class_name"), sev.alias("severity"), F.array_join("reasons", "; ").alias("reasons"),
        "efferent", F.col("n_methods").cast("bigint").alias("method_count"))


def feature_envy(acc: DataFrame, fst: DataFrame, functions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Methods whose external class accesses are at least ``threshold`` of their attribute accesses."""
    own = fst.select("file_id", "fn_ln", F.size(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(r"(^|[^A-Za-z0-9_.])self\."), 0)).alias("k")) \
        .groupBy("file_id", "fn_ln").agg(F.sum("k").alias("internal"))
    ext = acc.groupBy("file_id", "class_name", "fn_ln").agg(
        F.sum("n").alias("external"), F.max_by("obj", F.struct("n", F.col("obj"))).alias("envied_class"))
    j = ext.join(own, ["file_id", "fn_ln"], "left").join(
        functions.select("file_id", F.col("ln_start").alias("fn_ln"), F.col("name").alias("method_name")), ["file_id", "fn_ln"])
    ratio = F.col("external") / (F.col("external") + F.coalesce("internal", F.lit(0)))
    return j.select("file_id", "class_name", "method_name", "envied_class", F.round(ratio, 4).alias("ratio")).filter(
        F.col("ratio") >= threshold).withColumn("severity", F.when(F.col("ratio") >= 0.85, "high").otherwise("medium"))


def intimacy(edges: DataFrame, cp: DataFrame, threshold: int = 10) -> DataFrame:
    """Mutual class edges whose combined efferent coupling reaches the threshold (high at twice it)."""
    a, b = edges.alias("a"), edges.alias("b")
    mutual = a.join(b, (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))) \
        .select(F.col("a.file_id").alias("file_id"), F.col("a.src").alias("source"), F.col("a.dst").alias("target"))
    ce = cp.select("file_id", F.col("name").alias("k"), "efferent")
    j = mutual.join(ce.withColumnRenamed("k", "source").withColumnRenamed("efferent", "ce_s"), ["file_id", "source"]) \
        .join(ce.withColumnRenamed("k", "target").withColumnRenamed("efferent", "ce_t"), ["file_id", "target"])
    n = F.col("ce_s") + F.col("ce_t")
    return j.filter(n >= threshold).select("file_id", "source", "target", n.alias("access_count"),
                                          F.when(n >= 2 * threshold, "high").otherwise("medium").alias("severity"))


def coupling_report(cp: DataFrame, group_cols: list[str]) -> DataFrame:
    """Averages rounded to two places and counts of very unstable / very stable classes."""
    return cp.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total_classes"),
        F.round(F.avg("afferent"), 2).alias("avg_afferent"),
        F.round(F.avg("efferent"), 2).alias("avg_efferent"),
        F.round(F.avg("instability"), 2).alias("avg_instability"),
        F.count_if(F.col("instability") > 0.8).alias("high_instability"),
        F.count_if(F.col("instability") < 0.2).alias("low_instability"),
    )


def supplier_part_coupling(lineitem: DataFrame) -> DataFrame:
    """G10 at size: suppliers and parts as nodes, distinct (supplier -> part) pairs of ``lineitem`` as edges.

    One scan, one shuffle for the distinct edge set, one for the per-node degrees: each
    edge is exploded into its two endpoints with an out / in flag.
    """
    e = lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
                        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    ends = e.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    deg = ends.groupBy("node").agg(F.sum("o").alias("efferent"), F.sum("i").alias("afferent"))
    return deg.select("node", F.col("efferent").cast("bigint").alias("efferent"), F.col("afferent").cast("bigint").alias("afferent"),
                      F.round(F.col("efferent") / (F.col("efferent") + F.col("afferent")), 4).alias("instability"))
