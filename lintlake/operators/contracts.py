"""Contracts and invariants (C01-C18) from docstring lines, asserts, raises and class members.

Docstring sections are a window over the docstring's lines: every line takes the last
heading above it (``last(..., ignorenulls)``); a heading is a capitalised word followed
by a colon and nothing else, so an unknown heading closes the open section while
``Name: text`` entries stay inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Recognised docstring headings.
SECTIONS = {"Args:": "args", "Arguments:": "args", "Returns:": "returns", "Raises:": "raises",
            "Precondition:": "pre", "Preconditions:": "pre", "Postcondition:": "post", "Postconditions:": "post"}
# Inline tags and the contract part they feed.
TAGS = [("precondition", "pre"), ("postcondition", "post"), ("raises", "raises"), ("requires", "pre"), ("ensures", "post")]
GENERIC_EXCEPTIONS = ["Exception", "BaseException"]
HEADING = r"^[A-Z][A-Za-z ]*:$"
RAISE_NAME = r"^raise\s+([A-Za-z_][A-Za-z0-9_.]*)"


def doc_lines(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """Docstring lines of every function with their section: (file_id, fn_ln, ln, text, section)."""
    f = functions.filter(F.col("doc_region").isNotNull()).select("file_id", F.col("ln_start").alias("fn_ln"),
                                                                 F.col("doc_region").alias("str_region"))
    st = lines.filter(F.col("str_region").isNotNull()).select("file_id", "ln", "line", "str_region")
    dl = st.join(f, ["file_id", "str_region"])
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("line"), '"""', ""), r"^\s+|\s+$", ""))
    dl = dl.select("file_id", "fn_ln", "ln", text.alias("text"))
    head = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.lit(v))])
    marker = F.when(F.col("text").rlike(HEADING), F.coalesce(head[F.col("text")], F.lit("none")))
    w = Window.partitionBy("file_id", "fn_ln").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    dl = dl.withColumn("marker", marker).withColumn("section", F.last("marker", ignorenulls=True).over(w))
    return dl


def contract_items(lines: DataFrame, functions: DataFrame, fst: DataFrame) -> DataFrame:
    """C01-C04 as rows: (file_id, fn_ln, part, item, source)."""
    dl = doc_lines(lines, functions)
    body = dl.filter(F.col("marker").isNull() & (F.col("text") != "") & F.col("section").isin("pre", "post", "raises"))
    sec_item = F.when(F.col("section") == "raises",
                      F.when(F.col("text").rlike(r"^(\w+):"), F.regexp_extract("text", r"^(\w+):", 1))
                      .otherwise(F.split("text", r"\s+")[0])).otherwise(F.col("text"))
    sec = body.select("file_id", "fn_ln", F.col("section").alias("part"), sec_item.alias("item"), F.lit("docstring").alias("source"))
    low = F.lower("text")
    tag_part = F.lit(None).cast("string")
    tag_item = F.lit(None).cast("string")
    for tag, part in reversed(TAGS):
        pat = rf"(?i):{tag}:\s*(\w+)" if tag == "raises" else rf"(?i):{tag}:\s*(.+)"
        hit = low.contains(f":{tag}:")
        tag_part = F.when(hit, F.lit(part)).otherwise(tag_part)
        tag_item = F.when(hit, F.trim(F.regexp_extract("text", pat, 1))).otherwise(tag_item)
    tags = dl.select("file_id", "fn_ln", tag_part.alias("part"), tag_item.alias("item"), F.lit("tag").alias("source")).filter(
        F.col("part").isNotNull() & (F.col("item") != ""))
    asserts = fst.filter(F.col("kind") == "assert").select(
        "file_id", "fn_ln", F.lit("pre").alias("part"), F.trim(F.regexp_extract("code", r"^assert\s+(.*)$", 1)).alias("item"),
        F.lit("assert").alias("source"))
    raised = fst.filter(F.col("kind") == "raise").select(
        "file_id", "fn_ln", F.lit("raises_in_code").alias("part"), F.regexp_extract("code", RAISE_NAME, 1).alias("item"),
        F.lit("code").alias("source")).filter(F.col("item") != "")
    return sec.unionByName(tags).unionByName(asserts).unionByName(raised)


def contract_table(functions: DataFrame, items: DataFrame) -> DataFrame:
    """One contract row per function: types, pre/post conditions, documented and raised exceptions."""
    g = items.groupBy("file_id", "fn_ln").agg(
        *[F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("part") == p, F.col("item"))))).alias(p)
          for p in ("pre", "post", "raises", "raises_in_code")],
        F.count_if(F.col("source") != "assert").alias("n_documented"))
    types = functions.select("file_id", F.col("ln_start").alias("fn_ln"), "name", "qualified_name", "return_type",
                             F.map_from_entries(F.transform(F.filter("params", lambda p: p["type_hint"].isNotNull()),
                                                            lambda p: F.struct(p["name"], p["type_hint"]))).alias("requires_types"))
    empty = F.array().cast("array<string>")
    out = types.join(g, ["file_id", "fn_ln"], "left")
    return out.select("file_id", "fn_ln", "name", "qualified_name", "return_type", "requires_types",
                      *[F.coalesce(p, empty).alias(p) for p in ("pre", "post", "raises", "raises_in_code")])


def violations(contracts: DataFrame, items: DataFrame, fst: DataFrame) -> DataFrame:
    """Undocumented raise, documented-but-not-raised, complex without contract, asserts undocumented."""
    ex = contracts.select("file_id", "fn_ln", "name", F.explode(F.array_except(
        F.array_except("raises_in_code", F.array(*[F.lit(e) for e in GENERIC_EXCEPTIONS])), "raises")).alias("exc"))
    c06 = ex.select("file_id", "fn_ln", "name", F.lit("undocumented_raise").alias("violation_type"), "exc", F.lit("low").alias("severity"))
    nr = contracts.select("file_id", "fn_ln", "name", F.explode(F.array_except("raises", "raises_in_code")).alias("exc"))
    c07 = nr.select("file_id", "fn_ln", "name", F.lit("unreachable_raise").alias("violation_type"), "exc", F.lit("low").alias("severity"))
    br = fst.groupBy("file_id", "fn_ln").agg(
        F.count_if(F.col("kind").isin("if", "elif", "for", "while", "try")).alias("branches"),
        F.count_if(F.col("kind") == "assert").alias("asserts"))
    documented_pre = items.filter((F.col("part") == "pre") & (F.col("source") != "assert")).select("file_id", "fn_ln").distinct() \
        .withColumn("doc_pre", F.lit(True))
    j = contracts.join(br, ["file_id", "fn_ln"], "left").join(documented_pre, ["file_id", "fn_ln"], "left")
    c08 = j.filter((F.coalesce("branches", F.lit(0)) > 3) & (F.size("pre") == 0) & (F.size("post") == 0)).select(
        "file_id", "fn_ln", "name", F.lit("missing_contract").alias("violation_type"), F.lit(None).cast("string").alias("exc"),
        F.lit("medium").alias("severity"))
    c09 = j.filter((F.coalesce("asserts", F.lit(0)) > 0) & F.col("doc_pre").isNull()).select(
        "file_id", "fn_ln", "name", F.lit("undocumented_precondition").alias("violation_type"), F.lit(None).cast("string").alias("exc"),
        F.lit("low").alias("severity"))
    return c06.unionByName(c07).unionByName(c08).unionByName(c09)


def assert_positions(fst: DataFrame) -> DataFrame:
    """C11: leading asserts (first five body statements) are preconditions, trailing ones (last five, returns skipped) postconditions."""
    top = fst.filter(F.col("parent_ln") == F.col("fn_ln")).select("file_id", "fn_ln", "ln", "kind", "code")
    wa = Window.partitionBy("file_id", "fn_ln").orderBy("ln")
    wd = Window.partitionBy("file_id", "fn_ln").orderBy(F.col("ln").desc())
    is_a = (F.col("kind") == "assert").cast("int")
    t = top.select("*", F.row_number().over(wa).alias("ra"), F.row_number().over(wd).alias("rd"),
                   F.min(is_a).over(wa.rowsBetween(Window.unboundedPreceding, 0)).alias("run_a"),
                   F.min(F.when(F.col("kind") == "return", 1).otherwise(is_a)).over(wd.rowsBetween(Window.unboundedPreceding, 0)).alias("run_d"))
    cond = F.trim(F.regexp_extract("code", r"^assert\s+(.*)$", 1))
    pre = t.filter((F.col("ra") <= 5) & (F.col("run_a") == 1)).select("file_id", "fn_ln", "ln", F.lit("precondition").alias("role"), cond.alias("condition"))
    post = t.filter((F.col("rd") <= 5) & (F.col("run_d") == 1) & (F.col("kind") == "assert")).select(
        "file_id", "fn_ln", "ln", F.lit("postcondition").alias("role"), cond.alias("condition"))
    return pre.unionByName(post)


def loop_facts(fst: DataFrame, blocks: DataFrame) -> DataFrame:
    """C14: loop variable of every for loop, accumulators (+= / *=) inside it, bounded while loops."""
    from lintlake.operators.structure import enclosing
    loops = fst.filter(F.col("kind").isin("for", "while")).select(
        "file_id", "fn_ln", "ln", "kind", F.regexp_extract("code", r"^for\s+([A-Za-z_][A-Za-z0-9_]*)", 1).alias("loop_var"),
        ((F.col("kind") == "while") & F.col("code").contains("<")).alias("bounded"))
    acc = fst.filter(F.col("kind") == "augassign").filter(F.col("code").rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\s*(\+|\*)=")).select(
        "file_id", "ln", "indent", F.regexp_extract("code", r"^([A-Za-z_][A-Za-z0-9_.]*)", 1).alias("acc"))
    spans = blocks.filter(F.col("kind") == "for").select("file_id", "ln", "ln_end", "indent")
    inside = enclosing(acc, spans).groupBy("file_id", F.col("b.ln").alias("ln")).agg(
        F.array_join(F.array_sort(F.collect_set("acc")), ",").alias("accumulators"))
    return loops.join(inside, ["file_id", "ln"], "left").select(
        "file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), F.col("ln").cast("bigint").alias("ln"), "kind", "loop_var", F.coalesce("accumulators", F.lit("")).alias("accumulators"),
        "bounded")


def class_invariants(fst: DataFrame, functions: DataFrame) -> DataFrame:
    """Asserts on ``self.`` attributes inside ``__init__`` (direct body) are class invariants."""
    init = functions.filter((F.col("name") == "__init__") & F.col("class_name").isNotNull()).select(
        "file_id", F.col("ln_start").alias("fn_ln"), "class_name")
    a = fst.filter((F.col("kind") == "assert") & (F.col("parent_ln") == F.col("fn_ln"))).join(init, ["file_id", "fn_ln"])
    cond = F.trim(F.regexp_extract("code", r"^assert\s+(.*)$", 1))
    return a.filter(cond.contains("self.")).select("file_id", "class_name", F.col("ln").cast("bigint").alias("ln"), cond.alias("invariant"))


def preservation(inv: DataFrame, fst: DataFrame, functions: DataFrame) -> DataFrame:
    """C17: in classes with invariants, methods other than __init__ that assign ``self.`` attributes without any assert."""
    meth = functions.filter(F.col("class_name").isNotNull() & (F.col("name") != "__init__")).select(
        "file_id", F.col("ln_start").alias("fn_ln"), "class_name", F.col("name").alias("method"))
    meth = meth.join(inv.select("file_id", "class_name").distinct(), ["file_id", "class_name"], "left_semi")
    g = fst.groupBy("file_id", "fn_ln").agg(
        F.count_if(F.col("kind").isin("assign", "augassign") & F.col("code").rlike(r"^self\.")).alias("assigns"),
        F.count_if(F.col("kind") == "assert").alias("asserts"))
    return meth.join(g, ["file_id", "fn_ln"]).filter((F.col("assigns") > 0) & (F.col("asserts") == 0)).select(
        "file_id", "class_name", "method", F.lit("invariant_not_checked").alias("violation_type"), F.lit("medium").alias("severity"))


def data_structures(classes: DataFrame) -> DataFrame:
    """Stack / queue / tree / container classes from their method names."""
    m = F.col("methods")
    has = lambda x: F.array_contains(m, x)
    kind = (F.when(has("push") & has("pop"), "stack")
            .when((has("enqueue") & has("dequeue")) | (has("put") & has("get")), "queue")
            .when(F.arrays_overlap(m, F.array(F.lit("insert"), F.lit("traverse"), F.lit("search"))) & F.col("name").rlike("Tree|Node"), "tree")
            .when(F.arrays_overlap(m, F.array(F.lit("__len__"), F.lit("__contains__"), F.lit("__iter__"))), "container"))
    return classes.select("file_id", "name", kind.alias("structure")).filter(F.col("structure").isNotNull())
