"""Function fact tables (X06-X16) and the one-row-per-function rollup ``facts``.

Every fact is a column expression over statement lines, aggregated per function with
``groupBy(file_id, fn_ln)``; the rollup is a chain of left joins on that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.operators.structure import enclosing

# Statement words that look like calls but are not.
NOT_CALLS = ["if", "elif", "while", "for", "return", "assert", "not", "and", "or", "in", "is", "with",
             "yield", "raise", "except", "lambda", "del", "await", "def", "class"]

EXCEPT_TYPE = r"^except\s+(.+?)(\s+as\s+[A-Za-z_][A-Za-z0-9_]*)?\s*:$"
RAISE_TYPE = r"^raise\s+([^(]+)"
NONE_CHECK = r"(^|[^A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)\s+is\s+(not\s+)?None"
TYPE_CHECK = r"^(if|elif)\s+isinstance\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*,"
COMMAND_FSTRING = r"(os\.system|subprocess\.call|subprocess\.run|subprocess\.Popen|os\.popen)\s*\(\s*f[\"']"


def parents(stmts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Innermost enclosing block of every statement: (file_id, ln, parent_ln, parent_kind)."""
    pts = stmts.select("file_id", "ln", "indent")
    spans = blocks.select("file_id", "ln", "ln_end", "indent", F.col("kind").alias("bkind"))
    return (
        enclosing(pts, spans)
        .groupBy("file_id", "ln")
        .agg(F.max_by("b", "d").alias("p"))
        .select("file_id", "ln", F.col("p.ln").alias("parent_ln"), F.col("p.bkind").alias("parent_kind"))
    )


def calls(fst: DataFrame) -> DataFrame:
    """X09 rows: every call of a function body with its line and position on the line."""
    c = fst.select(
        "file_id", "fn_ln", "qualified_name", "ln", "kind", "code",
        F.posexplode(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(P.CALL), 1)).alias("pos", "call"),
    )
    return c.filter(~F.col("call").isin(NOT_CALLS))


def ordered_calls(c: DataFrame) -> DataFrame:
    """De-duplicated call names per function in order of first appearance."""
    first = c.groupBy("file_id", "fn_ln", "call").agg(F.min(F.struct("ln", "pos")).alias("at"))
    return first.groupBy("file_id", "fn_ln").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "call"))), lambda x: x["call"]).alias("calls"))


def _sorted_set(col: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.collect_list(col), lambda x: x.isNotNull() & (x != ""))))


def facts(fst: DataFrame, functions_m: DataFrame, parent: DataFrame, imports: DataFrame) -> DataFrame:
    """One wide row per function (handlers, raises, calls, checks, flags, params)."""
    code = F.col("code")
    caught = F.when(F.col("kind") == "except", F.nullif(F.trim(F.regexp_extract(code, EXCEPT_TYPE, 1)), F.lit("")))
    raised = F.when(F.col("kind") == "raise", F.nullif(F.trim(F.regexp_extract(code, RAISE_TYPE, 1)), F.lit("")))
    none_vars = F.transform(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(NONE_CHECK), 2), lambda x: x)
    type_var = F.nullif(F.regexp_extract(code, TYPE_CHECK, 2), F.lit(""))
    st = fst if "parent_kind" in fst.columns else fst.join(parent, ["file_id", "ln"], "left")
    nxt_same = F.col("next_ln").isNotNull()
    per = st.select(
        "file_id", "fn_ln", "kind", "ln",
        ((F.col("kind") == "except") & code.rlike(r"^except\s*:")).alias("bare_except"),
        caught.alias("caught"), raised.alias("raised"), none_vars.alias("none_vars"), type_var.alias("type_var"),
        code.rlike(COMMAND_FSTRING).alias("cmd_fstring"),
        (F.col("kind").isin("return", "raise") & nxt_same
         & F.col("parent_kind").isin("if", "elif", "for", "while", "with", "try")).alias("ret_then_more"),
    )
    # The next statement must sit in the same body: same indent and still inside the parent block.
    nxt = fst.select("file_id", F.col("ln").alias("next_ln"), F.col("indent").alias("next_indent"))
    body = st.select("file_id", "ln", "next_ln", "indent", "parent_ln").join(nxt, ["file_id", "next_ln"], "left")
    unreachable_lines = body.filter(F.col("indent") == F.col("next_indent")).select("file_id", "ln").withColumn("same_body", F.lit(True))
    per = per.join(unreachable_lines, ["file_id", "ln"], "left")
    agg = per.groupBy("file_id", "fn_ln").agg(
        F.bool_or("bare_except").alias("has_bare_except"),
        F.bool_or(F.col("caught").isin("Exception", "BaseException")).alias("has_broad_except"),
        _sorted_set(F.col("caught")).alias("caught_types"),
        _sorted_set(F.col("raised")).alias("raise_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("none_vars")))).alias("has_none_checks"),
        _sorted_set(F.col("type_var")).alias("has_type_checks"),
        F.bool_or("cmd_fstring").alias("command_execution_has_fstring"),
        F.bool_or(F.col("kind") == "return").alias("has_return_on_all_paths"),
        F.bool_or(F.col("ret_then_more") & F.coalesce(F.col("same_body"), F.lit(False))).alias("has_unreachable_code"),
    )
    c = calls(fst)
    call_flags = c.groupBy("file_id", "fn_ln").agg(
        F.bool_or((F.col("call") == "open") & (F.col("kind") != "with")).alias("uses_open_without_with"),
        F.bool_or(F.col("call").isin(P.COMMAND_CALLS)).alias("uses_command_execution"),
    )
    star = imports.filter(F.col("name") == "*").select("file_id").distinct().withColumn("star", F.lit(True))
    builtins = F.array(*[F.lit(b) for b in P.BUILTINS])
    f = functions_m.withColumnRenamed("ln_start", "fn_ln")
    out = (
        f.join(agg, ["file_id", "fn_ln"], "left")
        .join(ordered_calls(c), ["file_id", "fn_ln"], "left")
        .join(call_flags, ["file_id", "fn_ln"], "left")
        .join(star, "file_id", "left")
    )
    pos_names = F.transform(F.filter("params", lambda p: ~p["name"].startswith("*")), lambda p: p["name"])
    empty = F.array().cast("array<string>")
    return out.select(
        "file_id", F.col("name").alias("function_name"), "qualified_name", "class_name",
        F.col("fn_ln").alias("line_start"), F.col("ln_end").alias("line_end"),
        F.col("class_name").isNotNull().alias("is_method"),
        "params", F.col("return_type").alias("return_annotation"), F.col("docstring").isNotNull().alias("has_docstring"),
        "docstring", F.col("cyclomatic").alias("cyclomatic_complexity"), "cognitive", "max_nesting", "loc",
        F.coalesce("has_bare_except", F.lit(False)).alias("has_bare_except"),
        F.coalesce("has_broad_except", F.lit(False)).alias("has_broad_except"),
        F.exists("params", lambda p: p["default_is_mutable"]).alias("has_mutable_default_args"),
        F.coalesce("uses_open_without_with", F.lit(False)).alias("uses_open_without_with"),
        F.coalesce("has_none_checks", empty).alias("has_none_checks"),
        F.coalesce("has_type_checks", empty).alias("has_type_checks"),
        F.coalesce("raise_types", empty).alias("raise_types"),
        F.coalesce("caught_types", empty).alias("caught_types"),
        F.coalesce("calls", empty).alias("calls"),
        F.coalesce("has_return_on_all_paths", F.lit(False)).alias("has_return_on_all_paths"),
        F.coalesce("has_unreachable_code", F.lit(False)).alias("has_unreachable_code"),
        F.filter(pos_names, lambda n: F.array_contains(builtins, n)).alias("shadows_builtin"),
        F.coalesce("star", F.lit(False)).alias("star_imports_used"),
        F.coalesce("uses_command_execution", F.lit(False)).alias("uses_command_execution"),
        F.coalesce("command_execution_has_fstring", F.lit(False)).alias("command_execution_has_fstring"),
    )


def used_names(stmts: DataFrame) -> DataFrame:
    """Distinct names used in a file (attribute bases included), import lines excluded."""
    st = stmts.filter(~F.col("kind").isin("import", "from"))
    return st.select(
        "file_id", F.explode(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(P.NAME_TOKEN), 0)).alias("name")
    ).distinct()
