"""Per-function facts of lines and complexity metrics.

Line-based re-expression of the syntax-tree metrics: every statement line is assigned to
its function and to the count of enclosing control blocks; metrics are then plain
aggregates.  Known shape differences from a syntax tree: ``elif`` / ``else`` count as
siblings of their ``if`` (not nested in it), and one-line compound statements are one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import patterns as P
from lintlake.operators.structure import enclosing


def _occ(col, pattern: str):
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), 0))


def containment(stmts: DataFrame, blocks: DataFrame) -> DataFrame:
    """One containment pass per statement: innermost enclosing block and counts of enclosing blocks by kind.

    Blocks of one indent level never overlap, so counting the containing blocks of the
    wanted kinds among all containing blocks equals a pass over those kinds alone.
    """
    pts = stmts.select("file_id", "ln", "indent")
    spans = blocks.select("file_id", "ln", "ln_end", "indent", F.col("kind").alias("bkind"))
    k = F.col("b.bkind")
    return (
        enclosing(pts, spans)
        .groupBy("file_id", "ln")
        .agg(
            F.max_by("b", "d").alias("p"),
            F.count_if(k.isin(*P.NEST_KINDS)).alias("d_all"),
            F.count_if(k.isin(*P.COG_NEST_KINDS)).alias("d_cog"),
            F.count_if(k.isin(*P.LOOP_KINDS)).alias("d_loop"),
            F.count_if(k == "for").alias("d_for"),
            F.count_if(k == "with").alias("d_with"),
        )
        .select("file_id", "ln", F.col("p.ln").alias("parent_ln"), F.col("p.bkind").alias("parent_kind"),
                "d_all", "d_cog", "d_loop", "d_for", "d_with")
    )


def depths(stmts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts of enclosing control blocks of every statement (all kinds, without ``with``, loops, for, with)."""
    return containment(stmts, blocks).drop("parent_ln", "parent_kind")


def fn_stmts(stmts: DataFrame, blocks: DataFrame, functions: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """Statements of each function with nesting measured from the function header.

    Columns: statement columns + fn_ln, qualified_name, nest (all kinds), nest_cog, in_loop,
    in_for, in_with.
    """
    kinds = ("d_all", "d_cog", "d_loop", "d_for", "d_with")
    d = depth.select("file_id", "ln", *kinds) if depth is not None else depths(stmts, blocks)
    st = stmts.join(d, ["file_id", "ln"], "left").select(
        "*", *[F.coalesce(F.col(c), F.lit(0)).alias(c + "_") for c in kinds]
    ).drop(*kinds)
    fn = functions.select("file_id", F.col("ln_start").alias("ln"), "ln_end", "indent", "qualified_name")
    member = enclosing(st.select("file_id", "ln", "indent"), fn).select(
        "file_id", "ln", F.col("b.ln").alias("fn_ln"), F.col("b.qualified_name").alias("qualified_name"))
    heads = st.select("file_id", F.col("ln").alias("fn_ln"), F.col("d_all_").alias("h_all"),
                      F.col("d_cog_").alias("h_cog"), F.col("d_loop_").alias("h_loop"),
                      F.col("d_for_").alias("h_for"), F.col("d_with_").alias("h_with"))
    return (
        st.join(member, ["file_id", "ln"])
        .join(heads, ["file_id", "fn_ln"])
        .select(
            "*",
            (F.col("d_all_") - F.col("h_all")).alias("nest"),
            (F.col("d_cog_") - F.col("h_cog")).alias("nest_cog"),
            (F.col("d_loop_") - F.col("h_loop") > 0).alias("in_loop"),
            (F.col("d_for_") - F.col("h_for") > 0).alias("in_for"),
            (F.col("d_with_") - F.col("h_with") > 0).alias("in_with"),
        )
        .drop("d_all_", "d_cog_", "d_loop_", "d_for_", "d_with_", "h_all", "h_cog", "h_loop", "h_for", "h_with")
    )


def function_metrics(fst: DataFrame, functions: DataFrame) -> DataFrame:
    """M01, M03, M06 per function plus size: one row per function."""
    bare = F.coalesce(F.col("bare"), F.lit(""))
    code_line = F.col("kind") != "docstring"
    decisions = F.when(code_line, _occ(bare, P.DECISION_WORDS)).otherwise(0) + F.when(
        (F.col("kind") == "else") & F.col("prev_sibling_kind").isin("for", "while", "except"), 1).otherwise(0)
    comp = F.when(code_line, _occ(bare, P.COMPREHENSION) + _occ(bare, P.LAMBDA)).otherwise(0)
    cog = (
        F.when(F.col("kind").isin("if", "elif", "for", "while", "try"), 1 + F.col("nest_cog")).otherwise(0)
        + F.when(F.col("kind") == "except", 1).otherwise(0)
        + F.when(code_line, _occ(bare, P.COMPREHENSION)).otherwise(0) * (1 + F.col("nest_cog"))
        + F.when(F.col("kind") == "expr", _occ(bare, P.BOOL_WORDS)).otherwise(0)
    )
    node = F.when(F.col("kind").isin("if", "elif", "for", "while", "try", "with"), 1).otherwise(0)
    depth = F.when(node + F.when(comp > 0, 1).otherwise(0) > 0,
                   F.col("nest") + node + F.when(comp > 0, 1).otherwise(0)).otherwise(0)
    per = fst.select("file_id", "fn_ln", "ln", "kind", decisions.alias("dec"), cog.alias("cog"), depth.alias("depth"))
    agg = per.groupBy("file_id", "fn_ln").agg(
        (1 + F.sum("dec")).alias("cyclomatic"),
        F.sum("cog").alias("cognitive"),
        F.max("depth").alias("max_nesting"),
        F.min_by("ln", F.struct(-F.col("depth"), F.col("ln"))).alias("nesting_ln"),
        F.min_by("kind", F.struct(-F.col("depth"), F.col("ln"))).alias("nesting_kind"),
    )
    return functions.join(agg.withColumnRenamed("fn_ln", "ln_start"), ["file_id", "ln_start"], "left").select(
        "file_id", "name", "class_name", "qualified_name", "ln_start", "ln_end", "params", "return_type", "docstring",
        "doc_lines", (F.col("ln_end") - F.col("ln_start") + 1).alias("loc"),
        F.size("params").alias("n_params"),
        F.coalesce("cyclomatic", F.lit(1)).cast("bigint").alias("cyclomatic"),
        F.coalesce("cognitive", F.lit(0)).cast("bigint").alias("cognitive"),
        F.coalesce("max_nesting", F.lit(0)).cast("bigint").alias("max_nesting"),
        F.when(F.col("max_nesting") > 0, F.col("nesting_ln")).alias("nesting_ln"),
        F.when(F.col("max_nesting") > 0, F.col("nesting_kind")).alias("nesting_kind"),
    )


def halstead_mi(ln_df: DataFrame, file_cc: DataFrame) -> DataFrame:
    """Maintainability index per file from token counts (radon's published formula).

    Operands are names and numbers, operators are symbol runs and word operators, both
    read from string-free code of statement lines.
    """
    code = ln_df.filter("is_stmt").select("file_id", F.coalesce("bare", F.lit("")).alias("bare"))
    operand = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
    operator = r"[-+*/%=<>!&|^~@]+"
    toks = code.select(
        "file_id",
        F.explode(F.concat(
            F.transform(F.regexp_extract_all("bare", F.lit(operand), 0), lambda t: F.concat(F.lit("d:"), t)),
            F.transform(F.regexp_extract_all("bare", F.lit(operator), 0), lambda t: F.concat(F.lit("r:"), t)),
        )).alias("tok"),
    )
    h = toks.groupBy("file_id").agg(
        F.count_if(F.col("tok").startswith("r:")).alias("n_op"),
        F.count_if(F.col("tok").startswith("d:")).alias("n_od"),
        F.count_distinct(F.when(F.col("tok").startswith("r:"), F.col("tok"))).alias("u_op"),
        F.count_distinct(F.when(F.col("tok").startswith("d:"), F.col("tok"))).alias("u_od"),
    )
    raw = ln_df.groupBy("file_id").agg(
        F.count_if(F.col("is_content") & ~F.col("in_str")).alias("sloc"),
        F.count_if("is_comment").alias("comments"),
    )
    j = raw.join(h, "file_id", "left").join(file_cc, "file_id", "left")
    vocab = F.col("u_op") + F.col("u_od")
    volume = (F.col("n_op") + F.col("n_od")) * F.log2(vocab)
    comments_pct = F.when(F.col("sloc") > 0, F.col("comments") * 100.0 / F.col("sloc")).otherwise(0.0)
    nn = (171 - 5.2 * F.log(volume) - 0.23 * F.coalesce("cyclomatic_total", F.lit(0))
          - 16.2 * F.log(F.col("sloc")) + 50 * F.sin(F.sqrt(2.46 * F.radians(comments_pct))))
    mi = F.when((F.coalesce(volume, F.lit(0.0)) <= 0) | (F.col("sloc") <= 0), F.lit(100.0)).otherwise(
        F.least(F.greatest(F.lit(0.0), nn * 100 / 171.0), F.lit(100.0)))
    return j.select("file_id", F.round(mi, 4).alias("maintainability_index"), "sloc",
                    F.round(F.coalesce(volume, F.lit(0.0)), 4).alias("halstead_volume"))
