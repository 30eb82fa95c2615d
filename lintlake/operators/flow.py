"""Control-flow edge table (X21): the flow graph of every function as rows, not objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.structure import enclosing

BRANCH_KINDS = ["if", "elif", "else", "for", "while", "try", "except", "finally", "with"]


def cfg_edges(fst: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges (file_id, fn_ln, src, dst, kind); ``dst = 0`` is the function exit.

    sequence: next statement with the same parent; enter: block header -> first body
    statement; back: last statement of a loop body -> loop header; exit: return / raise;
    break / continue -> innermost enclosing loop header.
    """
    st = fst.filter(F.col("kind") != "docstring").select("file_id", "fn_ln", "ln", "indent", "kind", "parent_ln")
    w = Window.partitionBy("file_id", "fn_ln", "parent_ln").orderBy("ln")
    seq = st.select("file_id", "fn_ln", F.col("ln").alias("src"), F.lead("ln").over(w).alias("dst"), F.lit("sequence").alias("kind"),
                    F.col("kind").alias("k0"))
    seq = seq.filter(F.col("dst").isNotNull() & ~F.col("k0").isin("return", "raise", "break", "continue")).drop("k0")
    first_child = st.groupBy("file_id", "fn_ln", "parent_ln").agg(F.min("ln").alias("dst"))
    enter = st.filter(F.col("kind").isin(*BRANCH_KINDS)).join(
        first_child.withColumnRenamed("parent_ln", "ln"), ["file_id", "fn_ln", "ln"]).select(
        "file_id", "fn_ln", F.col("ln").alias("src"), "dst", F.lit("enter").alias("kind"))
    last_child = st.groupBy("file_id", "fn_ln", "parent_ln").agg(F.max("ln").alias("src"))
    back = st.filter(F.col("kind").isin("for", "while")).join(
        last_child.withColumnRenamed("parent_ln", "ln"), ["file_id", "fn_ln", "ln"]).select(
        "file_id", "fn_ln", "src", F.col("ln").alias("dst"), F.lit("back").alias("kind"))
    exits = st.filter(F.col("kind").isin("return", "raise")).select(
        "file_id", "fn_ln", F.col("ln").alias("src"), F.lit(0).alias("dst"), F.lit("exit").alias("kind"))
    loops = blocks.filter(F.col("kind").isin("for", "while")).select("file_id", "ln", "ln_end", "indent")
    jumps = st.filter(F.col("kind").isin("break", "continue")).select("file_id", "ln", "indent", "fn_ln", "kind")
    jl = enclosing(jumps, loops).groupBy("file_id", "fn_ln", "ln", "kind").agg(F.max_by("b.ln", "d").alias("dst"))
    jumps_e = jl.select("file_id", "fn_ln", F.col("ln").alias("src"), "dst", "kind")
    out = seq.unionByName(enter).unionByName(back).unionByName(exits).unionByName(jumps_e).distinct()
    return out.select("file_id", F.col("fn_ln").cast("bigint").alias("fn_ln"), F.col("src").cast("bigint").alias("src"),
                      F.col("dst").cast("bigint").alias("dst"), "kind")
