"""Structure tables of a code corpus: lines, statements, blocks, functions, classes, imports.

Everything is keyed by ``file_id``.  The per-file windows run over one file's lines
(one input record), so their size is bounded by the largest single file.  Block ends
and containment use a linear "explode by indent level" pass instead of a per-file
inequality join, so a file with many headers costs lines x levels, not lines x headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import patterns as P

_PRE = Window.unboundedPreceding


def _count(col: Column, token: str) -> Column:
    """Occurrences of a literal token in a string column."""
    return F.floor((F.length(col) - F.length(F.replace(col, F.lit(token), F.lit("")))) / len(token))


def lines(files: DataFrame) -> DataFrame:
    """X01 substrate: one row per source line with layout and statement attributes."""
    content = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))
    base = files.select("file_id", F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    txt = F.replace(F.col("line"), F.lit("\t"), F.lit("    "))
    base = base.select(
        "file_id",
        (F.col("pos") + 1).alias("ln"),
        "line",
        (F.length(txt) - F.length(F.ltrim(txt))).alias("indent"),
        F.trim(txt).alias("s"),
        _count(F.col("line"), '"""').alias("q"),
    )
    w = Window.partitionBy("file_id").orderBy("ln")
    before = w.rowsBetween(_PRE, -1)
    base = base.withColumn("q_before", F.coalesce(F.sum("q").over(before), F.lit(0)))
    in_str = (F.col("q_before") % 2) == 1
    code = F.regexp_replace(F.col("s"), P.TRAILING_COMMENT, "")
    bare = F.regexp_replace(code, P.STRING_LITERAL, "")
    opens = F.length(bare) - F.length(F.translate(bare, "([{", ""))
    closes = F.length(bare) - F.length(F.translate(bare, ")]}", ""))
    is_blank = F.col("s") == ""
    is_comment = F.col("s").startswith("#")
    base = base.select(
        "*",
        in_str.alias("in_str"),
        is_blank.alias("is_blank"),
        (is_comment & ~in_str).alias("is_comment"),
        (~is_blank & (in_str | ~is_comment)).alias("is_content"),
        code.alias("code"),
        F.when(in_str | (F.col("q") > 0), F.lit(0)).otherwise(opens - closes).alias("bal"),
        F.when(in_str | (F.col("q") > 0), F.lit(None)).otherwise(bare).alias("bare"),
    )
    base = base.select(
        "*",
        (F.coalesce(F.sum("bal").over(before), F.lit(0)) > 0).alias("cont"),
        F.max(F.when(F.col("is_content"), F.col("ln"))).over(before).alias("prev_content"),
        F.max(F.when(F.col("is_content"), F.col("ln"))).over(Window.partitionBy("file_id")).alias("last_content"),
        F.when(in_str | (F.col("q") > 0), F.floor(F.col("q_before") / 2) + 1).alias("str_region"),
    )
    is_stmt = ~F.col("is_blank") & ~F.col("is_comment") & ~F.col("in_str") & ~F.col("cont")
    word = F.regexp_extract(F.col("code"), P.FIRST_WORD, 1)
    kind = (
        F.when(~is_stmt, F.lit(None))
        .when(F.col("code").startswith("@"), F.lit("decorator"))
        .when(F.col("code").startswith('"""'), F.lit("docstring"))
        .when(word == "async", F.regexp_extract(F.col("code"), P.ASYNC_WORD, 1))
        .when(word.isin(P.KEYWORD_KINDS), word)
        .when(F.col("code").rlike(P.AUG_ASSIGN), F.lit("augassign"))
        .when(F.col("code").rlike(P.ASSIGN), F.lit("assign"))
        .otherwise(F.lit("expr"))
    )
    return base.select(
        "file_id", "ln", "line", "indent", "s", "code", "bare", "q", "in_str", "str_region",
        "is_blank", "is_comment", "is_content", "cont", "prev_content", "last_content",
        is_stmt.alias("is_stmt"), kind.alias("kind"), (word == "async").alias("is_async"),
    )


def statements(ln_df: DataFrame) -> DataFrame:
    """Statement-start lines with the kind and line of the next statement of the file."""
    st = ln_df.filter("is_stmt").drop("is_stmt", "is_blank", "is_comment", "in_str", "cont")
    w = Window.partitionBy("file_id").orderBy("ln")
    return st.select(
        "*",
        F.lead("ln").over(w).alias("next_ln"),
        F.lead("kind").over(w).alias("next_kind"),
        F.lead("str_region").over(w).alias("next_region"),
        F.lead("code").over(w).alias("next_code"),
        F.lag("kind").over(Window.partitionBy("file_id", "indent").orderBy("ln")).alias("prev_sibling_kind"),
    )


def blocks(st: DataFrame) -> DataFrame:
    """Block headers with the last line of their body.

    A header's block stops before the next statement of the file whose indent is not
    greater.  Each statement is copied once per header indent level at or above its own
    indent; within (file, level) the stop is then simply the next row.
    """
    heads = st.filter(F.col("kind").isin(P.HEADER_KINDS))
    levels = heads.groupBy("file_id").agg(F.collect_set("indent").alias("lv"))
    x = st.join(levels, "file_id").select(
        "*", F.explode(F.filter("lv", lambda d: d >= F.col("indent"))).alias("d")
    ).drop("lv")
    w = Window.partitionBy("file_id", "d").orderBy("ln")
    x = x.select("*", F.lead("prev_content").over(w).alias("stop_prev"))
    x = x.filter((F.col("d") == F.col("indent")) & F.col("kind").isin(P.HEADER_KINDS))
    return x.select(
        "file_id", "ln", "indent", "kind", "code", "is_async", "next_ln", "next_kind", "next_region",
        "prev_sibling_kind",
        F.coalesce(F.col("stop_prev"), F.col("last_content")).alias("ln_end"),
    )


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Containment of points in blocks, without a per-file inequality join.

    ``points``: file_id, ln, indent, ...; ``spans``: file_id, ln, ln_end, indent + payload.
    Returns one row per (point, containing span) with the span as struct ``b`` and its
    indent level ``d``.  Blocks of one indent level never overlap, so the containing
    span at a level is the latest one that starts before the point.
    """
    levels = spans.groupBy("file_id").agg(F.collect_set("indent").alias("lv"))
    pcols = [c for c in points.columns]
    payload = [c for c in spans.columns if c not in ("file_id",)]
    p = points.join(levels, "file_id").select(
        *pcols, F.explode(F.filter("lv", lambda d: d < F.col("indent"))).alias("d")
    )
    p = p.select(*pcols, "d", F.lit(None).cast(spans.select(F.struct(*payload)).schema[0].dataType).alias("b"),
                 F.lit(True).alias("is_point"))
    s = spans.select("file_id", F.col("ln"), F.col("indent").alias("d"), F.struct(*payload).alias("b"))
    for c in pcols:
        if c not in ("file_id", "ln"):
            s = s.withColumn(c, F.lit(None).cast(points.schema[c].dataType))
    s = s.withColumn("is_point", F.lit(False)).select(*pcols, "d", "b", "is_point")
    u = p.unionByName(s)
    w = Window.partitionBy("file_id", "d").orderBy("ln", "is_point").rowsBetween(_PRE, 0)
    u = u.withColumn("b", F.last("b", ignorenulls=True).over(w))
    return u.filter(F.col("is_point") & F.col("b").isNotNull() & (F.col("b.ln_end") >= F.col("ln"))).drop("is_point")


def owner(lines_df: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines inside non-overlapping spans (file_id, ln, ln_end + payload) with the span as ``o``.

    Spans of one file must not overlap (top-level functions and methods never do), so
    the owner of a line is the latest span that starts at or before it: one running
    window per file instead of a range join.
    """
    payload = [c for c in spans.columns if c != "file_id"]
    st = spans.select("file_id", F.col("ln"), F.struct(*payload).alias("o"), F.lit(0).alias("is_line"))
    ln = lines_df.select("file_id", "ln", F.lit(None).cast(st.schema["o"].dataType).alias("o"), F.lit(1).alias("is_line"))
    w = Window.partitionBy("file_id").orderBy("ln", "is_line").rowsBetween(_PRE, 0)
    u = st.unionByName(ln).withColumn("o", F.last("o", ignorenulls=True).over(w))
    keep = u.filter((F.col("is_line") == 1) & F.col("o").isNotNull() & (F.col("ln") <= F.col("o.ln_end")))
    return keep.select("file_id", "ln", "o").join(lines_df, ["file_id", "ln"])


def _split_top(col: Column) -> Column:
    """Split a parameter list on commas that are not inside brackets."""
    return F.split(col, r",(?![^\[({]*[\])}])")


def definitions(st: DataFrame, blk: DataFrame) -> DataFrame:
    """All def and class headers with their innermost enclosing def/class (if any)."""
    defs = blk.filter(F.col("kind").isin("def", "class")).select(
        "file_id", "ln", "ln_end", "indent", "kind",
        F.when(F.col("kind") == "def", F.regexp_extract("code", P.DEF_NAME, 2))
        .otherwise(F.regexp_extract("code", P.CLASS_NAME, 1)).alias("name"),
    )
    inner = (
        enclosing(defs.select("file_id", "ln", "indent"), defs)
        .groupBy("file_id", "ln")
        .agg(
            F.max_by("b", "d").alias("parent"),
            F.max(F.when(F.col("b.kind") == "def", F.lit(1)).otherwise(F.lit(0))).alias("in_def"),
        )
    )
    return blk.filter(F.col("kind").isin("def", "class")).join(defs.select("file_id", "ln", "name"), ["file_id", "ln"]) \
        .join(inner, ["file_id", "ln"], "left")


def docstrings(ln_df: DataFrame) -> DataFrame:
    """Text of every triple-quoted region keyed by (file_id, str_region)."""
    g = ln_df.filter(F.col("str_region").isNotNull()).groupBy("file_id", "str_region").agg(
        F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("parts"),
        F.min("ln").alias("doc_start"), F.max("ln").alias("doc_end"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r'^\s*"""', ""), r'"""\s*$', ""))
    return g.select("file_id", "str_region", "doc_start", "doc_end", text.alias("docstring"))


def functions(ln_df: DataFrame, st: DataFrame, blk: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """Functions not nested in another function (module functions and methods)."""
    defs = defs if defs is not None else definitions(st, blk)
    f = defs.filter((F.col("kind") == "def") & (F.coalesce(F.col("in_def"), F.lit(0)) == 0))
    params_txt = F.regexp_extract("code", P.DEF_PARAMS, 1)
    raw = F.filter(F.transform(_split_top(params_txt), lambda p: F.trim(p)), lambda p: p != "")
    params = F.transform(
        raw,
        lambda p: F.struct(
            F.regexp_extract(p, P.PARAM_NAME, 1).alias("name"),
            F.nullif(F.trim(F.regexp_extract(p, P.PARAM_HINT, 1)), F.lit("")).alias("type_hint"),
            p.contains("=").alias("has_default"),
            p.rlike(P.MUTABLE_DEFAULT).alias("default_is_mutable"),
        ),
    )
    cls = F.when(F.col("parent.kind") == "class", F.col("parent.name"))
    f = f.select(
        "file_id", "name", cls.alias("class_name"),
        F.when(cls.isNotNull(), F.concat_ws(".", cls, F.col("name"))).otherwise(F.col("name")).alias("qualified_name"),
        F.col("ln").alias("ln_start"), "ln_end", "indent", "is_async", "code",
        F.filter(params, lambda p: (p["name"] != "") & (p["name"] != "*")).alias("params"),
        F.nullif(F.trim(F.regexp_extract("code", P.DEF_RETURN, 1)), F.lit("")).alias("return_type"),
        F.when(F.col("next_kind") == "docstring", F.col("next_region")).alias("doc_region"),
    )
    docs = docstrings(ln_df).select("file_id", F.col("str_region").alias("doc_region"), "docstring",
                                    (F.col("doc_end") - F.col("doc_start") + 1).alias("doc_lines"))
    return f.join(docs, ["file_id", "doc_region"], "left")


def classes(ln_df: DataFrame, st: DataFrame, blk: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """Classes (nested ones kept) with direct methods, bases and docstring."""
    defs = defs if defs is not None else definitions(st, blk)
    c = defs.filter(F.col("kind") == "class")
    methods = (
        defs.filter((F.col("kind") == "def") & (F.col("parent.kind") == "class"))
        .groupBy("file_id", F.col("parent.ln").alias("ln"))
        .agg(F.array_sort(F.collect_list(F.struct("ln", "name"))).alias("m"))
        .select("file_id", "ln", F.transform("m", lambda x: x["name"]).alias("methods"))
    )
    bases_txt = F.regexp_extract("code", P.CLASS_BASES, 1)
    bases = F.filter(F.transform(_split_top(bases_txt), lambda b: F.trim(b)), lambda b: b != "")
    docs = docstrings(ln_df).select("file_id", F.col("str_region").alias("doc_region"), "docstring")
    out = c.select(
        "file_id", "name", F.col("ln").alias("ln_start"), "ln_end", "indent",
        bases.alias("bases"),
        F.when(F.col("next_kind") == "docstring", F.col("next_region")).alias("doc_region"),
    ).join(methods.withColumnRenamed("ln", "ln_start"), ["file_id", "ln_start"], "left")
    out = out.withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
    return out.join(docs, ["file_id", "doc_region"], "left").drop("doc_region")


def imports(st: DataFrame) -> DataFrame:
    """One row per imported item: module, name, alias, line, from-flag."""
    imp = st.filter(F.col("kind") == "import").select(
        "file_id", "ln", F.posexplode(F.split(F.regexp_extract("code", P.IMPORT_LINE, 1), ",")).alias("pos", "item")
    ).select(
        "file_id", "ln", "pos",
        F.regexp_extract(F.trim("item"), r"^([A-Za-z0-9_.]+)", 1).alias("module"),
        F.regexp_extract(F.trim("item"), r"^([A-Za-z0-9_.]+)", 1).alias("name"),
        F.nullif(F.regexp_extract("item", r"\sas\s+([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit("")).alias("alias"),
        F.lit(False).alias("is_from"),
    )
    frm = st.filter((F.col("kind") == "from") & F.col("code").rlike(P.FROM_LINE)).select(
        "file_id", "ln",
        F.regexp_extract("code", P.FROM_LINE, 1).alias("module"),
        F.posexplode(F.split(F.regexp_extract("code", P.FROM_LINE, 2), ",")).alias("pos", "item"),
    ).select(
        "file_id", "ln", "pos", "module",
        F.regexp_extract(F.trim("item"), r"^([A-Za-z0-9_*]+)", 1).alias("name"),
        F.nullif(F.regexp_extract("item", r"\sas\s+([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit("")).alias("alias"),
        F.lit(True).alias("is_from"),
    )
    return imp.unionByName(frm)
