"""Queries over the structure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import structure as S
from lintlake.plans.catalog import code_query, query
from lintlake.plans.oracle import with_base
from lintlake.plans.substrate import for_corpus
from lintlake.sources import corpus


@query("s03_exact_duplicates", """
SELECT sha256(text) AS content_hash, count(*) AS n_files, min(CAST(doc_id AS VARCHAR)) AS first_path
FROM documents GROUP BY sha256(text)
""")
def s03_exact_duplicates(spark, sf_dir):
    """S03 at size: exact-duplicate documents by content hash."""
    docs = corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), F.col("doc_id").cast("string").alias("path"))
    return corpus.exact_duplicates(docs)


@code_query("x01_line_counts", with_base("""
SELECT file_id, CAST(count(*) AS BIGINT) AS total_lines,
       CAST(count(*) FILTER (WHERE is_content) AS BIGINT) AS loc,
       CAST(count(*) FILTER (WHERE is_blank) AS BIGINT) AS blank_lines,
       CAST(count(*) FILTER (WHERE is_comment) AS BIGINT) AS comment_lines
FROM lines GROUP BY file_id
"""))
def x01_line_counts(spark, sf_dir):
    ln = for_corpus(spark, sf_dir).lines
    return ln.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if("is_content").alias("loc"),
        F.count_if("is_blank").alias("blank_lines"),
        F.count_if("is_comment").alias("comment_lines"),
    )


@code_query("x02_functions", with_base("""
SELECT file_id, qualified_name, CAST(ln_start AS BIGINT) AS ln_start, CAST(ln_end AS BIGINT) AS ln_end,
       CAST((SELECT count(*) FROM params p WHERE p.file_id = f.file_id AND p.ln_start = f.ln_start) AS BIGINT) AS n_params,
       return_type, docstring IS NOT NULL AS has_docstring
FROM functions f
"""))
def x02_functions(spark, sf_dir):
    fn = for_corpus(spark, sf_dir).functions
    return fn.select(
        "file_id", "qualified_name",
        F.col("ln_start").cast("bigint").alias("ln_start"), F.col("ln_end").cast("bigint").alias("ln_end"),
        F.size("params").cast("bigint").alias("n_params"), "return_type",
        F.col("docstring").isNotNull().alias("has_docstring"),
    )


@code_query("x03_classes", with_base("""
SELECT file_id, name, CAST(ln_start AS BIGINT) AS ln_start, CAST(ln_end AS BIGINT) AS ln_end,
       CAST(n_methods AS BIGINT) AS n_methods, bases_txt AS bases, docstring IS NOT NULL AS has_docstring
FROM classes
"""))
def x03_classes(spark, sf_dir):
    cl = for_corpus(spark, sf_dir).classes
    return cl.select(
        "file_id", "name",
        F.col("ln_start").cast("bigint").alias("ln_start"), F.col("ln_end").cast("bigint").alias("ln_end"),
        F.size("methods").cast("bigint").alias("n_methods"),
        F.array_join("bases", ", ").alias("bases"),
        F.col("docstring").isNotNull().alias("has_docstring"),
    )


@code_query("x04_imports", with_base("""
SELECT file_id, CAST(ln AS BIGINT) AS ln, module, name, alias, is_from FROM imports
"""))
def x04_imports(spark, sf_dir):
    im = for_corpus(spark, sf_dir).imports
    return im.select("file_id", F.col("ln").cast("bigint").alias("ln"), "module", "name", "alias", "is_from")


@code_query("x05_statement_kinds", with_base("""
SELECT kind, parent_kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT s.kind, coalesce((SELECT b.kind FROM blocks b WHERE b.file_id = s.file_id AND b.ln < s.ln
                                AND b.ln_end >= s.ln AND b.indent < s.indent ORDER BY b.ln DESC LIMIT 1), 'module') AS parent_kind
  FROM stmts s)
GROUP BY kind, parent_kind
"""))
def x05_statement_kinds(spark, sf_dir):
    """Statements counted by kind and the kind of their innermost enclosing block."""
    sub = for_corpus(spark, sf_dir)
    pts = sub.stmts.select("file_id", "ln", "indent", "kind")
    spans = sub.blocks.select("file_id", "ln", "ln_end", "indent", F.col("kind").alias("bkind"))
    parent = (
        S.enclosing(pts, spans)
        .groupBy("file_id", "ln")
        .agg(F.max_by("b.bkind", "d").alias("parent_kind"))
    )
    return (
        pts.join(parent, ["file_id", "ln"], "left")
        .groupBy("kind", F.coalesce("parent_kind", F.lit("module")).alias("parent_kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
