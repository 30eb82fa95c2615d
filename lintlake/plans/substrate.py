"""Shared fact tables of one corpus, built once and reused by every query.

The substrate tables are written as parquet under the session's shared checkpoint
folder and read back: lineage is cut (a lost executor re-reads the table instead of
recomputing the chain), and later queries get column pruning and filter pushdown on
the scan.  Plans built on top therefore stay small.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lintlake.operators import critics as CR
from lintlake.operators import facts as FX
from lintlake.operators import metrics as M
from lintlake.operators import structure as S
from lintlake.session import ensure_checkpoint_dir
from lintlake.sources import corpus

_CACHE: dict[tuple[str, str], "Substrate"] = {}


class Substrate:
    def __init__(self, files: DataFrame, materialize: bool = True):
        self.files = files
        self._materialize = materialize
        self._root = None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        if not self._materialize:
            return df
        spark = df.sparkSession
        if self._root is None:
            self._root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lintlake-tables/{uuid.uuid4().hex}"
        path = f"{self._root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    @cached_property
    def lines(self) -> DataFrame:
        return self._keep(S.lines(self.files), "lines")

    @cached_property
    def stmts(self) -> DataFrame:
        return self._keep(S.statements(self.lines), "stmts")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._keep(S.blocks(self.stmts), "blocks")

    @cached_property
    def defs(self) -> DataFrame:
        return self._keep(S.definitions(self.stmts, self.blocks), "defs")

    @cached_property
    def functions(self) -> DataFrame:
        return self._keep(S.functions(self.lines, self.stmts, self.blocks, self.defs), "functions")

    @cached_property
    def fn_stmts(self) -> DataFrame:
        fst = M.fn_stmts(self.stmts, self.blocks, self.functions, self.containment).join(self.parent, ["file_id", "ln"], "left")
        return self._keep(fst, "fn_stmts")

    @cached_property
    def fn_metrics(self) -> DataFrame:
        return self._keep(M.function_metrics(self.fn_stmts, self.functions), "fn_metrics")

    @cached_property
    def parent(self) -> DataFrame:
        return self.containment.select("file_id", "ln", "parent_ln", "parent_kind")

    @cached_property
    def containment(self) -> DataFrame:
        """Innermost enclosing block and enclosing-block counts of every statement (one pass)."""
        return self._keep(M.containment(self.stmts, self.blocks), "containment")

    @cached_property
    def facts(self) -> DataFrame:
        return self._keep(FX.facts(self.fn_stmts, self.fn_metrics, self.parent, self.imports), "facts")

    @cached_property
    def calls(self) -> DataFrame:
        return self._keep(FX.calls(self.fn_stmts), "calls")

    @cached_property
    def critic_issues(self) -> DataFrame:
        """The four critics in one findings table (materialized once, read by every rollup)."""
        out = (CR.logic_issues(self.fn_stmts, self.functions)
               .unionByName(CR.security_issues(self.fn_stmts, self.calls))
               .unionByName(CR.performance_issues(self.fn_stmts, self.calls, self.blocks))
               .unionByName(CR.maintainability_issues(self.fn_stmts, self.fn_metrics)))
        return self._keep(out, "critic_issues")

    @cached_property
    def contract_items(self) -> DataFrame:
        from lintlake.operators import contracts as C
        return self._keep(C.contract_items(self.lines, self.functions, self.fn_stmts), "contract_items")

    @cached_property
    def fn_pairs(self) -> DataFrame:
        """Near-duplicate function pairs of every file (Dice >= 0.8) with names and body lengths."""
        from pyspark.sql import functions as F

        from lintlake.operators import similarity as SIM
        spans = self.functions.select("file_id", F.col("ln_start").alias("ln"), "ln_end", "qualified_name")
        own = S.owner(self.lines.select("file_id", "ln", "line"), spans)
        bodies = own.groupBy("file_id", F.col("o.ln").alias("fn_ln")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("body"))
        items = bodies.select(F.col("file_id").alias("grp"), F.col("fn_ln").alias("item"), "body")
        el = SIM.elements(items, F.regexp_extract_all("body", F.lit(SIM.CODE_TOKEN), 0))
        pairs = SIM.similar_pairs(el, 0.8)
        names = self.functions.select("file_id", "ln_start", "qualified_name")
        lens = bodies.select(F.col("file_id").alias("grp"), F.col("fn_ln"), F.length("body").alias("len"))
        out = (pairs.join(names.select(F.col("file_id").alias("grp"), F.col("ln_start").alias("a"), F.col("qualified_name").alias("fn_a")), ["grp", "a"])
               .join(names.select(F.col("file_id").alias("grp"), F.col("ln_start").alias("b"), F.col("qualified_name").alias("fn_b")), ["grp", "b"])
               .join(lens.select("grp", F.col("fn_ln").alias("a"), F.col("len").alias("len_a")), ["grp", "a"])
               .join(lens.select("grp", F.col("fn_ln").alias("b"), F.col("len").alias("len_b")), ["grp", "b"]))
        return self._keep(out, "fn_pairs")

    @cached_property
    def reach(self) -> DataFrame:
        """Transitive closure of the resolved file-import graph (shared by G04-G06)."""
        from lintlake.operators import graph as G
        spark = self.files.sparkSession
        return self._keep(G.closure(G.file_edges(G.resolve_imports(spark, self.files, self.imports))), "reach")

    @cached_property
    def classes(self) -> DataFrame:
        return self._keep(S.classes(self.lines, self.stmts, self.blocks, self.defs), "classes")

    @cached_property
    def imports(self) -> DataFrame:
        return S.imports(self.stmts)


def for_corpus(spark: SparkSession, sf_dir: str) -> Substrate:
    """Substrate of the table of source files in one folder (one per application)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Substrate(corpus.code_files(spark, sf_dir))
    return _CACHE[key]
