"""Approximate nearest neighbours by largest inner product: NN-descent graph, greedy graph search.

1. *Nodes.*  Equal vectors are one node with its smallest ids; vectors that are null, zero or hold a null or non-finite
   component take no part, nor do those of another length than most.
2. *Start.*  ``trees`` random hyperplane codes order the nodes ``trees`` times; runs of ``leaf`` nodes in an order are
   compared within a task, and every node keeps its best ``k``.
3. *NN-descent.*  Every round joins the edges and their reverses by node, so a task holds a node's neighbourhood (at most
   ``k`` forward and ``k`` seeded reverse neighbours) and scores all its pairs that are new.  A neighbour of a neighbour
   that beats a node's k-th edge is proposed; proposals and edges merge into the best ``k`` again.  Rounds end when fewer
   than ``settle`` of the edges change.
4. *Search.*  A query starts at its own node and keeps a beam of ``ef`` nodes.  Every round joins the beam's unexpanded
   nodes with the graph and scores their neighbours, until the beam holds no unexpanded node.  The beam's members are then
   scored exactly, in double precision on the original vectors.

The graph is built on half-precision copies of the vectors, scaled by the largest component.  Every row is indexed.
Defined results: a query gets all candidates if there are fewer than ``top``; ties go to the smaller id; repeated ids are
searched once per distinct vector, each with its own ranks; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import keep

BITS = 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("vec", odd) & F.exists("vec", lambda x: x != 0))
    most = v.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "dim").limit(1)
    return v.join(F.broadcast(most.select("dim")), F.size("vec") == F.col("dim"), "left_semi")


def _rows(col: pa.Array) -> np.ndarray:
    """A list or fixed-size binary column of equal lengths as a matrix."""
    if len(col) == 0:
        return np.zeros((0, 0))
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(len(col), -1)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nodes_of(v: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(nid, vec, half) of the distinct vectors and (nid, vec_id) of their ``top`` + 1 smallest ids."""
    distinct = v.select("vec").distinct().withColumn("nid", F.monotonically_increasing_id())
    scale = v.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    schema = pa.schema([("nid", pa.int64()), ("vec", pa.list_(pa.float32())), ("half", pa.binary())])

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = (_rows(b.column("vec")) / scale).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("nid"), b.column("vec").cast(pa.list_(pa.float32())), pa.array([r.tobytes() for r in m], pa.binary())], schema=schema)

    nodes = keep(distinct.select("nid", "vec").mapInArrow(halve, "nid long, vec array<float>, half binary"), "ann-nodes")
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = v.distinct().withColumn("r", rank).filter(F.col("r") <= top + 1).drop("r")
    members = keep(few.join(nodes.select("nid", "vec"), "vec").select("nid", "vec_id"), "ann-members")
    return nodes, members


def start_edges(nodes: DataFrame, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(u, best): the best neighbours of every node within its leaves."""
    schema = pa.schema([("tree", pa.int32()), ("code", pa.int64()), ("nid", pa.int64()), ("half", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _rows(b.column("half")).astype(np.float32)
            planes = np.random.default_rng(seed).standard_normal((trees, m.shape[1], BITS)).astype(np.float32)
            for t in range(trees):
                bits = (m @ planes[t] > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(bits), b.column("nid"), b.column("half")], schema=schema)

    edge = pa.struct([("s", pa.float32()), ("v", pa.int64())])
    out_schema = pa.schema([("u", pa.int64()), ("best", pa.list_(edge))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> pa.RecordBatch:
            nid, m = rows.column("nid").to_numpy(), _rows(rows.column("half").combine_chunks()).astype(np.float32)
            s = m @ m.T
            np.fill_diagonal(s, -np.inf)
            n = min(k, len(nid) - 1)
            at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n > 0 else np.zeros((len(nid), 0), np.int64)
            best = pa.StructArray.from_arrays([pa.array(np.take_along_axis(s, at, 1).ravel()), pa.array(nid[at].ravel())], fields=list(edge))
            return pa.RecordBatch.from_arrays([pa.array(nid), pa.ListArray.from_arrays(pa.array(np.arange(0, len(nid) * n + 1, n, dtype=np.int32) if n else np.zeros(len(nid) + 1, np.int32)), best)], schema=out_schema)

        for b in batches:
            tree = b.column("tree").to_numpy()
            cut = 0
            for i in np.append(np.flatnonzero(tree[1:] != tree[:-1]) + 1, len(tree)).tolist():
                while cut < i:
                    if held and (held[0].column("tree")[0].as_py() != tree[cut] or sum(h.num_rows for h in held) >= leaf):
                        yield solve(pa.Table.from_batches(held))
                        held = []
                    n = min(i - cut, leaf - sum(h.num_rows for h in held))
                    held.append(b.slice(cut, n))
                    cut += n
        if held:
            yield solve(pa.Table.from_batches(held))

    coded = nodes.select("nid", "half").mapInArrow(code, "tree int, code long, nid long, half binary")
    parts = max(1, -(-nodes.count() * trees // (4 * leaf)))
    coded = coded.repartitionByRange(parts, "tree", "code", "nid").sortWithinPartitions("tree", "code", "nid")
    lists = coded.mapInArrow(compare, "u long, best array<struct<s:float,v:long>>")
    return lists.groupBy("u").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("best"))), asc=False), 1, k).alias("best"))


def descend(nodes: DataFrame, graph: DataFrame, k: int, rounds: int, settle: float, propose: int = 8) -> DataFrame:
    """Improves (u, best) by rounds of neighbours of neighbours."""
    edges = keep(graph.select("u", F.explode("best").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"), F.lit(True).alias("fresh")), "ann-edges")
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float32()), ("fresh", pa.bool_())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs, ss = [], [], []
            for r in range(b.num_rows):
                hood = b.column("hood")[r].values
                nid, first = np.unique(hood.field("v").to_numpy(), return_index=True)
                m = _rows(hood.field("half")).astype(np.float32)[first]
                fresh = np.isin(nid, hood.field("v").to_numpy()[hood.field("fresh").to_numpy(zero_copy_only=False)])
                worst = hood.field("worst").to_numpy()[first]
                s = m @ m.T
                s[~(fresh[:, None] | fresh[None, :])] = -np.inf
                np.fill_diagonal(s, -np.inf)
                s[s <= worst[:, None]] = -np.inf
                n = min(propose, len(nid))
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                val = np.take_along_axis(s, at, 1)
                ok = np.isfinite(val)
                us.append(np.repeat(nid, n)[ok.ravel()])
                vs.append(nid[at][ok])
                ss.append(val[ok])
            if us:
                u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(np.ones(len(u), bool))], schema=edge)

    half = nodes.select(F.col("nid").alias("v"), "half")
    for turn in range(rounds):
        ends = edges.groupBy("u").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("c"))
        worst = ends.select(F.col("u").alias("v"), F.when(F.col("c") < k, F.lit(float("-inf"))).otherwise(F.col("least")).cast("float").alias("worst"))
        known = half.join(worst, "v", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")).cast("float")))
        rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("fresh").desc(), F.xxhash64("u", "v", F.lit(turn))))
        back = edges.withColumn("r", rank).filter(F.col("r") <= k).select(F.col("v").alias("w"), F.col("u").alias("v"), "fresh")
        hood = edges.select(F.col("u").alias("w"), "v", "fresh").unionByName(back)
        # Without a fresh member a neighbourhood has no new pair.
        lively = hood.filter("fresh").select("w").distinct()
        hood = hood.join(lively, "w", "left_semi").join(known, "v")
        hood = hood.groupBy("w").agg(F.collect_list(F.struct("v", "fresh", "worst", "half")).alias("hood"))
        found = hood.select("hood").mapInArrow(local, "u long, v long, s float, fresh boolean")
        old = edges.withColumn("fresh", F.lit(False))
        merged = old.unionByName(found).groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        best = merged.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "v", "fresh")), asc=False), 1, k).alias("best"))
        edges = keep(best.select("u", F.explode("best").alias("e")).select("u", "e.v", "e.s", "e.fresh"), "ann-edges")
        total, new = edges.agg(F.count(F.lit(1)), F.sum(F.col("fresh").cast("long"))).first()
        if not total or new < settle * total:
            break
    return edges.select("u", "v", "s")


def search(nodes: DataFrame, edges: DataFrame, starts: DataFrame, ef: int) -> DataFrame:
    """(nid, found): for every start node its beam of the best ``ef`` nodes, itself included."""
    out = edges.groupBy("u").agg(F.collect_list("v").alias("next"))
    entry = pa.struct([("v", pa.int64()), ("s", pa.float32()), ("open", pa.bool_())])
    schema = pa.schema([("nid", pa.int64()), ("beam", pa.list_(entry))])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            own = _rows(b.column("half")).astype(np.float32) if b.num_rows else None
            for r in range(b.num_rows):
                new = b.column("new")[r].values
                nid = new.field("v").to_numpy()
                s = _rows(new.field("half")).astype(np.float32) @ own[r] if len(nid) else np.zeros(0, np.float32)
                beam = b.column("beam")[r].values
                seen = beam.field("v").to_numpy()
                fresh = ~np.isin(nid, seen)
                v = np.concatenate([seen, nid[fresh]])
                s = np.concatenate([beam.field("s").to_numpy(), s[fresh]])
                open_ = np.concatenate([np.zeros(len(seen), bool), np.ones(int(fresh.sum()), bool)])
                o = np.lexsort((v, -s))[:ef]
                rows.append(pa.StructArray.from_arrays([pa.array(v[o]), pa.array(s[o], pa.float32()), pa.array(open_[o])], fields=list(entry)))
            if rows:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("nid"), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(rows))], schema=schema)

    own = nodes.select("nid", "half")
    kind = "array<struct<v:long,s:float,open:boolean>>"
    # The start enters the beam with its own score as the first round's only new node.
    first = starts.select("nid").join(own, "nid").select("nid", "half", F.array().cast(kind).alias("beam"), F.array(F.struct(F.col("nid").alias("v"), "half")).alias("new"))
    beams = keep(first.mapInArrow(advance, f"nid long, beam {kind}"), "ann-beams")
    done: DataFrame | None = None
    while True:
        over = beams.filter(~F.exists("beam", lambda x: x["open"]))
        done = over if done is None else done.unionByName(over)
        live = beams.filter(F.exists("beam", lambda x: x["open"]))
        if live.isEmpty():
            return done.select("nid", F.transform("beam", lambda x: x["v"]).alias("found"))
        step = live.select("nid", F.explode(F.filter("beam", lambda x: x["open"])).alias("e")).select("nid", F.col("e.v").alias("u"))
        reach = step.join(out, "u").select("nid", F.explode("next").alias("v")).distinct()
        known = live.select("nid", F.explode("beam").alias("e")).select("nid", F.col("e.v").alias("v"))
        new = reach.join(known, ["nid", "v"], "left_anti").join(nodes.select(F.col("nid").alias("v"), "half"), "v")
        new = new.groupBy("nid").agg(F.collect_list(F.struct("v", "half")).alias("new"))
        state = live.join(own, "nid").join(new, "nid", "left")
        empty = F.array().cast("array<struct<v:long,half:binary>>")
        state = state.select("nid", "half", "beam", F.coalesce("new", empty).alias("new"))
        beams = keep(state.mapInArrow(advance, f"nid long, beam {kind}"), "ann-beams")


def neighbours(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, k: int = 30, trees: int = 8,
               leaf: int = 2048, rounds: int = 8, settle: float = 0.05, ef: int = 96, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` found nearest of every row whose ``vec_id`` meets ``queries``."""
    v = usable(vectors, id_col, vec_col)
    nodes, members = nodes_of(v, top)
    edges = descend(nodes, start_edges(nodes, k, trees, leaf, seed), k, rounds, settle)
    asked = keep(v.filter(queries).join(nodes.select("nid", "vec"), "vec").select("nid", F.col("vec_id").alias("query_id")).distinct(), "ann-queries")
    found = search(nodes, edges, asked.select("nid").distinct(), ef)
    near = found.select("nid", F.explode("found").alias("v"))
    vec = nodes.select("nid", "vec")
    pairs = near.join(vec.withColumnRenamed("vec", "q"), "nid").join(vec.select(F.col("nid").alias("v"), F.col("vec").alias("x")), "v")
    dot = F.aggregate(F.zip_with("q", "x", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("nid", "v", dot.alias("score"))
    scored = scored.join(members.select(F.col("nid").alias("v"), "vec_id"), "v").join(asked, "nid").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "nid").orderBy(F.col("score").desc(), "vec_id"))
    return scored.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= top)
