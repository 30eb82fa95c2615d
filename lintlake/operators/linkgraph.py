"""Closure, cycles and components of a directed edge table (src, dst), and look-up of links from near to far.

Closures start from given seeds and only append the new frontier; where numbers are asked for, what a hub reaches is counted once
for all that reach the hub.  Cycles are found by trimming (nodes without incoming or outgoing edges can't lie on one) and colouring.  Every loop runs until its frontier or its trimmed part is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.session import materialize


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, distance): breadth-first distances from every seed, itself at 0."""
    front = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("distance")).distinct(), "closure")
    seen = [front]
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    known = front
    while not front.isEmpty():
        step = front.join(e, "node").select("seed", F.col("next").alias("node"), (F.col("distance") + 1).alias("distance")).distinct()
        front = materialize(step.join(known.select("seed", "node"), ["seed", "node"], "left_anti"), "closure")
        seen.append(front)
        known = known.unionByName(front)
    return known


def _spread(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of ``starts`` (part, node and further keys) with every node that is reached from them along the part's edges."""
    keys = [c for c in starts.columns if c != "node"]
    e = edges.select("part", F.col("src").alias("node"), F.col("dst").alias("next"))
    front = materialize(starts.distinct(), "spread")
    known = front
    while not front.isEmpty():
        step = front.join(e, ["part", "node"]).select(*keys, F.col("next").alias("node")).distinct()
        front = materialize(step.join(known, [*keys, "node"], "left_anti"), "spread")
        known = known.unionByName(front)
    return known


def reached_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, reached): how many nodes every seed (column ``node``) reaches, itself included, without a table of all pairs.

    Per part of the graph the node with most links in and out is its hub.  What the hub reaches is counted once: seeds that reach
    the hub reach all of it, and from it no way leads out, so they go on in a part without these nodes.  The other seeds never
    meet a node that reaches the hub and go on in a part without those.  Parts are split while seeds times inner edges are
    many and a round halves them; what is left is followed seed by seed.
    """
    s = materialize(seeds.select(F.lit(0).cast("long").alias("part"), F.col("node").alias("seed"), F.lit(0).cast("long").alias("base")).distinct(), "seeds")
    e = materialize(edges.filter("src <> dst").select(F.lit(0).cast("long").alias("part"), "src", "dst").distinct(), "parts")
    few = 4 * (e.count() + s.count())
    done: list[DataFrame] = []
    before = None
    while True:
        near = _spread(e, s.select("part", F.col("seed").alias("node"))).withColumnRenamed("node", "src")
        e = materialize(e.join(near, ["part", "src"], "left_semi"), "parts")
        inner = e.join(e.select("part", F.col("dst").alias("src")).distinct(), ["part", "src"], "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("k"))
        work = inner.join(s.groupBy("part").agg(F.count(F.lit(1)).alias("m")), "part").agg(F.sum(F.col("k").cast("double") * F.col("m"))).first()[0] or 0
        if work <= few or (before is not None and work > before / 2):
            break
        before = work
        ends = e.select("part", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
        both = ends.groupBy("part", "x.node").agg((F.sum("x.o") * F.sum("x.i")).alias("links")).filter("links > 0")
        hub = materialize(both.groupBy("part").agg(F.max(F.struct("links", "node")).alias("x")).select("part", "x.node"), "hubs")
        down = _spread(e, hub)
        up = _spread(e.select("part", F.col("dst").alias("src"), F.col("src").alias("dst")), hub)
        size = down.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        told = s.join(up.select("part", F.col("node").alias("seed"), F.lit(True).alias("above")), ["part", "seed"], "left")
        told = told.join(down.select("part", F.col("node").alias("seed"), F.lit(True).alias("below")), ["part", "seed"], "left").join(size, "part", "left")
        told = materialize(told.select("part", "seed", F.col("above").isNotNull().alias("above"), F.col("below").isNotNull().alias("below"), (F.col("base") + F.when(F.col("above"), F.col("size")).otherwise(0)).alias("base")), "told")
        done.append(told.filter("above AND below").select("seed", F.col("base").alias("reached")))
        s = told.filter("NOT (above AND below)").select((F.col("part") * 2 + F.when(F.col("above"), 0).otherwise(1)).alias("part"), "seed", "base")
        cut = lambda gone: e.join(gone.withColumnRenamed("node", "src"), ["part", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["part", "dst"], "left_anti")
        e = materialize(cut(down).select((F.col("part") * 2).alias("part"), "src", "dst").unionByName(cut(up).select((F.col("part") * 2 + 1).alias("part"), "src", "dst")), "parts")
    far = _spread(e, s.select("part", "seed", F.col("seed").alias("node"))).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    out = s.join(far, "seed").select("seed", (F.col("base") + F.col("n")).alias("reached"))
    for d in done:
        out = out.unionByName(d)
    return out


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without incoming or without outgoing edges are trimmed again and again."""
    e = materialize(edges.select("src", "dst").distinct(), "core")
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = materialize(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "core")
        m = kept.count()
        e, n = kept, (0 if m == n else m)
    return e


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(node, length): the shortest cycle through every node that lies on one."""
    core = cyclic_core(edges)
    out = core.filter("src = dst").select(F.col("src").alias("node"), F.lit(1).cast("long").alias("length"))
    proper = core.filter("src <> dst").join(out.select(F.col("node").alias("src")), "src", "left_anti")
    # A node's search ends at the first level that comes back to it.
    e = core.filter("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    front = materialize(proper.select(F.col("src").alias("seed"), F.col("dst").alias("node")), "cycles")
    known, length = front, 1
    while not front.isEmpty():
        length += 1
        step = materialize(front.join(e, "node").select("seed", F.col("next").alias("node")).distinct(), "step")
        ended = step.filter("seed = node").select("node", F.lit(length).cast("long").alias("length"))
        out = out.unionByName(ended)
        front = step.join(ended.select(F.col("node").alias("seed")), "seed", "left_anti").join(known, ["seed", "node"], "left_anti")
        front = materialize(front, "cycles")
        known = known.unionByName(front)
    return out


def _spread_least(edges: DataFrame, value: DataFrame, hops: int = 4) -> DataFrame:
    """(node, colour): the smallest ``colour`` of the nodes from which a node can be reached, its own included.

    Every node of ``value`` (node, colour) keeps its own by an edge to itself; it is written once per ``hops`` hops, and
    that ends when no colour changes any more.
    """
    e = materialize(edges.select("src", "dst").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("src")).withColumn("dst", F.col("src"))).distinct(), "hops")
    before = None
    while True:
        for _ in range(hops):
            value = e.join(value.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("colour"))
        value = materialize(value, "colour")
        mark = value.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
        if mark == before:
            return value
        before = mark


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components that hold a cycle, named by their smallest node.

    What can't lie on a cycle is trimmed.  Then every node takes the smallest node that reaches it as its colour (forward),
    and those that reach the node of their colour inside the colour (backward) form its component, of which it is the
    smallest node.  Components leave the graph, edges between colours too, and the rest goes round again: every round ends
    at least one component per colour, so no table of all pairs is made.
    """
    left = cyclic_core(edges)
    found = []
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread_least(left, nodes.withColumn("colour", F.col("node")))
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d")
        inside = materialize(inside.select("src", "dst"), "inside")
        # Backward: a node reaches its colour's node if the reversed edges carry that node's name to it.
        roots = colour.filter("node = colour")
        back = _spread_least(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        back = back.unionByName(roots.join(back, "node", "left_anti"))
        # A colour's node always belongs to it; alone and without a loop it is no cycle.
        looped = inside.filter("src = dst").select(F.col("src").alias("component")).distinct()
        part = back.select("node", F.col("colour").alias("component"))
        sizes = part.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        real = sizes.filter("n > 1").select("component").unionByName(looped).distinct()
        found.append(materialize(part.join(real, "component", "left_semi").select("node", "component"), "component"))
        gone = materialize(part.select("node"), "gone")
        rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = cyclic_core(rest)
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cycles_through(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, size, length, path): a shortest cycle through every component's smallest node.

    A breadth-first search inside the components keeps for every node its smallest predecessor on the level before; the path is
    read back along these pointers and starts and ends at the component's node.
    """
    m = members.select("node", "component")
    inner = edges.select("src", "dst").distinct().join(m.withColumnRenamed("node", "src"), "src").join(m.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").filter("c = component")
    inner = materialize(inner.select("component", "src", "dst"), "inner")
    known = materialize(m.filter("node = component").select("component", "node", F.lit(None).cast(m.schema["node"].dataType).alias("parent"), F.lit(0).alias("level")), "levels")
    level, done, ends = 0, m.select("component").limit(0), []
    while True:
        front = known.filter(F.col("level") == level).join(done, "component", "left_anti")
        step = front.select("component", F.col("node").alias("src")).join(inner, ["component", "src"])
        step = materialize(step.groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("parent")), "step")
        if step.isEmpty():
            break
        level += 1
        # A component is done at the first level that comes back to its node.
        ends.append(step.filter("node = component").select("component", F.col("parent").alias("last"), F.lit(level).alias("length")))
        done = done.unionByName(step.filter("node = component").select("component"))
        new = step.join(known.select("component", "node"), ["component", "node"], "left_anti").withColumn("level", F.lit(level))
        known = known.unionByName(materialize(new, "levels"))
    sizes = m.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    if not ends:
        return sizes.filter(F.lit(False)).select("component", "size", F.lit(0).cast("long").alias("length"), F.array("component").alias("path"))
    found = ends[0]
    for e in ends[1:]:
        found = found.unionByName(e)
    path = found.select("component", "length", F.col("last").alias("at"), F.array("last", "component").alias("path"))
    pointers = known.select("component", F.col("node").alias("at"), "parent")
    for _ in range(level - 1):  # all paths step back together; one that has reached its start stays
        path = path.join(pointers, ["component", "at"], "left").select("component", "length", F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), F.col("path"))).alias("path"))
    path = path.withColumn("path", F.when(F.col("length") == 1, F.array("component", "component")).otherwise(F.col("path")))
    return path.join(sizes, "component").select("component", "size", F.col("length").cast("long").alias("length"), "path")


def resolve_near_to_far(links: DataFrame, known: DataFrame) -> DataFrame:
    """(link columns, target, level): the first existing path when a link is looked up from its page's folder outwards.

    ``links`` has ``base`` (array of folder names, nearest last) and ``name`` (array); ``known`` has distinct ``path`` (array).
    Level 0 is the page's own folder, every level beyond leaves one folder away; unresolved links keep null in both.  One
    row per link and level is made, and one equality join finds those that exist.  Both joins are by shuffle: the written
    links are small files, from which Spark would plan to collect all their rows and levels in the driver for a broadcast.
    """
    at = materialize(links.withColumn("link", F.monotonically_increasing_id()), "links")
    tried = at.select("link", F.explode(F.sequence(F.lit(0), F.size("base"))).alias("level"), "base", "name")
    tried = tried.select("link", "level", F.concat(F.slice("base", F.lit(1), F.size("base") - F.col("level")), "name").alias("path"))
    hit = tried.hint("merge").join(known.select("path").distinct(), "path").groupBy("link").agg(F.min(F.struct("level", "path")).alias("hit"))
    return at.hint("merge").join(hit, "link", "left").select(*links.columns, F.col("hit.path").alias("target"), F.col("hit.level").alias("level"))
