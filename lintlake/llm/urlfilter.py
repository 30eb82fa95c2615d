"""URL filters: a path-template tree per host, judged by smoothed labelled purity.

Rules come first: a rule (host, path prefix, verdict) fits its host and all subdomains when the url's path starts with the
rule's path; the longest fitting rule decides.  Every other url is judged by its host's path templates:

1. *Tree.*  Level by level the paths of a host are grown into templates.  Below a node, a segment value of at least
   ``min_support`` urls stays literal if its blocked share differs significantly from the rest of the node's (two-proportion
   z with continuity correction, at least ``z``), however small a part of the node it is, or if it holds ``min_share`` of
   the node's urls; every other value is variable and becomes a wildcard of its shape (digits, letters or mixed, with the
   file extension kept).
2. *Merging.*  Literal siblings are ordered by their blocked share; neighbours whose shares do not differ significantly
   (two-proportion z below ``z``) form one branch, named by its members (long names end in fingerprints of all members).
3. *Purity.*  A template's blocked share is smoothed with the share of the same template over all hosts, and that one with
   the share of all labelled urls, each counting as ``prior`` labelled urls.  Templates at or over ``cut`` are rejected.

Rounds follow the places where a host's urls branch, not the longest url: places where no value reaches ``min_support`` urls of
the host are wildcards at once, steps that all urls of a node share are taken together, and nodes below ``min_support``
urls end at once.  A round is needed for every level at which a node of ``min_support`` urls or more has different steps.

Labels are the verdicts of the rules, plus (optionally) a column of the input: 1 blocked, 0 allowed, null unlabelled.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and is judged like any url of the
empty host; repeated urls weigh as often as they occur; an empty table gives an empty result; paths may have any number of
segments; equal blocked shares count as one by their labelled urls; extra columns, ``host`` or ``path`` among them, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import ascii_lower, keep

# Fixed values of the contract: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

NAME = 200  # characters of a branch's name before the hash of all of it


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.when(F.instr(url, "://") > 0, url), "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.when(F.instr(url, "://") > 0, url), "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_hit(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else null; equally long ones in text order."""
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in best]
    none = F.lit(None).cast("string")
    pick = lambda vals: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, vals, strict=True)], none) if fits else none
    return pick([h + p for h, p, _ in best]), pick([v for _, _, v in best])


def shape(seg: Column) -> Column:
    """Wildcard of a variable segment: its kind of characters and its extension."""
    ext = F.regexp_extract(seg, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.substring(seg, F.lit(1), F.length(seg) - F.length(ext))
    kind = (F.when(stem == "", "").when(stem.rlike(r"^[0-9]+$"), "{digits}").when(stem.rlike(r"^\p{L}+$"), "{letters}").otherwise("{mixed}"))
    return F.concat(F.lit("*"), kind, ext)


def differs(z: float) -> Column:
    """Whether the labels of a segment (kb of kk blocked) differ significantly from the rest of its node's (nb of nk in all)."""
    known, rest = F.col("kk").cast("double"), (F.col("nk") - F.col("kk")).cast("double")
    both = F.col("nb") / F.nullif(F.col("nk"), F.lit(0))
    inverse = 1 / F.nullif(known, F.lit(0.0)) + 1 / F.nullif(rest, F.lit(0.0))
    gap = F.abs(F.col("kb") / F.nullif(known, F.lit(0.0)) - (F.col("nb") - F.col("kb")) / F.nullif(rest, F.lit(0.0)))
    return (both > 0) & (both < 1) & (gap - inverse / 2 >= z * F.sqrt(both * (1 - both) * inverse))


def open_steps(paths: DataFrame, min_support: int) -> DataFrame:
    """Paths with the places at which a segment may stay literal as ``steps`` (seg, the wildcards that follow it).

    No value of fewer than ``min_support`` urls of the host at its place is a literal of any node, so places without a
    more frequent value are wildcards for all paths of the host; those in front of the first step make the ``template``.
    """
    at = paths.select("host", "n", F.posexplode("segs").alias("place", "seg"))
    often = at.groupBy("host", "place", "seg").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_support)
    places = often.groupBy("host").agg(F.array_sort(F.collect_set("place")).alias("places"))
    p = paths.join(places, "host", "left").withColumn("wild", F.transform("segs", lambda s: F.concat(F.lit("/"), shape(s))))
    p = p.withColumn("places", F.filter(F.coalesce("places", F.array().cast("array<int>")), lambda i: i < F.size("segs")))
    until = lambda k: F.coalesce(F.get("places", k), F.size("segs"))
    run = lambda a, b: F.concat_ws("", F.slice("wild", a + 1, b - a))
    step = lambda i, k: F.struct(F.get("segs", i).alias("seg"), run(i + 1, until(k + 1)).alias("after"))
    return p.select("host", "path", run(F.lit(0), until(F.lit(0))).alias("template"), F.transform("places", step).alias("steps"), "n", "bad", "known")


def common_steps(live: DataFrame, min_support: int) -> DataFrame:
    """Steps that need no comparison of siblings are taken at once, however many they are.

    The first steps that all paths of a node share are its only children and stay literal; below a node of fewer than
    ``min_support`` urls all segments are wildcards.
    """
    nodes = live.groupBy("host", "template").agg(F.sum("n").alias("nn"), F.min("steps").alias("low"), F.max("steps").alias("high"))
    other = F.array_position(F.zip_with("low", "high", lambda a, b: ~a.eqNullSafe(b)), True)  # the least and the greatest path differ first where any two do
    shared = F.when(other > 0, other - 1).otherwise(F.size("low")).cast("int")
    nodes = nodes.select("host", "template", F.when(F.col("nn") >= min_support, shared).otherwise(-1).alias("shared"))
    kept = F.transform(F.slice("steps", F.lit(1), F.greatest("shared", F.lit(0))), lambda s: F.concat(F.lit("/"), literal_name(s["seg"]), s["after"]))
    wild = F.transform("steps", lambda s: F.concat(F.lit("/"), shape(s["seg"]), s["after"]))
    added = F.concat_ws("", F.when(F.col("shared") < 0, wild).otherwise(kept))
    rest = F.when(F.col("shared") < 0, F.slice("steps", 1, 0)).otherwise(F.slice("steps", F.greatest("shared", F.lit(0)) + 1, F.size("steps")))
    return live.join(nodes, ["host", "template"]).select("host", "path", F.concat("template", added).alias("template"), rest.alias("steps"), "n", "bad", "known")


def branches(literal: DataFrame, z: float) -> DataFrame:
    """Branch of every (kb, kk) of a node's literals: neighbours by blocked share that do not differ significantly are one.

    Segments with equal counts are one class, so a node's window holds its distinct counts, not its children.
    """
    kinds = literal.select("host", "template", "kb", "kk").distinct().withColumn("share", (F.col("kb") + 0.5) / (F.col("kk") + 1))
    sib = Window.partitionBy("host", "template").orderBy("share", "kk")
    both = (F.col("kb") + F.lag("kb").over(sib) + 0.5) / (F.col("kk") + F.lag("kk").over(sib) + 1)
    gap = (F.col("share") - F.lag("share").over(sib)) / F.sqrt(both * (1 - both) * (1 / (F.col("kk") + 1) + 1 / (F.lag("kk").over(sib) + 1)))
    kinds = kinds.withColumn("cutoff", F.when(F.abs(gap) >= z, 1).otherwise(0))
    return kinds.withColumn("branch", F.sum("cutoff").over(sib.rowsBetween(Window.unboundedPreceding, 0))).drop("share", "cutoff")


def long_name(first: Column, *marks: Column) -> Column:
    return F.concat(F.substring(first, 1, NAME), F.lit("|#"), *[F.lpad(F.hex(m), 16, "0") for m in marks])


def literal_name(seg: Column) -> Column:
    """Name of a branch of one segment."""
    return F.when(F.length(seg) > NAME, long_name(seg, *[F.xxhash64(seg, F.lit(k)) for k in (1, 2)])).otherwise(seg)


def branch_names(literal: DataFrame) -> DataFrame:
    """(host, template, seg, name): a branch is named by its members, from ``NAME`` characters on by its first and fingerprints of all."""
    key = ["host", "template", "branch"]
    marks = [F.expr(f"bit_xor(xxhash64(seg, {k}))").alias(f"m{k}") for k in (1, 2)]
    sizes = literal.groupBy(*key).agg((F.sum(F.length("seg")) + F.count(F.lit(1)) - 1).alias("chars"), F.min("seg").alias("first"), *marks)
    few = literal.join(sizes.filter(F.col("chars") <= NAME).select(*key), key).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("seg")), "|").alias("members"))
    names = sizes.join(few, key, "left").select(*key, F.coalesce("members", long_name(F.col("first"), F.col("m1"), F.col("m2"))).alias("name"))
    return literal.join(names, key).select("host", "template", "seg", "name")


def judge(pages: DataFrame, rules=RULES, label: str | None = None, min_share: float = 0.05, min_support: int = 10, z: float = 1.96,
          prior: float = 2.0, cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): every url with its rule or its template's verdict."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_of(url), path_of(url)
    p = pages.select("page_id", host.alias("host"), path.alias("path"), (F.col(label) if label else F.lit(None)).cast("int").alias("given"))
    rule, verdict = rule_hit(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    p = p.withColumn("label", F.coalesce(F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0), F.col("given")))
    # One row per distinct url path of a host: the tree grows on counts, so a hot host shrinks before any shuffle by host.
    paths = p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"), F.count("label").alias("known"))
    paths = paths.withColumn("segs", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("bad", F.coalesce("bad", F.lit(0)))
    paths = keep(paths, "url-paths")
    state = keep(open_steps(paths, min_support), "url-steps")
    node = ["host", "template"]
    done: list[DataFrame] = []
    while True:
        done.append(state.filter(F.size("steps") == 0).drop("steps"))
        live = state.filter(F.size("steps") > 0)
        if live.isEmpty():
            break
        state = keep(common_steps(live, min_support), "url-common")
        done.append(state.filter(F.size("steps") == 0).drop("steps"))
        live = state.filter(F.size("steps") > 0).withColumn("step", F.element_at("steps", 1)).withColumn("seg", F.col("step.seg"))
        kids = live.groupBy(*node, "seg").agg(F.sum("n").alias("kn"), F.sum("bad").alias("kb"), F.sum("known").alias("kk"))
        whole = kids.groupBy(*node).agg(F.sum("kn").alias("nn"), F.sum("kb").alias("nb"), F.sum("kk").alias("nk"))
        literal = kids.join(whole, node).filter(F.col("kn") >= min_support)
        literal = keep(literal.filter((F.col("kn") >= min_share * F.col("nn")) | F.coalesce(differs(z), F.lit(False))).select(*node, "seg", "kb", "kk"), "url-literals")
        named = branch_names(literal.join(branches(literal, z), [*node, "kb", "kk"]))
        grown = live.join(named, [*node, "seg"], "left")
        grown = grown.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", shape(F.col("seg"))), "step.after"))
        rest = F.slice("steps", F.lit(2), F.size("steps"))
        state = keep(grown.select(*node, "path", rest.alias("steps"), "n", "bad", "known"), "url-level")
    leaves = reduce(DataFrame.unionByName, done)
    own = leaves.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    pooled = leaves.groupBy("template").agg(F.sum("bad").alias("pool_bad"), F.sum("known").alias("pool_known"))
    whole = leaves.agg(((F.sum("bad") + 1) / (F.sum("known") + 2)).alias("base"))
    m = F.lit(float(prior))
    pooled = pooled.join(F.broadcast(whole)).select("template", ((F.col("pool_bad") + m * F.col("base")) / (F.col("pool_known") + m)).alias("pool"))
    purity = own.join(pooled, "template").select("host", "template", ((F.col("bad") + m * F.col("pool")) / (F.col("known") + m)).alias("purity"))
    found = leaves.select("host", "path", "template").join(purity, ["host", "template"])
    out = p.join(found, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("purity") >= cut, "block").otherwise("allow")).alias("verdict"),
                      "template", "purity")
