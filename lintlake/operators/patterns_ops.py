"""Design patterns, anti-patterns and smells (D01-D08, D12) as class / function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import patterns as P

# Name keywords of the pattern detectors.
FACTORY_CLASS_WORDS = ["factory", "creator", "builder"]
FACTORY_METHOD_WORDS = ["create", "make", "build", "get"]
STRATEGY_METHODS = ["execute", "calculate", "apply", "process", "run"]
MAGIC_ALLOWED = [0, 1, -1, 2, 100, 1000]


def _any(col, words):
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def _match(df, ptype, conf, evidence):
    return df.select("file_id", F.lit(ptype).alias("pattern_type"), F.col("name").alias("entity_name"),
                     F.col("ln_start").cast("bigint").alias("line_start"), F.col("ln_end").cast("bigint").alias("line_end"),
                     conf.alias("confidence"), evidence.alias("evidence"))


def class_members(stmts: DataFrame, classes: DataFrame) -> DataFrame:
    """Direct body statements of every class (statements whose parent block is the class)."""
    return stmts.join(classes.select("file_id", F.col("ln_start").alias("parent_ln"), F.col("name").alias("class_name")),
                      ["file_id", "parent_ln"])


def singletons(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``__new__``, or an ``_instance`` class variable together with a get-instance method."""
    tgt = F.regexp_extract("code", r"^([A-Za-z_][A-Za-z0-9_]*)\s*(:[^=]+)?=[^=]", 1)
    mname = F.regexp_extract("code", P.DEF_NAME, 2)
    g = members.groupBy("file_id", F.col("parent_ln").alias("ln_start")).agg(
        F.bool_or((F.col("kind") == "assign") & tgt.contains("_instance")).alias("inst"),
        F.bool_or((F.col("kind") == "def") & (mname.contains("get_instance") | mname.contains("getInstance"))).alias("getter"),
        F.bool_or((F.col("kind") == "def") & (mname == "__new__")).alias("new"))
    c = classes.join(g, ["file_id", "ln_start"])
    conf = F.when(F.col("new") | (F.col("inst") & F.col("getter")), "high")
    ev = F.array_join(F.array_compact(F.array(
        F.when(F.col("inst"), F.lit("Has _instance class variable")), F.when(F.col("getter"), F.lit("Has getInstance() method")),
        F.when(F.col("new"), F.lit("Overrides __new__ method")),
        F.when(F.col("inst") & F.col("getter"), F.lit("Has instance variable and getInstance method")))), "; ")
    return _match(c.filter(conf.isNotNull()), "singleton", conf, ev)


def factories(classes: DataFrame) -> DataFrame:
    """Class name with a factory word and at least one creating method."""
    fm = F.filter("methods", lambda m: _any(F.lower(m), FACTORY_METHOD_WORDS))
    c = classes.filter(_any(F.lower("name"), FACTORY_CLASS_WORDS) & (F.size(fm) > 0))
    return _match(c, "factory", F.lit("medium"), F.concat(F.lit("Has factory methods: "), F.array_join(fm, ", ")))


def strategies(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Name ends with Strategy, or strategy methods while every method body starts abstract."""
    defs = members.filter(F.col("kind") == "def")
    abstract = (F.col("next_kind") == "pass") | (F.col("next_code") == "None") | F.col("next_code").rlike(r"^raise\s+NotImplementedError\s*\(")
    g = defs.groupBy("file_id", F.col("parent_ln").alias("ln_start")).agg(F.bool_and(abstract).alias("all_abstract"))
    c = classes.join(g, ["file_id", "ln_start"], "left")
    sm = F.filter("methods", lambda m: m.isin(*STRATEGY_METHODS))
    hit = F.col("name").endswith("Strategy") | ((F.size(sm) > 0) & F.coalesce("all_abstract", F.lit(True)))
    return _match(c.filter(hit), "strategy", F.lit("medium"), F.concat(F.lit("Strategy methods: "), F.array_join(sm, ", ")))


def decorators(functions: DataFrame, defs: DataFrame, fst: DataFrame) -> DataFrame:
    """Decorator-like functions: name, callable parameter, or returning a nested function."""
    nested = defs.filter(F.col("kind") == "def").select("file_id", F.col("name").alias("ret"), F.col("ln").alias("d_ln"))
    rets = fst.filter((F.col("kind") == "return") & (F.col("parent_ln") == F.col("fn_ln"))).select(
        "file_id", "fn_ln", F.regexp_extract("code", r"^return\s+([A-Za-z_][A-Za-z0-9_]*)\s*$", 1).alias("ret")).filter(F.col("ret") != "")
    f = functions.select("file_id", "name", "ln_start", "ln_end", "params")
    # The returned name must be a def inside the function (or the function itself).
    ret_hit = rets.join(nested, ["file_id", "ret"]).join(
        f.select("file_id", F.col("ln_start").alias("fn_ln"), F.col("ln_end").alias("fn_end")), ["file_id", "fn_ln"]).filter(
        (F.col("d_ln") >= F.col("fn_ln")) & (F.col("d_ln") <= F.col("fn_end"))).select(
        "file_id", F.col("fn_ln").alias("ln_start")).distinct().withColumn("returns_inner", F.lit(True))
    j = f.join(ret_hit, ["file_id", "ln_start"], "left")
    by_name = F.lower("name").contains("decorator")
    callable_p = F.exists("params", lambda p: F.coalesce(p["type_hint"], F.lit("")).contains("Callable"))
    inner = F.coalesce("returns_inner", F.lit(False))
    ev = F.array_join(F.array_compact(F.array(
        F.when(by_name, F.lit("Name suggests decorator pattern")),
        F.when(callable_p, F.lit("Takes callable parameter and has nested function")),
        F.when(inner, F.lit("Returns nested function (closure)")))), "; ")
    return _match(j.filter(by_name | callable_p | inner), "decorator", F.lit("medium"), ev)


def anti_patterns(classes: DataFrame, functions: DataFrame, fst: DataFrame) -> DataFrame:
    """D05 god object, D06 long method, D08 spaghetti code: (file, kind, entity, line, severity)."""
    cl = classes.select("file_id", "name", "ln_start", (F.col("ln_end") - F.col("ln_start")).alias("lines"),
                        F.size("methods").alias("m"))
    d05 = cl.filter((F.col("m") > 15) | (F.col("lines") > 200)).select(
        "file_id", F.lit("god_object").alias("kind"), F.col("name").alias("entity"), F.col("ln_start").cast("bigint").alias("ln"),
        F.when(F.col("m") > 30, "critical").otherwise("high").alias("severity"))
    d06 = functions.filter(F.col("ln_end") - F.col("ln_start") > 30).select(
        "file_id", F.lit("long_method").alias("kind"), F.col("name").alias("entity"), F.col("ln_start").cast("bigint").alias("ln"),
        F.lit("medium").alias("severity"))
    nest = fst.filter(F.col("kind").isin("if", "elif", "for", "while", "try", "with")).groupBy("file_id", "fn_ln").agg(
        F.max(F.col("nest") + 1).alias("depth"))
    d08 = functions.join(nest.withColumnRenamed("fn_ln", "ln_start"), ["file_id", "ln_start"]).filter(F.col("depth") > 4).select(
        "file_id", F.lit("spaghetti_code").alias("kind"), F.col("name").alias("entity"), F.col("ln_start").cast("bigint").alias("ln"),
        F.lit("high").alias("severity"))
    return d05.unionByName(d06).unionByName(d08)


def magic_number_lines(fst: DataFrame, functions: DataFrame) -> DataFrame:
    """Count of numbers outside the allow-list per (function, line)."""
    nums = fst.filter(F.col("kind") != "docstring").select(
        "file_id", "fn_ln", "ln", F.explode(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(P.NUMBER), 2)).alias("num"))
    bad = nums.filter(~F.col("num").cast("double").isin(*[float(x) for x in MAGIC_ALLOWED]))
    g = bad.groupBy("file_id", "fn_ln", "ln").agg(F.count(F.lit(1)).alias("n"))
    return g.join(functions.select("file_id", F.col("ln_start").alias("fn_ln"), "name"), ["file_id", "fn_ln"]).select(
        "file_id", F.concat_ws(":", "name", F.col("ln").cast("string")).alias("key"), F.col("n").cast("bigint").alias("n"))
