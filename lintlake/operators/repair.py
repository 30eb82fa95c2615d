"""Repair and suggestion datasets (F01-F12): fixes, applied corpus, refactorings, generated tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Routing of a finding to a fix kind, first match wins (title / description keywords).
ROUTES = [
    ("sql_injection", ["sql", "injection"], ["sql"], []),
    ("xss", ["xss", "html"], ["xss"], []),
    ("command_injection", ["command"], ["command", "os.system"], []),
    ("path_traversal", ["path", "traversal"], ["file"], []),
    ("division_by_zero", ["division", "zero"], ["division"], []),
    ("none_check", ["none", "dereference"], ["optional"], []),
    ("extract_function", ["long function"], ["long"], []),
    ("guard_clauses", ["nesting"], ["nested"], []),
    ("parameter_grouping", ["parameter"], ["parameter"], []),
    ("resource_leak", ["resource", "leak"], ["file not closed"], []),
]
# Per kind, description, confidence and review flag of the fix.
KINDS = {
    "sql_injection": ("Use parameterized queries to prevent SQL injection", "medium", True),
    "xss": ("Escape HTML output to prevent XSS", "medium", True),
    "command_injection": ("Use subprocess.run with list of arguments to prevent command injection", "high", True),
    "path_traversal": ("Validate file paths to prevent path traversal attacks", "high", True),
    "division_by_zero": ("Check denominator is not zero before division", "high", False),
    "none_check": ("Add None check before using optional value", "high", False),
    "extract_function": ("Extract smaller functions to improve readability", "low", True),
    "guard_clauses": ("Use guard clauses to reduce nesting depth", "medium", True),
    "parameter_grouping": ("Group related parameters into a dataclass or config object", "medium", True),
    "resource_leak": ("Use context manager (with statement) for automatic resource cleanup", "high", False),
}
# Replacement text of the kinds that do not rewrite the line itself.
COMMAND_FIX = "# run the program without a shell: pass its arguments as a list\nsubprocess.run([program, *arguments], check=True)"
PATH_FIX = ("# stay below the allowed folder\ntarget = Path(base, name).resolve()\nif Path(base).resolve() not in target.parents:\n"
            "    raise PermissionError(name)")
DIVISION_PREFIX = "# Add: if denominator != 0 before division\n"
NONE_PREFIX = "# Add guard clause\nif value is None:\n    return None  # or handle appropriately\n"
EXTRACT_FIX = "# Extract logical blocks into helper functions"
GUARD_FIX = "# Use guard clauses (early returns) to reduce nesting"
GROUP_FIX = "from dataclasses import dataclass"
MAGIC_ALLOWED = [0, 1, -1, 2, 100, 1000]


def line_of(location: Column) -> Column:
    """line number after the last ':' of a location text, when there is one."""
    return F.when(location.contains(":"), F.expr("try_cast(substring_index(location, ':', -1) AS INT)"))


def route(title: Column, description: Column) -> Column:
    """the first fix kind whose title or description keywords match."""
    t, d = F.lower(title), F.lower(F.coalesce(description, F.lit("")))
    out = F.lit(None).cast("string")
    for kind, tw, dw, _ in reversed(ROUTES):
        hit = F.lit(False)
        for w in tw:
            hit = hit | t.contains(w)
        for w in dw:
            hit = hit | d.contains(w)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def _rewrite(kind: Column, line: Column) -> Column:
    sql1 = F.replace(F.replace(line, F.lit(' f"'), F.lit('", params)  # Use parameterized query')),
                     F.lit('" % '), F.lit('", % (params))  # Use parameterized query'))
    sql = F.when((sql1 == line) & line.contains(" + ") & F.upper(line).contains("SELECT"),
                 F.lit("# TODO: Rewrite using parameterized query")).otherwise(sql1)
    res1 = F.replace(line, F.lit("open("), F.lit("with open("))
    res = F.when(res1.contains("with open(") & ~res1.contains(" as "), F.replace(res1, F.lit(") "), F.lit(") as f: "))).otherwise(res1)
    return (F.when(kind == "sql_injection", sql)
            .when(kind == "xss", F.concat(F.replace(line, F.lit(" + "), F.lit(" + html.escape(")),
                                          F.lit("  # Add: import html; html.escape(user_input)")))
            .when(kind == "command_injection", F.lit(COMMAND_FIX))
            .when(kind == "path_traversal", F.lit(PATH_FIX))
            .when(kind == "division_by_zero", F.concat(F.lit(DIVISION_PREFIX), line))
            .when(kind == "none_check", F.concat(F.lit(NONE_PREFIX), line))
            .when(kind == "extract_function", F.lit(EXTRACT_FIX))
            .when(kind == "guard_clauses", F.lit(GUARD_FIX))
            .when(kind == "parameter_grouping", F.lit(GROUP_FIX))
            .when(kind == "resource_leak", res))


def fixes(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """one fix row per routable finding whose line exists (equi-join on file and line)."""
    f = findings.select("file_id", "issue_id", "category", route(F.col("title"), F.col("description")).alias("kind"),
                        line_of(F.col("location")).alias("ln")).filter(F.col("kind").isNotNull() & F.col("ln").isNotNull())
    j = f.join(lines.select("file_id", "ln", "line"), ["file_id", "ln"])
    meta = F.create_map(*[x for k, (d, c, r) in KINDS.items() for x in (F.lit(k), F.struct(F.lit(d).alias("d"), F.lit(c).alias("c"), F.lit(r).alias("r")))])
    m = meta[F.col("kind")]
    return j.select("file_id", "issue_id", F.col("category").alias("issue_type"), "kind", F.col("ln").cast("bigint").alias("line_start"),
                    F.col("line").alias("original_code"), _rewrite(F.col("kind"), F.col("line")).alias("fixed_code"),
                    m["d"].alias("description"), m["c"].alias("confidence"), m["r"].alias("requires_review"))


def apply_fixes(lines: DataFrame, fx: DataFrame) -> DataFrame:
    """replace fixed lines; for one line the last fix (by issue id) wins; line 0 is ignored."""
    w = Window.partitionBy("file_id", "line_start").orderBy(F.col("issue_id").desc())
    last = fx.filter(F.col("line_start") > 0).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        "file_id", F.col("line_start").alias("ln"), "fixed_code")
    ln = lines.select("file_id", "ln", "line").join(last, ["file_id", "ln"], "left").select(
        "file_id", "ln", F.coalesce("fixed_code", "line").alias("text"), F.col("fixed_code").isNotNull().alias("changed"))
    return ln.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "text"))), lambda x: x["text"]), "\n").alias("content"),
        F.count_if("changed").alias("n_changed"))


def fix_report(fx: DataFrame) -> DataFrame:
    """total, needing review, by issue type (and 100-character previews in the rows)."""
    g = fx.groupingSets([["issue_type"], []], "issue_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("requires_review").alias("needs_review"), F.grouping("issue_type").alias("g"))
    return g.select(F.when(F.col("g") == 0, "by_issue_type").otherwise("total").alias("dimension"),
                    F.coalesce("issue_type", F.lit("all")).alias("key"), "n", "needs_review")


def refactorings(functions: DataFrame, fst: DataFrame) -> DataFrame:
    """Extract method (> 30 lines), parameter object (> 5 without self/cls), else-if chains, magic numbers."""
    base = functions.select("file_id", F.col("qualified_name").alias("function"), "name", "ln_start", "ln_end", "params")
    f06 = base.filter(F.col("ln_end") - F.col("ln_start") > 30).select(
        "file_id", "function", F.lit("extract_method").alias("suggestion_type"), F.col("ln_start").alias("ln"), F.lit("medium").alias("effort"))
    pos = F.filter("params", lambda p: ~p["name"].startswith("*") & ~p["name"].isin("self", "cls"))
    f07 = base.filter(F.size(pos) > 5).select(
        "file_id", "function", F.lit("parameter_object").alias("suggestion_type"), F.col("ln_start").alias("ln"), F.lit("high").alias("effort"))
    w = Window.partitionBy("file_id", "fn_ln", "indent").orderBy("ln")
    chain = fst.select("file_id", "fn_ln", "qualified_name", "kind", F.lag("ln").over(w).alias("prev_ln"),
                       F.lag("kind").over(w).alias("prev_kind"))
    f08 = chain.filter((F.col("kind") == "elif") & F.col("prev_kind").isin("if", "elif")).select(
        "file_id", F.col("qualified_name").alias("function"), F.lit("simplify_conditional").alias("suggestion_type"),
        F.col("prev_ln").alias("ln"), F.lit("low").alias("effort"))
    from lintlake.functions.patterns import NUMBER
    nums = fst.filter(F.col("kind") != "docstring").select(
        "file_id", F.col("qualified_name").alias("function"), "ln", F.explode(F.regexp_extract_all(F.coalesce("bare", F.lit("")), F.lit(NUMBER), 2)).alias("num"))
    f09 = nums.filter(~F.col("num").cast("double").isin(*[float(x) for x in MAGIC_ALLOWED])).select(
        "file_id", "function", F.lit("replace_magic_number").alias("suggestion_type"), "ln", F.lit("low").alias("effort"))
    out = f06.unionByName(f07).unionByName(f08).unionByName(f09)
    return out.withColumn("ln", F.col("ln").cast("bigint"))


def generated_tests(functions: DataFrame) -> DataFrame:
    """a unit row per function, edge rows per Optional / list parameter, a property row per list return."""
    f = functions.select("file_id", "name", F.col("qualified_name").alias("function"), "params", "return_type")
    unit = f.select("file_id", "function", F.concat(F.lit("test_"), F.col("name")).alias("test_name"), F.lit("unit").alias("test_type"))
    p = f.select("file_id", "function", "name", F.explode("params").alias("p")).filter(~F.col("p.name").isin("self", "cls"))
    hint = F.coalesce(F.col("p.type_hint"), F.lit(""))
    none = p.filter(hint.rlike(r"Optional|Union|\|")).select(
        "file_id", "function", F.concat(F.lit("test_"), F.col("name"), F.lit("_with_none_"), F.col("p.name")).alias("test_name"),
        F.lit("edge_case").alias("test_type"))
    empty = p.filter(hint.contains("List") | hint.contains("list")).select(
        "file_id", "function", F.concat(F.lit("test_"), F.col("name"), F.lit("_with_empty_"), F.col("p.name")).alias("test_name"),
        F.lit("edge_case").alias("test_type"))
    rt = F.coalesce(F.col("return_type"), F.lit(""))
    prop = f.filter(rt.contains("List") | rt.contains("list")).select(
        "file_id", "function", F.concat(F.lit("test_"), F.col("name"), F.lit("_returns_list")).alias("test_name"), F.lit("property").alias("test_type"))
    return unit.unionByName(none).unionByName(empty).unionByName(prop)
