"""Queries for function facts (X06-X16) and tier-2 rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import facts as FX
from lintlake.operators import structure as S
from lintlake.operators import rules as R
from lintlake.plans.catalog import code_query
from lintlake.plans.oracle import with_base, with_facts
from lintlake.plans.substrate import for_corpus


def _j(col):
    return F.array_join(col, ",")


@code_query("x06_parameters", with_base("""
SELECT file_id, qualified_name, CAST(pos AS BIGINT) AS pos, name, type_hint, has_default, default_is_mutable FROM params
"""))
def x06_parameters(spark, sf_dir):
    fn = for_corpus(spark, sf_dir).functions
    p = fn.select("file_id", "qualified_name", F.posexplode("params").alias("pos", "p"))
    return p.select("file_id", "qualified_name", (F.col("pos") + 1).cast("bigint").alias("pos"), "p.name", "p.type_hint",
                    "p.has_default", "p.default_is_mutable")


@code_query("x07_handlers", with_facts("""
SELECT file_id, qualified_name, has_bare_except, has_broad_except, caught_types FROM ffacts
"""))
def x07_handlers(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.select("file_id", "qualified_name", "has_bare_except", "has_broad_except", _j("caught_types").alias("caught_types"))


@code_query("x08_raises", with_facts("SELECT file_id, qualified_name, raise_types FROM ffacts"))
def x08_raises(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.select("file_id", "qualified_name", _j("raise_types").alias("raise_types"))


@code_query("x09_calls", with_facts("SELECT file_id, qualified_name, calls FROM ffacts"))
def x09_calls(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.select("file_id", "qualified_name", _j("calls").alias("calls"))


@code_query("x10_checks", with_facts("SELECT file_id, qualified_name, none_checks, type_checks FROM ffacts"))
def x10_checks(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.select("file_id", "qualified_name", _j("has_none_checks").alias("none_checks"),
                    _j("has_type_checks").alias("type_checks"))


@code_query("x11_call_flags", with_facts("""
SELECT file_id, qualified_name, uses_open_without_with, uses_command_execution, command_execution_has_fstring FROM ffacts
"""))
def x11_call_flags(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.select("file_id", "qualified_name", "uses_open_without_with", "uses_command_execution",
                    "command_execution_has_fstring")


@code_query("x12_unreachable", with_facts("SELECT file_id, qualified_name FROM ffacts WHERE has_unreachable_code"))
def x12_unreachable(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.filter("has_unreachable_code").select("file_id", "qualified_name")


@code_query("x13_shadow_builtins", with_facts("SELECT file_id, qualified_name, shadows_builtin FROM ffacts WHERE shadows_builtin <> ''"))
def x13_shadow_builtins(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.filter(F.size("shadows_builtin") > 0).select("file_id", "qualified_name", _j("shadows_builtin").alias("shadows_builtin"))


@code_query("x14_facts", with_facts("""
SELECT file_id, qualified_name, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end,
       class_name IS NOT NULL AS is_method, return_annotation, CAST(loc AS BIGINT) AS loc,
       cyclomatic AS cyclomatic_complexity, has_mutable_default_args, has_return_on_all_paths, star_imports_used
FROM ffacts
"""))
def x14_facts(spark, sf_dir):
    f = for_corpus(spark, sf_dir).facts
    return f.select("file_id", "qualified_name", F.col("line_start").cast("bigint").alias("line_start"),
                    F.col("line_end").cast("bigint").alias("line_end"), "is_method", "return_annotation",
                    F.col("loc").cast("bigint").alias("loc"), "cyclomatic_complexity", "has_mutable_default_args",
                    "has_return_on_all_paths", "star_imports_used")


@code_query("x15_function_source", with_base("""
SELECT f.file_id, f.qualified_name, string_agg(l.line, chr(10) ORDER BY l.ln) AS source
FROM functions f JOIN lines l ON l.file_id = f.file_id AND l.ln BETWEEN f.ln_start AND f.ln_end
WHERE f.ln_start = (SELECT min(g.ln_start) FROM functions g WHERE g.file_id = f.file_id AND g.name = f.name)
GROUP BY f.file_id, f.qualified_name
"""))
def x15_function_source(spark, sf_dir):
    """Source slice of each function's line range; the first function of a name per file."""
    sub = for_corpus(spark, sf_dir)
    first = sub.functions.groupBy("file_id", "name").agg(
        F.min_by(F.struct("ln_start", "ln_end", "qualified_name"), "ln_start").alias("f"))
    spans = first.select("file_id", F.col("f.ln_start").alias("ln"), F.col("f.ln_end").alias("ln_end"),
                         F.col("f.qualified_name").alias("qualified_name"))
    member = S.owner(sub.lines.select("file_id", "ln", "line"), spans)
    return member.groupBy("file_id", F.col("o.qualified_name").alias("qualified_name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("source"))


@code_query("x16_used_names", with_base("""
SELECT DISTINCT file_id, unnest(regexp_extract_all(coalesce(bare, ''), '[A-Za-z_][A-Za-z0-9_]*', 0)) AS name
FROM stmts WHERE kind NOT IN ('import', 'from')
"""))
def x16_used_names(spark, sf_dir):
    return FX.used_names(for_corpus(spark, sf_dir).stmts)


# --- tier-2 rules ----------------------------------------------------------

_RULE_SQL = {
    "bare_except": "has_bare_except",
    "mutable_defaults": "has_mutable_default_args",
    "resource_leak": "uses_open_without_with",
    "command_injection": "uses_command_execution AND command_execution_has_fstring",
    "command_execution": "uses_command_execution AND NOT command_execution_has_fstring",
    "implicit_none_return": "return_annotation IS NOT NULL AND NOT has_return_on_all_paths",
    "unreachable_code": "has_unreachable_code",
    "giant_function": "loc > 50 OR cyclomatic > 10",
    "star_imports": "star_imports_used",
    "broad_exception": "has_broad_except",
    "shadow_builtin": "shadows_builtin <> ''",
}


def _rules_sql(only: str | None = None) -> str:
    parts = []
    for name, severity, category, title, confidence in R.META:
        if only and name != only:
            continue
        title = title.replace("'", "''")
        parts.append(
            f"SELECT file_id, qualified_name, qualified_name || ':{name}' AS issue_id, '{name}' AS rule, "
            f"'{severity}' AS severity, '{category}' AS category, '{title}' AS title, "
            f"function_name || ':' || CAST(line_start AS VARCHAR) AS location, CAST(line_start AS BIGINT) AS ln, "
            f"'{R.TIER2}' AS tier, '{confidence}' AS confidence FROM ffacts WHERE {_RULE_SQL[name]}")
    return "\nUNION ALL\n".join(parts)


def _findings(spark, sf_dir):
    return R.run_rules(for_corpus(spark, sf_dir).facts).drop("evidence")


@code_query("t11_all_rules", with_facts(_rules_sql()))
def t11_all_rules(spark, sf_dir):
    """Every rule over every function in one pass."""
    return _findings(spark, sf_dir)


def _register_rule(tid: str, rule: str):
    @code_query(f"{tid}_{rule}", with_facts(_rules_sql(rule)))
    def _q(spark, sf_dir):
        return _findings(spark, sf_dir).filter(F.col("rule") == rule)

    _q.__name__ = f"{tid}_{rule}"
    return _q


for _tid, _rule in [("t01", "bare_except"), ("t02", "mutable_defaults"), ("t03", "resource_leak"),
                    ("t04", "command_injection"), ("t04", "command_execution"), ("t05", "implicit_none_return"),
                    ("t06", "unreachable_code"), ("t07", "giant_function"), ("t08", "star_imports"),
                    ("t09", "broad_exception"), ("t10", "shadow_builtin")]:
    _register_rule(_tid, _rule)
