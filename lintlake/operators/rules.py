"""Tier-2 rule registry over ``facts``.

A rule is a row of data: name, severity, category, title, confidence and a boolean
column expression over the fact row.  All rules run in one pass: an array of
conditional structs, compacted and exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIER2 = "tier2_heuristic"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    category: str
    title: str
    confidence: str
    when: Column
    evidence: Column


def _giant_reasons() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("loc") > 50, F.format_string("LOC: %d (threshold: 50)", F.col("loc"))),
        F.when(F.col("cyclomatic_complexity") > 10,
               F.format_string("Cyclomatic complexity: %d (threshold: 10)", F.col("cyclomatic_complexity"))),
    ))


# The rules with severity, category, title and confidence (plain data, no session needed).
META = [
    ("bare_except", "medium", "maintainability", "Bare except clause without exception type", "high"),
    ("mutable_defaults", "medium", "logic", "Mutable default argument detected", "high"),
    ("resource_leak", "medium", "maintainability", "File opened without context manager", "medium"),
    ("command_injection", "critical", "security", "Command injection risk via f-string in command execution", "high"),
    ("command_execution", "high", "security", "Command execution detected", "medium"),
    ("implicit_none_return", "medium", "logic", "Possible implicit None return with type annotation", "medium"),
    ("unreachable_code", "low", "maintainability", "Unreachable code detected", "medium"),
    ("giant_function", "medium", "maintainability", "Function exceeds size/complexity thresholds", "medium"),
    ("star_imports", "low", "maintainability", "Star import detected", "medium"),
    ("broad_exception", "medium", "maintainability", "Broad exception catch detected", "high"),
    ("shadow_builtin", "low", "maintainability", "Parameter shadows Python builtin", "high"),
]


def registry() -> list[Rule]:
    """The rules of ``META`` with their condition and evidence columns."""
    c = F.col
    cmd = F.filter("calls", lambda x: x.isin("os.system", "subprocess.call", "subprocess.run", "subprocess.Popen", "os.popen"))
    broad = F.array_intersect(c("caught_types"), F.array(F.lit("Exception"), F.lit("BaseException")))
    return [
        Rule("bare_except", "medium", "maintainability", "Bare except clause without exception type", "high",
             c("has_bare_except"), F.array(F.format_string("bare except in function at line %d", c("line_start")))),
        Rule("mutable_defaults", "medium", "logic", "Mutable default argument detected", "high",
             c("has_mutable_default_args"),
             F.transform(F.filter("params", lambda p: p["default_is_mutable"]), lambda p: p["name"])),
        Rule("resource_leak", "medium", "maintainability", "File opened without context manager", "medium",
             c("uses_open_without_with"), F.array(F.lit("open() called outside a with statement"))),
        Rule("command_injection", "critical", "security", "Command injection risk via f-string in command execution",
             "high", c("uses_command_execution") & c("command_execution_has_fstring"), cmd),
        Rule("command_execution", "high", "security", "Command execution detected", "medium",
             c("uses_command_execution") & ~c("command_execution_has_fstring"), cmd),
        Rule("implicit_none_return", "medium", "logic", "Possible implicit None return with type annotation", "medium",
             c("return_annotation").isNotNull() & ~c("has_return_on_all_paths"),
             F.array(F.format_string("return annotation: %s", c("return_annotation")))),
        Rule("unreachable_code", "low", "maintainability", "Unreachable code detected", "medium",
             c("has_unreachable_code"), F.array(F.lit("statement after return or raise in the same block"))),
        Rule("giant_function", "medium", "maintainability", "Function exceeds size/complexity thresholds", "medium",
             F.size(_giant_reasons()) > 0, _giant_reasons()),
        Rule("star_imports", "low", "maintainability", "Star import detected", "medium",
             c("star_imports_used"), F.array(F.lit("module uses 'from x import *'"))),
        Rule("broad_exception", "medium", "maintainability", "Broad exception catch detected", "high",
             c("has_broad_except"), broad),
        Rule("shadow_builtin", "low", "maintainability", "Parameter shadows Python builtin", "high",
             F.size("shadows_builtin") > 0, c("shadows_builtin")),
    ]


def run_rules(facts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All rules over ``facts`` in one projection -> long ``findings`` table."""
    rules = rules or registry()
    structs = [
        F.when(r.when, F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
            F.lit(r.title).alias("title"), F.lit(r.confidence).alias("confidence"), r.evidence.alias("evidence"),
        ))
        for r in rules
    ]
    out = facts.select("file_id", "function_name", "qualified_name", "line_start",
                       F.explode(F.array_compact(F.array(*structs))).alias("f"))
    return out.select(
        "file_id", "qualified_name",
        F.concat_ws(":", "qualified_name", "f.rule").alias("issue_id"),
        "f.rule", "f.severity", "f.category", "f.title",
        F.concat_ws(":", F.col("function_name"), F.col("line_start").cast("string")).alias("location"),
        F.col("line_start").cast("bigint").alias("ln"),
        F.lit(TIER2).alias("tier"), "f.confidence", "f.evidence",
    )
