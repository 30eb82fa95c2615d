"""A rule registry over the lines of real texts: findings with evidence, gates, reports and line repair.

Each rule is one named pattern with category, severity, advice and (optionally) a replacement.  All rules are evaluated in
one pass over the lines, as column expressions; a line is never shuffled, only its findings are.  A rule may name plain
strings of which every match holds one (``any_of``): texts and lines without them are not searched by the pattern at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    severity: str
    pattern: str
    advice: str
    replacement: str | None = None
    any_of: tuple[str, ...] = ()

    def possible(self, text: Column) -> Column:
        """A cheap test that every text with a match passes."""
        found = [F.contains(text, F.lit(x)) for x in self.any_of]
        return reduce(lambda a, b: a | b, found) if found else text.rlike(self.pattern)

    def matches(self, text: Column) -> Column:
        return self.possible(text) & text.rlike(self.pattern) if self.any_of else text.rlike(self.pattern)


RULES = (
    Rule("secret", "security", "critical", r'(token|secret|password|api_key) = "[^"]*"', "revoke it and remove it from the text", r'$1 = "[secret]"', (' = "',)),
    Rule("email", "privacy", "high", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][A-Za-z]+", "mask the address", "[email]", ("@",)),
    Rule("long_number", "privacy", "high", r"[0-9]{13,19}", "mask the number", "[number]"),
    Rule("ip_address", "privacy", "medium", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "mask the address", "[ip]"),
    Rule("junk_marks", "quality", "medium", r"(###|%%%|[$][$][$]|[*][*][*]|&&&)", "drop the marks", "", ("###", "%%%", "$$$", "***", "&&&")),
    Rule("license_line", "legal", "low", r"[Ll]icen[sc]e", "check the terms", None, ("icen",)),
)
SEVERITIES = ("critical", "high", "medium", "low")
WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}


def by_severity(values: dict[str, int], column: str = "severity") -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def findings(texts: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, line_no, rule, category, severity, matches, evidence, advice): one row per line and rule that matches."""
    some = reduce(lambda x, y: x | y, [r.possible(F.col(text)) for r in rules])
    ln = lines(texts.filter(some), key, text)
    hit = F.array_compact(F.array(*[F.when(r.matches(F.col("line")), F.lit(i)) for i, r in enumerate(rules)]))
    each = ln.select(key, "line_no", "line", F.explode(hit).alias("i"))
    # Only what matched is searched again, for the matches themselves.
    of = lambda field: F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("i") + 1)
    each = each.select(key, "line_no", *[of(x).alias(y) for x, y in (("name", "rule"), ("category", "category"), ("severity", "severity"), ("advice", "advice"))],
                       F.regexp_extract_all("line", of("pattern"), F.lit(0)).alias("m"))
    return each.select(key, "line_no", "rule", "category", "severity", F.size("m").cast("long").alias("matches"), F.element_at("m", 1).alias("evidence"), "advice")


def summary(f: DataFrame, key: str) -> DataFrame:
    """Findings and texts per category and severity."""
    return f.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("findings"), F.sum("matches").alias("matches"), F.count_distinct(key).alias("texts"))


def reports(texts: DataFrame, f: DataFrame, key: str, max_high: int = 1) -> DataFrame:
    """One row per text: counts by severity, weighted score, worst severity, and the gate (nothing critical, few high)."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    per = f.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *counts, F.sum(by_severity(WEIGHTS)).alias("score"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", *SEVERITIES, "score")]
    out = texts.select(key).join(per, key, "left").select(key, *zero)
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in SEVERITIES], F.lit("none"))
    return out.withColumn("worst", worst).withColumn("passed", (F.col("critical") == 0) & (F.col("high") <= max_high))


def ordered(f: DataFrame, key: str) -> DataFrame:
    """Findings of every text, worst first, with their rank."""
    order = by_severity({s: i for i, s in enumerate(SEVERITIES)})
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, "line_no", "rule"))
    return f.withColumn("rank", rank.cast("long"))


def repaired(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every rule's replacement applied in registry order (a later rule sees what earlier ones left)."""
    for r in rules:
        if r.replacement is not None:
            new = F.regexp_replace(text, r.pattern, r.replacement)
            text = F.when(r.possible(text), new).otherwise(text) if r.any_of else new
    return text


def fix_rows(texts: DataFrame, key: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, line_no, seq, rule, original, fixed, confidence, review): one row per line and rule with a replacement.

    ``seq`` is the rule's place in the registry: the order in which fixes are listed.  Masks are certain, dropped marks are for review.
    """
    ours = [(i, r) for i, r in enumerate(rules) if r.replacement is not None]
    some = reduce(lambda x, y: x | y, [r.possible(F.col(text)) for _, r in ours])
    made = [F.when(r.matches(F.col("line")), F.struct(F.lit(i).alias("seq"), F.lit(r.name).alias("rule"), F.col("line").alias("original"), F.regexp_replace("line", r.pattern, r.replacement).alias("fixed"),
                                                      F.lit(0.9 if r.replacement else 0.6).alias("confidence"), F.lit(not r.replacement).alias("review"))) for i, r in ours]
    return lines(texts.filter(some), key, text).select(key, "line_no", F.inline(F.array_compact(F.array(*made))))


def patched(texts: DataFrame, fixes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``texts`` with the lines of ``fixes`` (key, line_no, seq, fixed) replaced, and ``applied``, the number of lines changed by a fix.

    The fix listed last (largest ``seq``, then largest text) wins a line; lines that the text does not have, line 0 among
    them, and null lines or fixes are dropped.  Texts are not cut into rows: a text's fixes meet it as one map.
    """
    last = fixes.filter("line_no > 0 AND fixed IS NOT NULL").groupBy(key, "line_no").agg(F.max(F.struct("seq", "fixed"))["fixed"].alias("fixed"))
    per = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("line_no").cast("int").alias("k"), F.col("fixed").alias("v")))).alias("fixes"))
    j = texts.join(per, key, "left")
    old = F.split(F.col(text), "\n")
    new = F.transform(old, lambda x, i: F.coalesce(F.col("fixes")[i + 1], x))
    applied = F.coalesce(F.size(F.filter(F.map_keys("fixes"), lambda k: k <= F.size(old))), F.lit(0))
    out = [F.when(F.col("fixes").isNull(), F.col(text)).otherwise(F.array_join(new, "\n")).alias(c) if c == text else F.col(c) for c in texts.columns]
    return j.select(*out, applied.cast("long").alias("applied"))
