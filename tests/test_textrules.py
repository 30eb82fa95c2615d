"""Guards that change nothing, fix rows and line patches against plain loops."""

import random
import re

from lintlake.operators import textrules as T

LINES = ['token = "abc" and a@b.cd', "mail me: x.y@z.org, q@r.st", "4111111111111111 at 10.0.0.1", "### sale ***", "plain", "", "License: free", "licence", "@ alone", 'x = "y"', "1.2.3", "é@é.fr"]


def texts(spark, seed=1, n=40):
    rnd = random.Random(seed)
    rows = [(i, "\n".join(rnd.choice(LINES) for _ in range(rnd.randint(1, 6)))) for i in range(n)] + [(100, None), (101, ""), (102, "plain\nplain")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_findings_equal_a_plain_search(spark):
    rows, df = texts(spark)
    want = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            for r in T.RULES:
                m = [x[0] for x in re.finditer(r.pattern, line)]
                if m:
                    want.append((i, k + 1, r.name, r.severity, len(m), m[0], r.advice))
    got = [(r["doc_id"], r["line_no"], r["rule"], r["severity"], r["matches"], r["evidence"], r["advice"]) for r in T.findings(df, "doc_id").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def fixed(rule, line):
    return re.sub(rule.pattern, rule.replacement.replace("$1", r"\1"), line)


def test_fix_rows_and_patch_equal_a_plain_loop(spark):
    rows, df = texts(spark, seed=2)
    fixes = T.fix_rows(df, "doc_id")
    want = [(i, k + 1, n, line, fixed(r, line)) for i, text in rows if text is not None for k, line in enumerate(text.split("\n")) for n, r in enumerate(T.RULES) if r.replacement is not None and re.search(r.pattern, line)]
    assert sorted((r["doc_id"], r["line_no"], r["seq"], r["original"], r["fixed"]) for r in fixes.collect()) == sorted(want)
    out = {}
    for i, text in rows:
        lines, hit = (text or "").split("\n"), set()
        for d, k, _, _, new in sorted(want):
            if d == i:
                lines[k - 1] = new
                hit.add(k)
        out[i] = (None if text is None else "\n".join(lines), len(hit))
    assert {r["doc_id"]: (r["text"], r["applied"]) for r in T.patched(df, fixes, "doc_id").collect()} == out


def test_the_last_fix_wins_and_lines_that_are_not_there_are_dropped(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7), (2, "x", 8), (3, None, 9)], "doc_id long, text string, extra int")
    fixes = spark.createDataFrame([(1, 2, 0, "first"), (1, 2, 3, "last"), (1, 2, 1, "middle"), (1, 0, 9, "zero"), (1, 4, 9, "beyond"), (1, -1, 9, "negative"), (1, 3, 5, None), (3, 1, 1, "null text"), (4, 1, 1, "no text"), (None, 1, 1, "no id")],
                                  "doc_id long, line_no long, seq int, fixed string")
    got = {r["doc_id"]: (r["text"], r["extra"], r["applied"]) for r in T.patched(df, fixes, "doc_id").collect()}
    assert got[1] == ("a\nlast\nc", 7, 1) and got[2] == ("x", 8, 0) and got[3][0] is None
    assert T.patched(df, fixes.limit(0), "doc_id").filter("applied > 0").count() == 0
