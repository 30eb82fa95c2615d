"""Hand-made corpora with exact expected rows for the line/block substrate and rules."""

from pyspark.sql import functions as F

from lintlake.plans.substrate import Substrate

SRC = '''import os


def outer(a, b=[]):
    """Doc line.

    Raises:
        ValueError: bad
    """
    if a:
        for x in b:
            while x:
                x -= 1
    else:
        return 1
    try:
        os.system(a)
    except:
        pass
    return 2


class K(Base):
    def m(self):
        return self.v
'''


def _sub(spark, src=SRC):
    files = spark.createDataFrame([(1, "p/m.py", src)], "file_id long, path string, content string")
    return Substrate(files, materialize=False)


def test_block_ends(spark):
    b = {r.ln: (r.kind, r.ln_end) for r in _sub(spark).blocks.collect()}
    assert b[4] == ("def", 20)
    assert b[10] == ("if", 13)
    assert b[11] == ("for", 13)
    assert b[12] == ("while", 13)
    assert b[14] == ("else", 15)
    assert b[16] == ("try", 17)
    assert b[18] == ("except", 19)
    assert b[23] == ("class", 25)


def test_functions_and_classes(spark):
    sub = _sub(spark)
    f = {r.qualified_name: r for r in sub.functions.collect()}
    assert set(f) == {"outer", "K.m"}
    assert f["outer"].docstring.startswith("Doc line.")
    assert [p.name for p in f["outer"].params] == ["a", "b"]
    assert f["outer"].params[1].default_is_mutable
    c = sub.classes.collect()[0]
    assert (c.name, c.bases, c.methods) == ("K", ["Base"], ["m"])


def test_nesting_and_complexity(spark):
    m = {r.qualified_name: r for r in _sub(spark).fn_metrics.collect()}
    # if > for > while: three levels, deepest at the while line.
    assert m["outer"].max_nesting == 3 and m["outer"].nesting_ln == 12
    # 1 + if + for + while + except
    assert m["outer"].cyclomatic == 5


def test_rules_positive_and_negative(spark):
    from lintlake.operators import rules as R

    found = {(r.qualified_name, r.rule) for r in R.run_rules(_sub(spark).facts).collect()}
    assert ("outer", "bare_except") in found
    assert ("outer", "mutable_defaults") in found
    assert ("outer", "command_execution") in found
    assert ("K.m", "bare_except") not in found


def test_unreachable_and_linear_containment(spark):
    src = "def f(x):\n    if x:\n        return 1\n        print(x)\n    return 2\n"
    facts = _sub(spark, src).facts.collect()[0]
    assert facts.has_unreachable_code


def test_blank_and_comment_counts(spark):
    ln = _sub(spark).lines
    row = ln.agg(F.count_if("is_blank").alias("b"), F.count_if("is_content").alias("c")).first()
    parts = SRC.split("\n")
    blanks = sum(1 for x in parts if not x.strip())
    assert row.b == blanks and row.c == len(parts) - blanks
