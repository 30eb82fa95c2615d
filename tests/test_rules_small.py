"""Small hand-made sources with exact expected rows: one positive and one negative case per rule family."""

from pyspark.sql import functions as F

from lintlake.operators import contracts as C
from lintlake.operators import critics as CR
from lintlake.operators import graph as G
from lintlake.plans.substrate import Substrate


def _sub(spark, src):
    files = spark.createDataFrame([(1, "p/m.py", src)], "file_id long, path string, content string")
    return Substrate(files, materialize=False)


SECURITY = '''import os


def risky(request, cmd, cursor, user_input):
    os.system(cmd)
    query = "SELECT * FROM t WHERE a = '%s'" % user_input
    cursor.execute("SELECT 1 WHERE a = %s", (user_input,))
    page = "<b>" + request.args.get("q")
    return page


def safe(items):
    total = 0
    for item in items:
        total = total + item
    return total
'''


def test_security_critic(spark):
    sub = _sub(spark, SECURITY)
    got = {(r.function, r.issue_type, r.ln) for r in CR.security_issues(sub.fn_stmts, sub.calls).collect()}
    assert ("risky", "command_injection", 5) in got
    assert ("risky", "sql_injection", 6) in got
    assert ("risky", "xss", 8) in got
    assert not any(f == "safe" for f, _t, _l in got)
    assert ("risky", "sql_injection", 7) not in got  # parameterised


def test_performance_critic(spark):
    sub = _sub(spark, SECURITY)
    got = {(r.function, r.issue_type) for r in CR.performance_issues(sub.fn_stmts, sub.calls, sub.blocks).collect()}
    assert ("safe", "inefficient_string_concat") in got
    assert ("risky", "inefficient_string_concat") not in got


CONTRACTS = '''def divide(num, den):
    """Divide.

    Raises:
        ZeroDivisionError: when den is zero
        KeyError: never

    Preconditions:
        den is not zero
    """
    assert den != 0
    if den is None:
        raise TypeError("none")
    return num / den
'''


def test_contract_sections_and_violations(spark):
    sub = _sub(spark, CONTRACTS)
    items = C.contract_items(sub.lines, sub.functions, sub.fn_stmts)
    table = C.contract_table(sub.functions, items).collect()[0]
    assert table.raises == ["KeyError", "ZeroDivisionError"]
    assert "den is not zero" in table.pre and "den != 0" in table.pre
    assert table.raises_in_code == ["TypeError"]
    v = {(r.violation_type, r.exc) for r in C.violations(C.contract_table(sub.functions, items), items, sub.fn_stmts).collect()}
    assert ("undocumented_raise", "TypeError") in v
    assert ("unreachable_raise", "KeyError") in v
    assert ("undocumented_precondition", None) not in v


COUPLING = '''class A:
    def m(self):
        return 1


class B(A):
    def use(self, a: A) -> A:
        return A.m(a)


class C2:
    def run(self, b: B):
        return b
'''


def test_coupling_exact(spark):
    sub = _sub(spark, COUPLING)
    e = G.class_edges(sub.classes, sub.functions, sub.calls)
    assert {(r.src, r.dst) for r in e.collect()} == {("B", "A"), ("C2", "B")}
    cp = {r.name: (r.efferent, r.afferent, round(r.instability, 2)) for r in G.coupling(sub.classes, e).collect()}
    assert cp == {"A": (0, 1, 0.0), "B": (1, 1, 0.5), "C2": (1, 0, 1.0)}


def test_maintainability_names_and_numbers(spark):
    src = "def BadName(x, Y):\n    return x * 42 + Y * 7\n"
    sub = _sub(spark, src)
    got = [(r.issue_type, r.severity) for r in CR.maintainability_issues(sub.fn_stmts, sub.fn_metrics).collect()]
    assert got.count(("poor_naming", "low")) == 2  # function name and the capitalised parameter
    assert got.count(("magic_number", "low")) == 1  # 42 (7 is a small int)
    assert ("missing_docstring", "low") in got


def test_unused_imports(spark):
    src = "import os\nimport json as js\nfrom m import a, b\n\n\ndef f():\n    return os.sep + a\n"
    sub = _sub(spark, src)
    got = {r.module for r in G.unused_imports(sub.imports, sub.stmts).collect()}
    assert got == {"json"}
    assert sub.imports.filter(F.col("name") == "*").count() == 0
