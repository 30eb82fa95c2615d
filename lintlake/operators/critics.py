"""The four critics (L, V, P, Q rows): each rule is one query over the function tables.

Every critic returns the same issue shape
``(file_id, function, issue_type, ln, severity, category)`` so R01 is a plain union.
Semantics are the intended per-function ones (facts gathered inside the function).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import patterns as P

# Substrings that make an expression look like user input.
USER_INPUT = ["request.", "input", "form.", "args.", "params.", "query", "body", "user", "data", "json", "xml", "html"]
# SQL keywords for the format-string check.
SQL_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "EXECUTE"]
# Command-execution call names matched by substring.
DANGEROUS_CALLS = ["system", "popen", "subprocess.run", "subprocess.call", "subprocess.Popen", "os.system", "os.popen"]
# Database-like call words and receivers.
DB_CALL_WORDS = ["execute", "fetch", "query", "select", "find", "get"]
DB_RECEIVERS = ["cursor", "db", "database", "session", "conn", "model"]
# Resource-opening calls.
RESOURCE_CALLS = ["urllib.open", "urlopen", "socket.socket", "connect("]
# Allowed numbers and one-letter names (Q05, Q06).
ALLOWED_NUMBERS = [0, 1, -1, 2, 100, 1000]
ONE_LETTER_OK = ["_", "x", "y", "z", "i", "j", "k"]

FREE_NAME = r"(^|[^A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)"
ATTR_BASE = r"(^|[^A-Za-z0-9_.])([A-Za-z_][A-Za-z0-9_]*)\.[A-Za-z_]"
DIVISOR = r"//?\s*([A-Za-z_][A-Za-z0-9_]*)\s*($|[^A-Za-z0-9_.(\[])"
SUBSCRIPT = r"[A-Za-z0-9_)\]]\[([^\[\]]*)\]"
COMPARE = r"==|!=|<=|>=|<|>|\bis\b|\bin\b"
SIMPLE_TARGET = r"^([A-Za-z_][A-Za-z0-9_]*)\s*(:[^=]+)?=[^=]"
CALL_ARGS = r"\((.*)\)"
GOOD_NAME = r"^[a-z][a-z0-9_]*$"


def user_like(col: Column) -> Column:
    """Case-insensitive substring test against the user-input list."""
    low = F.lower(col)
    out = F.lit(False)
    for p in USER_INPUT:
        out = out | low.contains(p)
    return out


def _issue(df: DataFrame, issue_type, ln, severity: str, category: str) -> DataFrame:
    it = issue_type if isinstance(issue_type, Column) else F.lit(issue_type)
    return df.select(
        "file_id", F.col("qualified_name").alias("function"), it.alias("issue_type"),
        ln.cast("bigint").alias("ln"), F.lit(severity).alias("severity"), F.lit(category).alias("category"),
    )


def _bare() -> Column:
    return F.coalesce(F.col("bare"), F.lit(""))


def _none_checked(fst: DataFrame) -> DataFrame:
    from lintlake.operators.facts import NONE_CHECK
    return fst.select("file_id", "fn_ln", F.explode(F.regexp_extract_all(_bare(), F.lit(NONE_CHECK), 2)).alias("var")).distinct()


# --- logic -------------------------------------------------------------------

def logic_issues(fst: DataFrame, functions: DataFrame) -> DataFrame:
    fst = fst.filter(F.col("kind") != "docstring")
    checked = _none_checked(fst)
    names = fst.select("file_id", "fn_ln", "qualified_name", "ln",
                       F.explode(F.regexp_extract_all(_bare(), F.lit(FREE_NAME), 2)).alias("var"),
                       _bare().rlike(COMPARE).alias("is_cmp")).distinct()
    # Optional / Union / bar-typed parameter used before its first comparison.
    opt = functions.select("file_id", F.col("ln_start").alias("fn_ln"), F.explode("params").alias("p")).filter(
        F.col("p.type_hint").rlike(r"Optional|Union|\|")).select("file_id", "fn_ln", F.col("p.name").alias("var"))
    firsts = names.join(opt, ["file_id", "fn_ln", "var"], "left_semi").groupBy("file_id", "fn_ln", "qualified_name", "var").agg(
        F.min("ln").alias("first_use"), F.min(F.when(F.col("is_cmp"), F.col("ln"))).alias("first_check"))
    l01 = _issue(firsts.filter(F.col("first_check") > F.col("first_use")), "missing_precondition_check",
                 F.col("first_use"), "medium", "logic")
    # Attribute access on a variable assigned in the function and never None-checked.
    assigned = fst.filter(F.col("kind") == "assign").select(
        "file_id", "fn_ln", F.regexp_extract("code", SIMPLE_TARGET, 1).alias("var")).filter(F.col("var") != "").distinct()
    access = fst.select("file_id", "fn_ln", "qualified_name", "ln",
                        F.explode(F.regexp_extract_all(_bare(), F.lit(ATTR_BASE), 2)).alias("var")).distinct()
    l02 = access.join(assigned, ["file_id", "fn_ln", "var"], "left_semi").join(checked, ["file_id", "fn_ln", "var"], "left_anti")
    l02 = _issue(l02, "potential_none_dereference", F.col("ln"), "low", "logic")
    # Division by a plain name that is never None-checked.
    div = fst.select("file_id", "fn_ln", "qualified_name", "ln",
                     F.explode(F.regexp_extract_all(_bare(), F.lit(DIVISOR), 1)).alias("var")).distinct()
    l03 = _issue(div.join(checked, ["file_id", "fn_ln", "var"], "left_anti"), "division_by_zero_risk", F.col("ln"), "medium", "logic")
    # Plain-name index not None-checked; slice without a step.
    sub = fst.select("file_id", "fn_ln", "qualified_name", "ln",
                     F.explode(F.regexp_extract_all(_bare(), F.lit(SUBSCRIPT), 1)).alias("inner"))
    idx = sub.filter(F.col("inner").rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*$")).select(
        "file_id", "fn_ln", "qualified_name", "ln", F.trim("inner").alias("var"))
    l04a = _issue(idx.join(checked, ["file_id", "fn_ln", "var"], "left_anti").distinct(), "array_index_risk", F.col("ln"), "low", "logic")
    slices = sub.filter(F.col("inner").contains(":") & ~F.col("inner").rlike(":.*:"))
    l04b = _issue(slices, "slice_risk", F.col("ln"), "low", "logic")
    # Top-level statement after a top-level return.
    top = fst.filter(F.col("parent_ln") == F.col("fn_ln"))
    w = Window.partitionBy("file_id", "fn_ln").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("after_return", F.max(F.when(F.col("kind") == "return", 1).otherwise(0)).over(w))
    l05 = _issue(top.filter((F.col("after_return") == 1) & ~F.col("kind").isin("def", "class", "decorator")),
                 "unreachable_code", F.col("ln"), "low", "logic")
    # More than one return.
    l07 = fst.groupBy("file_id", "fn_ln", "qualified_name").agg(F.count_if(F.col("kind") == "return").alias("n")).filter("n > 1")
    l07 = _issue(l07, "multiple_return_paths", F.col("fn_ln"), "low", "logic")
    return l01.unionByName(l02).unionByName(l03).unionByName(l04a).unionByName(l04b).unionByName(l05).unionByName(l07)


def precondition_checks(fst: DataFrame, functions: DataFrame) -> DataFrame:
    """Each positional parameter and whether an ``if`` among the first five body statements tests it."""
    top = fst.filter(F.col("parent_ln") == F.col("fn_ln"))
    w = Window.partitionBy("file_id", "fn_ln").orderBy("ln")
    first5 = top.withColumn("rn", F.row_number().over(w)).filter((F.col("rn") <= 5) & (F.col("kind") == "if"))
    tested = first5.select("file_id", "fn_ln", F.explode(F.regexp_extract_all(_bare(), F.lit(FREE_NAME), 2)).alias("parameter")).distinct()
    params = functions.select("file_id", "qualified_name", F.col("ln_start").alias("fn_ln"), F.explode("params").alias("p")).filter(
        ~F.col("p.name").startswith("*")).select("file_id", "qualified_name", "fn_ln", F.col("p.name").alias("parameter"))
    return params.join(tested.withColumn("hit", F.lit(True)), ["file_id", "fn_ln", "parameter"], "left").select(
        "file_id", F.col("qualified_name").alias("function"), "parameter", F.coalesce("hit", F.lit(False)).alias("is_checked"))


# --- security -----------------------------------------------------------------

def security_issues(fst: DataFrame, calls: DataFrame) -> DataFrame:
    code = F.col("code")
    # V01a: "%"-formatted SQL text with user-like right side.
    fmt = fst.select("file_id", "qualified_name", "ln",
                     F.regexp_extract(code, r"(\"[^\"]*\"|'[^']*')\s*%\s*(.+)$", 1).alias("left"),
                     F.regexp_extract(code, r"(\"[^\"]*\"|'[^']*')\s*%\s*(.+)$", 2).alias("right"))
    has_sql = F.lit(False)
    for kw in SQL_KEYWORDS:
        has_sql = has_sql | F.lower("left").contains(kw.lower())
    v01a = _issue(fmt.filter((F.col("left") != "") & has_sql & user_like(F.col("right"))), "sql_injection", F.col("ln"), "critical", "security")
    # execute(...) not parameterized, with a user-like argument.
    ex = calls.filter(F.lower("call").contains("execute")).select(
        "file_id", "qualified_name", "ln", F.regexp_extract("code", r"execute\s*\((.*)\)", 1).alias("args")).distinct()
    param = F.col("args").rlike(r"^[^,]+,\s*[(\[]")
    v01b = _issue(ex.filter(~param & user_like(F.col("args"))), "sql_injection", F.col("ln"), "critical", "security")
    # Command call with a user-like or plain-variable argument.
    is_cmd = F.lit(False)
    for d in DANGEROUS_CALLS:
        is_cmd = is_cmd | F.col("call").contains(d)
    cm = calls.filter(is_cmd).select("file_id", "qualified_name", "ln", "call",
                                     F.split(F.regexp_extract("code", CALL_ARGS, 1), ",").alias("args"))
    bad_arg = F.exists("args", lambda a: user_like(a) | a.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_.]*\s*$"))
    v02 = _issue(cm.filter(bad_arg).select("file_id", "qualified_name", "ln").distinct(), "command_injection", F.col("ln"), "critical", "security")
    # Markup text concatenated with user-like data.
    xs = fst.select("file_id", "qualified_name", "ln",
                    F.regexp_extract(code, r"[\"'][^\"']*<[^\"']*>[^\"']*[\"']\s*\+\s*(.+)$", 1).alias("right"))
    v03 = _issue(xs.filter((F.col("right") != "") & user_like(F.col("right"))), "xss", F.col("ln"), "high", "security")
    # Path built from user-like data.
    pj = calls.filter(F.col("call").contains("os.path.join")).select(
        "file_id", "qualified_name", "ln", F.regexp_extract("code", r"os\.path\.join\s*\((.*)\)", 1).alias("args")).distinct()
    v04 = _issue(pj.filter(user_like(F.col("args"))), "path_traversal", F.col("ln"), "medium", "security")
    return v01a.unionByName(v01b).unionByName(v02).unionByName(v03).unionByName(v04)


# --- performance ----------------------------------------------------------------

def performance_issues(fst: DataFrame, calls: DataFrame, blocks: DataFrame) -> DataFrame:
    from lintlake.operators.structure import enclosing
    low = F.lower("call")
    word = F.lit(False)
    for w_ in DB_CALL_WORDS:
        word = word | low.contains(w_)
    recv = F.lit(False)
    for r in DB_RECEIVERS:
        recv = recv | low.contains(r)
    loopish = calls.join(fst.select("file_id", "ln", "in_loop", "in_for", "in_with"), ["file_id", "ln"])
    p01 = _issue(loopish.filter((F.col("in_loop") | F.col("kind").isin("for", "while")) & word & recv)
                 .select("file_id", "qualified_name", "ln").distinct(), "n_plus_1_queries", F.col("ln"), "high", "performance")
    # A for loop containing another loop; reported at the first inner loop line.
    loops = fst.filter(F.col("kind").isin("for", "while")).select("file_id", "ln", "indent", "qualified_name")
    fors = blocks.filter(F.col("kind") == "for").select("file_id", "ln", "ln_end", "indent")
    inner = enclosing(loops, fors).groupBy("file_id", F.col("b.ln").alias("outer_ln")).agg(
        F.min("ln").alias("inner_ln"), F.first("qualified_name").alias("qualified_name"))
    p02 = _issue(inner, "o_n_squared", F.col("inner_ln"), "medium", "performance")
    # insert(0, ...) inside a for loop.
    p03 = _issue(loopish.filter(F.col("in_for") & F.col("call").contains("insert") & F.col("code").rlike(r"insert\s*\(\s*0\s*[,)]"))
                 .select("file_id", "qualified_name", "ln").distinct(), "inefficient_list_operation", F.col("ln"), "medium", "performance")
    # Open / connection calls outside any with statement.
    res = (F.col("call") == "open") | F.col("call").endswith(".open")
    for r in RESOURCE_CALLS:
        res = res | F.concat(F.col("call"), F.lit("(")).contains(r)
    p04 = _issue(loopish.filter(res & (F.col("kind") != "with") & ~F.col("in_with")), "resource_leak_risk", F.col("ln"), "medium", "performance")
    # Top-level if whose body returns while its else branch never does.
    sib = fst.filter(F.col("parent_ln") == F.col("fn_ln"))
    ws = Window.partitionBy("file_id", "fn_ln").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    sib = sib.withColumn("chain", F.sum(F.when(F.col("kind").isin("elif", "else"), 0).otherwise(1)).over(ws))
    heads = sib.filter(F.col("kind") == "if").select("file_id", "fn_ln", "chain", "qualified_name", F.col("ln").alias("if_ln"))
    rest = sib.filter(F.col("kind").isin("elif", "else")).select("file_id", "fn_ln", "chain", F.col("ln").alias("b_ln"))
    rets = fst.filter(F.col("kind") == "return").select("file_id", "ln", "indent", "parent_ln")
    body_ret = rets.select("file_id", F.col("parent_ln").alias("if_ln")).distinct().withColumn("body_returns", F.lit(True))
    else_spans = rest.join(blocks.select("file_id", F.col("ln").alias("b_ln"), "ln_end", "indent"), ["file_id", "b_ln"])
    else_ret = enclosing(rets.select("file_id", "ln", "indent"),
                         else_spans.select("file_id", F.col("b_ln").alias("ln"), "ln_end", "indent", "fn_ln", "chain")).select(
        "file_id", F.col("b.fn_ln").alias("fn_ln"), F.col("b.chain").alias("chain")).distinct().withColumn("else_returns", F.lit(True))
    has_else = rest.select("file_id", "fn_ln", "chain").distinct()
    p05 = (heads.join(has_else, ["file_id", "fn_ln", "chain"], "left_semi")
           .join(body_ret, ["file_id", "if_ln"], "left_semi")
           .join(else_ret, ["file_id", "fn_ln", "chain"], "left_anti"))
    p05 = _issue(p05, "missing_early_return", F.col("if_ln"), "low", "performance")
    # + or += inside a loop body, one issue per operator.
    plus = fst.filter(F.col("in_loop") & (F.col("kind") != "docstring")).select(
        "file_id", "qualified_name", "ln", F.explode(F.regexp_extract_all(_bare(), F.lit(r"\+=?"), 0)).alias("op"))
    p06 = _issue(plus, "inefficient_string_concat", F.col("ln"), "low", "performance")
    return p01.unionByName(p02).unionByName(p03).unionByName(p04).unionByName(p05).unionByName(p06)


# --- maintainability ----------------------------------------------------------------

def maintainability_issues(fst: DataFrame, fm: DataFrame) -> DataFrame:
    f = fm
    eff = (F.col("ln_end") - F.col("ln_start")) - F.coalesce(F.col("doc_lines"), F.lit(0))
    q01 = f.filter(eff > 30).select(
        "file_id", F.col("qualified_name").alias("function"), F.lit("long_function").alias("issue_type"),
        F.col("ln_start").cast("bigint").alias("ln"), F.when(eff > 50, "medium").otherwise("low").alias("severity"),
        F.lit("maintainability").alias("category"))
    pos = F.filter("params", lambda p: ~p["name"].startswith("*"))
    n = F.size(pos) - F.when(F.try_element_at(pos, F.lit(1))["name"] == "self", 1).otherwise(0)
    q02 = f.filter(n > 5).select(
        "file_id", F.col("qualified_name").alias("function"), F.lit("long_parameter_list").alias("issue_type"),
        F.col("ln_start").cast("bigint").alias("ln"), F.when(n > 7, "high").otherwise("medium").alias("severity"),
        F.lit("maintainability").alias("category"))
    nest = fst.filter(F.col("kind").isin("if", "elif", "for", "while", "try", "with", "match")).groupBy("file_id", "fn_ln").agg(
        F.max(F.col("nest") + 1).alias("depth"))
    fd = f.join(nest.withColumnRenamed("fn_ln", "ln_start"), ["file_id", "ln_start"], "left")
    q03 = fd.filter(F.col("depth") > 3).select(
        "file_id", F.col("qualified_name").alias("function"), F.lit("deep_nesting").alias("issue_type"),
        F.col("ln_start").cast("bigint").alias("ln"), F.when(F.col("depth") > 4, "medium").otherwise("low").alias("severity"),
        F.lit("maintainability").alias("category"))
    dunder = F.col("name").startswith("__") & F.col("name").endswith("__")
    q04 = _issue(f.filter((F.coalesce(F.trim("docstring"), F.lit("")) == "") & ~dunder), "missing_docstring",
                 F.col("ln_start"), "low", "maintainability")
    nums = fst.filter(F.col("kind") != "docstring").select(
        "file_id", "qualified_name", "ln", F.explode(F.regexp_extract_all(_bare(), F.lit(P.NUMBER), 2)).alias("num"))
    v = F.col("num").cast("double")
    is_int = ~F.col("num").contains(".")
    allowed = v.isin(*[float(x) for x in ALLOWED_NUMBERS]) | (is_int & (v >= -10) & (v <= 10))
    q05 = _issue(nums.filter(~allowed), "magic_number", F.col("ln"), "low", "maintainability")
    bad = lambda c: ~c.rlike(GOOD_NAME) | ((F.length(c) == 1) & ~c.isin(*ONE_LETTER_OK))
    q06a = _issue(f.filter(bad(F.col("name"))), "poor_naming", F.col("ln_start"), "low", "maintainability")
    pn = f.select("file_id", "qualified_name", "ln_start", F.explode(pos).alias("p")).filter(
        bad(F.col("p.name")) & ~F.col("p.name").isin("self", "cls"))
    q06b = _issue(pn, "poor_naming", F.col("ln_start"), "low", "maintainability")
    return q01.unionByName(q02).unionByName(q03).unionByName(q04).unionByName(q05).unionByName(q06a).unionByName(q06b)


def report(issues: DataFrame) -> DataFrame:
    """Counts by issue type and by severity plus the total, one grouping-sets pass."""
    g = issues.groupingSets([["category", "issue_type"], ["category", "severity"], ["category"]], "category", "issue_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("issue_type").alias("gi"), F.grouping("severity").alias("gs"))
    dim = F.when(F.col("gi") == 0, "by_type").when(F.col("gs") == 0, "by_severity").otherwise("total")
    return g.select("category", dim.alias("dimension"), F.coalesce("issue_type", "severity", F.lit("all")).alias("key"), "n")
