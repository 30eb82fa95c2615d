"""Every query against its DuckDB oracle on the smallest fixture (row count, schema, values).

Queries over the given tables are the registered ones; queries over source files run on a small table of source files.
"""

import pytest

from lintlake.plans.catalog import load_all, load_code
from lintlake.plans.check import compare

SF = "/root/testdata/sf0.001"
TABLES, CODE = load_all(), load_code()


@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in TABLES.items() if sql))
def test_table_query_matches_oracle(spark, duck, name):
    fn, sql = TABLES[name]
    ok, msg = compare(fn(spark, SF), sql, duck)
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in CODE.items() if sql))
def test_code_query_matches_oracle(spark, duck, code_sf, name):
    fn, sql = CODE[name]
    ok, msg = compare(fn(spark, code_sf), sql, duck)
    assert ok, f"{name}: {msg}"


def test_every_query_has_an_oracle():
    assert not [n for n, (_f, sql) in {**TABLES, **CODE}.items() if not sql]


def test_registered_queries_scan_contents(spark):
    """No registered query reads a key column alone."""
    import re

    for name in ("t11_document_findings", "f04_repaired_documents", "m06_page_tag_depth", "x22_answer_facts"):
        plan = TABLES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"ReadSchema: struct<[^>]*(text|html)", plan), name


def test_row_functions_do_not_shuffle(spark):
    for name in ("x01_document_lines", "x18_text_language", "m06_page_tag_depth", "v03_page_scripts", "x22_answer_facts", "f04_repaired_documents"):
        plan = TABLES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
