"""Summarise physical plans of chosen queries: shuffles, broadcasts, codegen stages and scanned columns.

python tools/explain.py [sf_dir] name ...   (prints a markdown table)
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lintlake.plans.catalog import load_all, load_code  # noqa: E402
from lintlake.session import get_spark  # noqa: E402


def summary(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "codegen": len(re.findall(r"\*\(\d+\)", plan)),
        "scans": "; ".join(sorted({", ".join(c.split("#")[0] for c in s.split(",")) for s in scans}))[:160],
    }


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_spark()
    reg = {**load_all(), **load_code()}
    print("| query | shuffles | broadcasts | codegen ops | columns read |")
    print("| --- | --- | --- | --- | --- |")
    for name in args:
        s = summary(reg[name][0](spark, sf))
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['codegen']} | {s['scans']} |", flush=True)


if __name__ == "__main__":
    main()
