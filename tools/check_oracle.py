"""Run registered queries against their DuckDB oracles: python tools/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lintlake.plans.catalog import load_all, load_code  # noqa: E402
from lintlake.plans.check import compare, duck  # noqa: E402
from lintlake.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_spark()
    con = duck(sf_dir)
    reg = {**load_all(), **load_code()}
    names = args or sorted(reg)
    bad = 0
    for name in names:
        fn, sql = reg[name]
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                n = df.count()
                print(f"{name:32s} rows-only {n} rows  {time.time() - t:.1f}s", flush=True)
                continue
            ok, msg = compare(df, sql, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} {msg}  {time.time() - t:.1f}s", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
