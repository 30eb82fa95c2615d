"""Property test: the linear block-end and containment passes equal a brute-force scan on random indentation."""

import random

from pyspark.sql import functions as F

from lintlake.operators import structure as S


def _random_file(rng: random.Random, n: int) -> str:
    out, indent = [], 0
    for k in range(n):
        kind = rng.choice(["if", "for", "while", "x", "x", "x"])
        if kind == "x":
            out.append("    " * indent + f"v{k} = {k}")
        else:
            out.append("    " * indent + f"{kind} c{k}:")
            indent += 1
            out.append("    " * indent + f"w{k} = {k}")
        if indent and rng.random() < 0.35:
            indent = rng.randint(0, indent)
    return "\n".join(out) + "\n"


def _brute(src: str):
    rows = [(i + 1, len(l) - len(l.lstrip(" ")), l.strip()) for i, l in enumerate(src.split("\n")) if l.strip()]
    ends, parents = {}, {}
    for idx, (ln, ind, text) in enumerate(rows):
        if text.endswith(":"):
            stop = next((r[0] for r in rows[idx + 1:] if r[1] <= ind), None)
            body = [r[0] for r in rows[idx + 1:] if stop is None or r[0] < stop]
            ends[ln] = body[-1] if body else ln
    for ln, ind, _t in rows:
        cands = [h for h, e in ends.items() if h < ln <= e and next(r[1] for r in rows if r[0] == h) < ind]
        parents[ln] = max(cands) if cands else None
    return ends, parents


def test_blocks_and_parents_match_brute_force(spark):
    rng = random.Random(7)
    srcs = [(i, f"f{i}.py", _random_file(rng, rng.randint(5, 40))) for i in range(30)]
    files = spark.createDataFrame(srcs, "file_id long, path string, content string")
    st = S.statements(S.lines(files))
    blk = S.blocks(st)
    got_ends = {(r.file_id, r.ln): r.ln_end for r in blk.collect()}
    par = S.enclosing(st.select("file_id", "ln", "indent"), blk.select("file_id", "ln", "ln_end", "indent")) \
        .groupBy("file_id", "ln").agg(F.max_by("b.ln", "d").alias("p"))
    got_par = {(r.file_id, r.ln): r.p for r in par.collect()}
    for fid, _p, src in srcs:
        ends, parents = _brute(src)
        assert {ln: e for (f, ln), e in got_ends.items() if f == fid} == ends
        assert {ln: p for ln, p in parents.items() if p is not None} == {ln: p for (f, ln), p in got_par.items() if f == fid}
