"""Streaming properties, report invariants and the driver entry points."""

import datetime as dt
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _spread(spark, tmp_path, n, in_order=False):
    """The same events in ``n`` files, of shuffled rows or in the order of time."""
    path = str(tmp_path / f"in{n}" / "events.parquet")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    if in_order:
        for k, part in enumerate(ev.orderBy("ts").withColumn("n", F.ntile(n).over(Window.orderBy("ts"))).toPandas().groupby("n")):
            spark.createDataFrame(part[1].drop(columns="n"), ev.schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.05 * (k < n))  # files are taken by their time of change
    else:
        ev.repartition(n, F.rand(3)).write.parquet(path)
    return path


def _rows(df):
    return sorted(map(str, df.collect()))


def _replay(events, ttl=3600):
    """Plain ordered replay: an event is accepted unless its content was accepted less than ``ttl`` seconds ago."""
    last, out = {}, {}
    for i, ts, content in sorted(events, key=lambda e: (e[1], e[0])):
        fresh = content not in last or (ts - last[content]).total_seconds() >= ttl
        out[i] = "accepted" if fresh else "skipped"
        if fresh:
            last[content] = ts
    return out


def test_dedup_stream_is_an_ordered_replay_for_any_layout(spark, tmp_path):
    from lintlake.streaming import changes

    ev = [(r.event_id, r.ts, f"{r.event_type}|{r.props}") for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    want = _replay(ev)
    assert set(want.values()) == {"accepted", "skipped"}
    path = f"{SF}/events.parquet"
    for n, per, delay in ((None, None, "0 seconds"), (1, None, "0 seconds"), (6, 1, "40 days"), (20, 7, "40 days")):
        got, run = changes.dedup_stream(spark, _spread(spark, tmp_path, n) if n else path, delay=delay, files_per_batch=per)
        assert {r.event_id: r.outcome for r in got.collect()} == want and got.count() == len(want)
        assert run.state_rows[-1] == 0  # every content is forgotten after its time to live


def test_dedup_state_holds_only_the_last_hours(spark, tmp_path):
    """Files in order of time: nothing is late, and old contents leave the state long before the end."""
    from lintlake.streaming import changes

    ev = [(r.event_id, r.ts, f"{r.event_type}|{r.props}") for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    got, run = changes.dedup_stream(spark, _spread(spark, tmp_path, 6, in_order=True), files_per_batch=1)
    assert {r.event_id: r.outcome for r in got.collect()} == _replay(ev)
    contents = len({e[2] for e in ev})
    assert run.state_rows[-1] == 0 and max(run.state_rows) < contents


def _events(spark, rows, path, **mode):
    ddl = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) if m is not None else None, 1, kind, 0.0, props) for i, m, kind, props in rows], ddl).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.1)


def test_late_rows_have_a_folder_of_their_own(spark, tmp_path):
    from lintlake.streaming import changes

    path = str(tmp_path / "late" / "events.parquet")
    _events(spark, [(1, 0, "a", "x"), (2, 50, "a", "x"), (3, 60, "a", "x"), (4, 300, "b", "y")], path)
    _events(spark, [(5, 10, "a", "x"), (6, 299, "c", "z"), (7, 310, "b", "y"), (8, None, "b", "y"), (9, 305, None, "y")], path)
    _events(spark, [(10, 360, "b", "y"), (11, 600, "d", None)], path)
    got, run = changes.dedup_stream(spark, path, ttl="1 hour", delay="5 minutes", files_per_batch=1)
    assert {r.event_id: r.outcome for r in got.collect()} == {1: "accepted", 2: "skipped", 3: "accepted", 4: "accepted", 5: "late", 6: "accepted", 7: "skipped", 10: "accepted", 11: "accepted"}
    assert [r.event_id for r in spark.read.parquet(f"{run.out}/outcome=late").collect()] == [5]


def test_a_stream_that_goes_on_keeps_its_last_rows(spark, tmp_path):
    from lintlake.streaming import changes

    path = str(tmp_path / "open" / "events.parquet")
    _events(spark, [(1, 0, "a", "x"), (2, 30, "b", "x"), (3, 100, "c", "x")], path)
    got, run = changes.dedup_stream(spark, path, delay="1 hour", close=False)
    assert {r.event_id: r.outcome for r in got.collect()} == {1: "accepted", 2: "accepted"} and run.state_rows[-1] > 0
    empty = str(tmp_path / "none" / "events.parquet")
    spark.read.parquet(path).limit(0).write.parquet(empty)
    assert changes.dedup_stream(spark, empty)[0].count() == 0


def test_gate_stream_is_the_same_for_any_layout(spark, tmp_path):
    from lintlake.streaming import changes

    first = changes.gate_stream(spark, f"{SF}/events.parquet")[0]
    assert first.agg(F.sum("events")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    for n, per in ((6, 1), (20, 7)):
        assert _rows(changes.gate_stream(spark, _spread(spark, tmp_path, n), delay="40 days", files_per_batch=per)[0]) == _rows(first)


def test_gate_batches_write_only_what_changed_and_can_be_repeated(spark, tmp_path):
    from lintlake.streaming import changes

    path = _spread(spark, tmp_path, 6, in_order=True)
    status, run = changes.gate_stream(spark, path, delay="1 hour", files_per_batch=1)
    want = _rows(changes.gate_stream(spark, f"{SF}/events.parquet")[0])
    assert _rows(status) == want
    log = spark.read.parquet(run.out)
    windows = status.count()
    assert max(r["count"] for r in log.groupBy("batch_id").count().collect()) < windows  # no batch rewrites the result
    assert max(run.state_rows) < windows  # closed windows leave the state
    for b in sorted(r.batch_id for r in log.select("batch_id").distinct().collect()):
        again = spark.read.parquet(f"{run.out}/batch_id={b}").toPandas()
        changes.upsert(spark.createDataFrame(again, log.drop("batch_id").schema), b, run.out)
        assert _rows(changes.latest(spark, run.out)) == want


def test_severity_counts_sum_to_total(spark, code_sf):
    from lintlake.plans.q_rollup import r02_summary

    s = r02_summary(spark, code_sf)
    bad = s.filter(F.col("critical") + F.col("high") + F.col("medium") + F.col("low") != F.col("total_issues"))
    assert bad.count() == 0


def test_no_fixes_gives_input_back(spark, code_sf):
    from lintlake.operators import repair as RP
    from lintlake.plans.substrate import for_corpus

    sub = for_corpus(spark, code_sf)
    empty = spark.createDataFrame([], "file_id long, issue_id string, line_start bigint, fixed_code string")
    out = RP.apply_fixes(sub.lines, empty).select("file_id", "content")
    orig = sub.files.select("file_id", F.col("content").alias("orig"))
    assert out.join(orig, "file_id").filter(F.col("content") != F.col("orig")).count() == 0


def test_unknown_report_format_is_an_error(spark):
    import pytest

    from lintlake.sources import sinks

    with pytest.raises(ValueError):
        sinks.export(spark.range(1), "xml", "/tmp/never-written")


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)


def test_scratch_needs_a_shared_folder_off_local_masters():
    from lintlake.session import is_local

    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[3,2,1024]") and not is_local("spark://h:7077") and not is_local("yarn")


def test_no_shared_folder_is_an_error(monkeypatch):
    import pytest

    from lintlake import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_rules_on_typed_lines(spark):
    from lintlake.operators import textrules as T

    text = 'token = "abc" and me.x@mail.org\nnothing here\nLicensed ### 1234567890123 8.8.8.8'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    f = T.findings(df, "doc_id")
    assert sorted((r.line_no, r.rule, r.matches, r.evidence) for r in f.collect()) == [
        (1, "email", 1, "me.x@mail.org"), (1, "secret", 1, 'token = "abc"'), (3, "ip_address", 1, "8.8.8.8"), (3, "junk_marks", 1, "###"),
        (3, "license_line", 1, "License"), (3, "long_number", 1, "1234567890123")]
    rep = {r.doc_id: r for r in T.reports(df, f, "doc_id").collect()}
    assert (rep[1].total, rep[1].worst, rep[1].passed, rep[1].score) == (6, "critical", False, 25)
    assert (rep[2].total, rep[2].worst, rep[2].passed) == (0, "none", True) and rep[3].total == 0
    fixed = df.select(T.repaired(F.col("text")).alias("t")).first()["t"]
    assert fixed == 'token = "[secret]" and [email]\nnothing here\nLicensed  [number] [ip]'
