"""Structured Streaming over the given events.

The streams read the event files as they are.  Both have an event-time watermark, so state is forgotten; results, late rows
and stream checkpoints live under the shared checkpoint folder.

* W01 skips content that was accepted less than a time to live ago.  Rows wait in the keyed state until the watermark has passed
  them and are then decided in event-time order, so neither files nor batches change a decision; a content's state ends
  with its time to live.  Rows that come after their time was decided are ``late`` and get a folder of their own.
* W02 keeps findings and the gate status per user and tumbling window in update mode: a micro-batch writes the windows it
  changed under its own id, and nothing else.  Writing a batch again replaces the same folder by the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from lintlake.session import scratch

# How long after its decision a row is still told apart as late; Spark's own watermark lags by as much, as it would drop such rows unseen.
GRACE_DAYS = 3650
_DAY_US = 86_400_000_000


def events_stream(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    head, _, tail = path.rpartition(".")
    glob = f"{head}[.]{tail}"  # a pattern that only the path meets: the file source takes single files by pattern alone
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


@dataclass
class Run:
    """Where a stream put its rows, and what its state held after every micro-batch."""

    out: str
    state_rows: list[int]
    seen: set[int]

    def follow(self, q: StreamingQuery) -> None:
        q.awaitTermination()
        for p in q.recentProgress:
            if p["batchId"] not in self.seen and p["stateOperators"]:
                self.seen.add(p["batchId"])
                self.state_rows.append(p["stateOperators"][0]["numRowsTotal"])


def _decider(ttl_us: int):
    """The state function of W01: (last accepted time or -1, times that wait, their ids) per content."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, ids = state.get if state.exists else (-1, [], [])
        wait = list(zip(times, ids, strict=True))
        done_ms = state.getCurrentWatermarkMs() + GRACE_DAYS * _DAY_US // 1000  # all before this is decided
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
        else:
            for b in batches:
                for us, event_id in zip(b["us"].tolist(), b["event_id"].tolist(), strict=True):
                    if us < done_ms * 1000:
                        out.append((us, event_id, "late"))
                    else:
                        wait.append((us, event_id))
        wait.sort()
        ready = [w for w in wait if w[0] < done_ms * 1000]
        for us, event_id in ready:
            if last < 0 or us - last >= ttl_us:
                last = us
                out.append((us, event_id, "accepted"))
            else:
                out.append((us, event_id, "skipped"))
        wait = wait[len(ready):]
        ends = last + ttl_us if last >= 0 else -1
        if wait or ends > done_ms * 1000:
            state.update((last, [w[0] for w in wait], [w[1] for w in wait]))
            # Woken when the next row can be decided, or when the content is forgotten.
            wake = wait[0][0] if wait else ends
            state.setTimeoutTimestamp(max(wake // 1000 + 1 - GRACE_DAYS * _DAY_US // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"content_hash": key[0], "ts": pd.to_datetime([o[0] for o in out], unit="us"), "event_id": [o[1] for o in out], "outcome": [o[2] for o in out]})

    return decide


DECISION = StructType([StructField("content_hash", StringType()), StructField("ts", TimestampType()), StructField("event_id", LongType()), StructField("outcome", StringType())])


def decisions(events: DataFrame, ttl: str, delay: str) -> DataFrame:
    """W01 on a stream (event_id, ts, event_type, props): (content_hash, ts, event_id, outcome), appended once decided.

    ``delay`` is how far the stream may be out of order.  Rows without a time or id take no part.
    """
    ttl_us = int(pd.Timedelta(ttl) // pd.Timedelta("1us"))
    wait = f"{int(pd.Timedelta(delay) // pd.Timedelta('1ms')) + GRACE_DAYS * _DAY_US // 1000} milliseconds"
    # A null content is a mark that only moves the watermark; the condition names ``ts``, as it must not be pushed below the watermark.
    ev = events.withWatermark("ts", wait).filter("CASE WHEN ts IS NOT NULL THEN event_type IS NOT NULL AND event_id IS NOT NULL ELSE false END")
    ev = ev.select(F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("content_hash"), "ts", F.unix_micros("ts").alias("us"), "event_id")
    return ev.groupBy("content_hash").applyInPandasWithState(_decider(ttl_us), DECISION, "last long, times array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream(spark: SparkSession, path: str, ttl: str = "1 hour", delay: str = "0 seconds", files_per_batch: int | None = None, close: bool = True) -> tuple[DataFrame, Run]:
    """W01 over all files that are there: (decisions, run); the rows lie in ``outcome=accepted|skipped|late`` under ``run.out``.

    A stream that goes on leaves the rows of its last ``delay`` undecided; ``close`` ends it by a mark later than everything.
    """
    schema = spark.read.parquet(path).schema
    run = Run(scratch(spark, "w01"), [], set())
    marks, checkpoint = scratch(spark, "w01-marks"), scratch(spark, "w01-state")
    spark.createDataFrame([], schema).write.parquet(marks)

    def go() -> None:
        ending = spark.readStream.schema(schema).parquet(marks).withColumn("ts", F.col("ts").cast("timestamp"))
        rows = events_stream(spark, path, files_per_batch).unionByName(ending)
        q = decisions(rows, ttl, delay).writeStream.format("parquet").partitionBy("outcome").option("path", run.out).option("checkpointLocation", checkpoint)
        run.follow(q.outputMode("append").trigger(availableNow=True).start())

    go()
    if close:
        last = spark.read.parquet(path).agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
        if last is not None:
            end = pd.Timestamp(last) + pd.Timedelta(delay) + pd.Timedelta(ttl) + pd.Timedelta("1 day")
            spark.createDataFrame([{"ts": end.to_pydatetime()}], "ts timestamp").withColumn("ts", F.col("ts").cast(schema["ts"].dataType)).select(
                *[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(marks)
            go()
    return spark.read.schema(DECISION).parquet(run.out), run


def window_counts(events: DataFrame, window: str, delay: str) -> DataFrame:
    """W02 on a stream: findings (error events) and events per user and tumbling window; a window's state ends ``delay`` after it."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count_if(F.col("event_type") == "error").alias("findings"), F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("window_start"), "user_id", "findings", "events", (F.col("findings") == 0).alias("passed"))


def upsert(batch: DataFrame, batch_id: int, out: str) -> None:
    """The windows a micro-batch changed, under the batch's id; doing it again changes nothing."""
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The gate status of every window and user: its row in the last batch that changed it."""
    rows = spark.read.schema("window_start timestamp, user_id long, findings long, events long, passed boolean, batch_id long").parquet(out)
    last = rows.groupBy("window_start", "user_id").agg(F.max_by(F.struct("findings", "events", "passed"), "batch_id").alias("s"))
    return last.select("window_start", "user_id", "s.findings", "s.events", "s.passed")


def gate_stream(spark: SparkSession, path: str, window: str = "1 day", delay: str = "1 day", files_per_batch: int | None = None) -> tuple[DataFrame, Run]:
    """W02 over all files that are there: (status, run); ``run.out`` holds one folder per micro-batch that changed a window."""
    run = Run(scratch(spark, "w02"), [], set())
    counts = window_counts(events_stream(spark, path, files_per_batch), window, delay)
    spark.createDataFrame([], counts.schema).write.parquet(f"{run.out}/batch_id=-1")
    q = counts.writeStream.outputMode("update").foreachBatch(lambda b, i: upsert(b, i, run.out)).option("checkpointLocation", scratch(spark, "w02-state"))
    run.follow(q.trigger(availableNow=True).start())
    return latest(spark, run.out), run
