"""Streaming queries (W01, W02) over the events as given."""

from __future__ import annotations

from lintlake.plans.catalog import query
from lintlake.streaming import changes


@query("w01_dedup_within_ttl", """
WITH RECURSIVE e AS (SELECT sha256(event_type || '|' || props) AS content_hash, ts, event_id FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL),
a AS (
  SELECT content_hash, min(ts) AS ts FROM e GROUP BY content_hash
  UNION ALL
  SELECT a.content_hash, min(e.ts) AS ts FROM a JOIN e ON e.content_hash = a.content_hash AND e.ts >= a.ts + INTERVAL 1 HOUR GROUP BY a.content_hash)
SELECT content_hash, e.ts, event_id,
       CASE WHEN a.ts IS NOT NULL AND event_id = min(event_id) OVER (PARTITION BY content_hash, e.ts) THEN 'accepted' ELSE 'skipped' END AS outcome
FROM e LEFT JOIN a USING (content_hash, ts)
""")
def w01_dedup_within_ttl(spark, sf_dir):
    """Every event of the stream: accepted, or skipped as its content was accepted under an hour ago."""
    return changes.dedup_stream(spark, f"{sf_dir}/events.parquet")[0].select("content_hash", "ts", "event_id", "outcome")


@query("w02_window_gate_status", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, count(*) FILTER (WHERE event_type = 'error') AS findings, count(*) AS events,
       count(*) FILTER (WHERE event_type = 'error') = 0 AS passed
FROM events GROUP BY ALL
""")
def w02_window_gate_status(spark, sf_dir):
    """Findings and gate status per user and day, upserted batch by batch."""
    return changes.gate_stream(spark, f"{sf_dir}/events.parquet")[0]
