"""Streaming queries over events: user = run, event type = stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.plans.registry import query, table
from quillsift.sources.shared import new_path
from quillsift.streaming import channel, progress

EVENT_SQL = """
WITH e AS (SELECT event_id, ts, user_id AS run_id, event_type AS stage, CASE WHEN event_type = 'purchase' AND value > 150 THEN 'completed' WHEN event_type = 'error' AND value > 190 THEN 'failed' ELSE 'running' END AS status FROM events),
t AS (SELECT run_id, min((ts, event_id)) FILTER (status <> 'running') AS ended, max((ts, event_id)) AS last, count(*) AS n_events, count_if(status = 'failed') AS failed FROM e GROUP BY 1),
l AS (SELECT t.run_id, status, stage, e.event_id, n_events, failed, status <> 'running' AS is_terminal FROM t JOIN e ON e.run_id = t.run_id AND (e.ts, e.event_id) = coalesce(ended, last))
"""


def events(df: DataFrame) -> DataFrame:
    status = F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), "completed").when((F.col("event_type") == "error") & (F.col("value") > 190), "failed").otherwise("running")
    return df.select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), status.alias("status"))


@query("progress_batch", EVENT_SQL + "SELECT * FROM l")
def progress_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest(events(table(spark, sf_dir, "events")))


@query("progress_latest", EVENT_SQL + "SELECT * FROM l")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Structured Streaming, all that is there now."""
    schema = table(spark, sf_dir, "events").schema
    return progress.stream_latest(spark, f"{sf_dir}/events.parquet*", schema, new_path(spark, "progress"), events)


@query("progress_frames", EVENT_SQL + "SELECT is_terminal AS done, count(*) AS frames FROM l GROUP BY 1")
def progress_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = progress.frames(progress_batch(spark, sf_dir))
    return f.groupBy(F.col("frame").startswith("event: done").alias("done")).agg(F.count("*").alias("frames"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts; beyond what the catalogue's batch operators need."""
    return progress.windowed(events(table(spark, sf_dir, "events")))


CHANNEL_SQL = """
WITH e AS (SELECT event_id, ts, user_id AS run_id, event_type AS stage, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'subscribe' WHEN event_type = 'purchase' AND value > 150 THEN 'completed' WHEN event_type = 'error' AND value > 190 THEN 'failed' ELSE 'running' END AS status FROM events),
t AS (SELECT run_id, min((ts, event_id)) AS ended FROM e WHERE status IN ('completed', 'failed') GROUP BY 1),
p AS (SELECT e.* FROM e LEFT JOIN t USING (run_id) WHERE status <> 'subscribe' AND (ended IS NULL OR (ts, event_id) <= ended)),
r AS (SELECT run_id, event_id AS reader, ts FROM e WHERE status = 'subscribe'),
before AS (SELECT r.run_id, r.reader, max((p.ts, p.event_id, p.stage, p.status)) AS s FROM r JOIN p ON r.run_id = p.run_id AND (p.ts, p.event_id) < (r.ts, r.reader) GROUP BY 1, 2),
past AS (SELECT run_id, reader, s[2] AS event_id, s[3] AS stage, s[4] AS status FROM before),
ahead AS (SELECT r.run_id, r.reader, p.event_id, p.stage, p.status, row_number() OVER (PARTITION BY r.run_id, r.reader ORDER BY p.ts, p.event_id) AS k FROM r JOIN p ON r.run_id = p.run_id AND (p.ts, p.event_id) > (r.ts, r.reader)),
f AS (SELECT run_id, reader, 0 AS k, 'replay' AS kind, event_id, stage, status FROM past UNION ALL SELECT run_id, reader, k, 'progress', event_id, stage, status FROM ahead WHERE k <= {backlog}
  UNION ALL SELECT run_id, reader, 1000, 'done', NULL, NULL, NULL FROM (SELECT run_id, reader, status FROM past UNION ALL SELECT run_id, reader, status FROM ahead WHERE k <= {backlog}) WHERE status IN ('completed', 'failed')),
g AS (SELECT run_id, reader, row_number() OVER (PARTITION BY run_id, reader ORDER BY k) - 1 AS seq, kind, event_id, stage, status FROM f)
"""


def readers(df: DataFrame) -> DataFrame:
    """Events of runs, and every fifth view as a reader that comes."""
    reader = (F.col("stage") == "view") & (F.col("event_id") % 5 == 0)
    return events(df).withColumn("status", F.when(reader, "subscribe").otherwise(F.col("status")))


def channel_frames(spark: SparkSession, sf_dir: str, backlog: int | None) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return channel.run(spark, f"{sf_dir}/events.parquet*", schema, new_path(spark, "channel"), readers, backlog)


#: The same without a backlog: a reader gets all that follows, and `done` comes after that, however much it is.
WHOLE_SQL = CHANNEL_SQL.replace(" WHERE k <= {backlog}", "").replace("reader, 1000, 'done'", f"reader, {1 << 62}, 'done'")


@query("progress_channel", WHOLE_SQL + "SELECT run_id, reader, seq, kind, event_id, stage, status FROM g")
def progress_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader of a run gets, by a stateful stream; none of it is dropped, as readers of a table take what there is."""
    return channel_frames(spark, sf_dir, None).drop("dropped")


@query("progress_reduced", CHANNEL_SQL.format(backlog=channel.BACKLOG) + """
SELECT run_id, reader, arg_max(event_id, seq) FILTER (kind <> 'done') AS event_id, arg_max(status, seq) FILTER (kind <> 'done') AS status, count(*) AS n_frames, bool_or(kind = 'done') AS done FROM g GROUP BY 1, 2""")
def progress_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader knows in the end."""
    return channel.reduced(channel_frames(spark, sf_dir, channel.BACKLOG)).drop("stage", "dropped")
