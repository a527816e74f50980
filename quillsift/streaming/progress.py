"""Progress of runs as a stream: latest state per run, counters, framed messages.

Events are (event_id, ts, run_id, stage, status). A run that has ended stays ended: later events don't change its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TERMINAL = ["completed", "failed"]


def latest(events: DataFrame) -> DataFrame:
    """One row per run: its first terminal event, else its last event; counters of all events up to there."""
    key = F.struct("ts", "event_id")
    ended = F.min(F.when(F.col("status").isin(TERMINAL), F.struct(key.alias("k"), "status", "stage")))
    last = F.max(F.struct(key.alias("k"), "status", "stage"))
    got = events.groupBy("run_id").agg(F.coalesce(ended, last).alias("s"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "failed").alias("failed"))
    return got.select("run_id", F.col("s.status").alias("status"), F.col("s.stage").alias("stage"), F.col("s.k.event_id").alias("event_id"), "n_events", "failed", F.col("s.status").isin(TERMINAL).alias("is_terminal"))


def frames(states: DataFrame) -> DataFrame:
    """States as server-sent event frames."""
    kind = F.when(F.col("is_terminal"), "done").otherwise("progress")
    return states.select("run_id", F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(F.struct(*[c for c in states.columns])), F.lit("\n\n")).alias("frame"))


def stream_latest(spark: SparkSession, path: str, schema, folder: str, to_events) -> DataFrame:
    """Read all files below path as a stream, keep the latest state per run, and return the states as they are at the end.

    The state is kept by Spark's state store. In update mode each batch writes the runs that it has changed to a folder
    of its number, so a batch that is run again replaces its own rows and nothing goes through the driver.
    """
    stream = to_events(spark.readStream.schema(schema).parquet(path))
    states = latest(stream)

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    q = states.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.schema(StructType([*states.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/states")
    columns = states.columns
    return kept.groupBy("run_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select(*[f"s.{c}" for c in columns])


def windowed(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Beyond the batch operators: events by window and stage, late ones up to `delay` counted; for append-mode sinks."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")
