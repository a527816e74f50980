"""Progress channels: who reads a run's progress gets its last state at once, then what follows, until the run has ended.

A stream of (run_id, ts, event_id, stage, status). Status `subscribe` is a reader's coming, its event_id the reader's name;
all others are states of the run. Per run Spark's state store holds the last state (a value) and the open readers (a list):

* a reader that comes gets the last state, if there is one (`replay`), and `done` if the run has ended;
* each later state goes to every open reader (`progress`), but no more than `backlog` of them in a micro-batch, the time that
  a reader has to take them: what is more is dropped for this reader and counted, the state itself is kept; a backlog of
  None drops nothing;
* the first state that is terminal closes the channel: readers that got it are `done`, later states of the run are ignored;
* an open reader that has got nothing for `heartbeat` seconds gets a `keep-alive`, by a timer of the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillsift.streaming.progress import TERMINAL

BACKLOG, HEARTBEAT = 64, 15.0
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames that are handed over at once.
AT_ONCE = 10_000
FRAME = "run_id long, reader long, seq long, kind string, event_id long, stage string, status string, dropped long"


class Channel(StatefulProcessor):
    """The frames that a run's readers get."""

    def __init__(self, backlog: int | None = BACKLOG, heartbeat: float = HEARTBEAT) -> None:
        self.backlog, self.heartbeat = backlog, heartbeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, stage string, status string")
        self.readers = handle.getListState("readers", "reader long, seq long, dropped long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = self.last.get() if self.last.exists() else None
        readers = {r[0]: [r[1], r[2], 0] for r in self.readers.get()} if self.readers.exists() else {}  # seq, dropped, waiting
        frames: list[tuple] = []

        def tell(reader: int, kind: str, state: tuple = (None, None, None)) -> None:
            own = readers[reader]
            frames.append((key[0], reader, own[0], kind, *state, own[1]))
            own[0] += 1

        for event_id, stage, status in zip(found["event_id"].tolist(), found["stage"].tolist(), found["status"].tolist(), strict=True):
            ended = last is not None and last[2] in TERMINAL
            if status == "subscribe":
                readers[event_id] = [0, 0, 0]
                if last is not None:
                    tell(event_id, "replay", tuple(last))
                if ended:
                    tell(event_id, "done")
                    del readers[event_id]
            elif not ended:
                last = (event_id, stage, status)
                for reader in list(readers):
                    if readers[reader][2] == self.backlog:
                        readers[reader][1] += 1
                        continue
                    readers[reader][2] += 1
                    tell(reader, "progress", last)
                    if status in TERMINAL:
                        tell(reader, "done")
                        del readers[reader]
            if len(frames) >= AT_ONCE:
                yield self.batch(frames)
                frames.clear()
        if last is not None:
            self.last.update(tuple(last))
        self.keep(readers, timerValues)
        yield self.batch(frames)

    def keep(self, readers: dict[int, list[int]], timers: Any) -> None:
        if readers:
            self.readers.put([(r, own[0], own[1]) for r, own in readers.items()])
        else:  # a list that is kept can't be empty
            self.readers.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if readers:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.heartbeat * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        open_ = {r[0]: [r[1] + 1, r[2], 0] for r in self.readers.get()}
        self.keep(open_, timerValues)
        yield self.batch([(key[0], r, own[0] - 1, "keep-alive", None, None, None, own[1]) for r, own in open_.items()])

    @staticmethod
    def batch(frames: list[tuple]) -> pd.DataFrame:
        kinds = {"run_id": "int64", "reader": "int64", "seq": "int64", "kind": "object", "event_id": "Int64", "stage": "object", "status": "object", "dropped": "int64"}
        return pd.DataFrame(frames, columns=[*kinds]).astype(kinds)

    def close(self) -> None:
        pass


def frames(events: DataFrame, backlog: int | None = BACKLOG, heartbeat: float = HEARTBEAT) -> DataFrame:
    """The stream of frames of a stream of events."""
    kept = events.select("run_id", "ts", "event_id", "stage", "status")
    return kept.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Channel(backlog, heartbeat), outputStructType=FRAME, outputMode="Append", timeMode="ProcessingTime")


def text(found: DataFrame) -> DataFrame:
    """Frames as server-sent events: (run_id, reader, seq, frame)."""
    data = F.when(F.col("kind") == "done", "{}").otherwise(F.to_json(F.struct("run_id", "event_id", "stage", "status", "dropped")))
    name = F.when(F.col("kind") == "done", "done").otherwise("progress")
    frame = F.when(F.col("kind") == "keep-alive", ": keep-alive\n\n").otherwise(F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n")))
    return found.select("run_id", "reader", "seq", frame.alias("frame"))


def reduced(found: DataFrame) -> DataFrame:
    """What each reader knows after its frames: the last state, the frames it got, those it lost, and whether it's over."""
    state = F.max(F.when(F.col("kind").isin("replay", "progress"), F.struct("seq", "event_id", "stage", "status"))).alias("s")
    got = found.groupBy("run_id", "reader").agg(state, F.count("*").alias("n_frames"), F.max("dropped").alias("dropped"), F.bool_or(F.col("kind") == "done").alias("done"))
    return got.select("run_id", "reader", "s.event_id", "s.stage", "s.status", "n_frames", "dropped", "done")


def run(spark: SparkSession, path: str, schema: Any, folder: str, to_events: Any, backlog: int | None = BACKLOG) -> DataFrame:
    """The frames of all files below path: read as a stream, written below folder by the number of the micro-batch."""
    settings = {PROVIDER: ROCKS, EMPTY: "false"}  # without empty batches for timers, as the stream ends with its files
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)

    def written(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/frames/batch={number}")  # a batch that runs again replaces its own

    try:
        stream = frames(to_events(spark.readStream.schema(schema).parquet(path)), backlog)
        stream.writeStream.outputMode("append").foreachBatch(written).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(FRAME).parquet(f"{folder}/frames").drop("batch")  # which the folders' names would add
