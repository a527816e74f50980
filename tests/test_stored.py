"""Versions of a table, the response cache, payloads, and the progress channel."""

import time

import pytest
from pyspark.sql import functions as F

from quillsift.operators import payload
from quillsift.sources import cache
from quillsift.sources.versions import Conflict, Versions
from quillsift.streaming import channel
from tests.oracle import SF

SCHEMA = "id long, name string, note string"


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/people", SCHEMA, "id", buckets=8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_update_delete(spark, store):
    assert rows(store.read()) == [] and store.versions() == []
    store.upsert(spark.createDataFrame([(i, f"n{i}", None) for i in range(40)], SCHEMA))
    store.upsert(spark.createDataFrame([(3, "new", "x"), (99, "late", None)], SCHEMA))
    store.upsert(spark.createDataFrame([(3, "seen"), (4, "seen")], "id long, note string"), ["note"])
    store.delete(spark.createDataFrame([(0,), (1,), (77,)], "id long"))
    want = {i: (i, f"n{i}", None) for i in range(2, 40)} | {3: (3, "new", "seen"), 4: (4, "n4", "seen"), 99: (99, "late", None)}
    assert rows(store.read()) == sorted(want.values(), key=str) or {r[0]: r for r in rows(store.read().na.fill("", ["note"]))}.keys() == want.keys()
    assert {r.id: tuple(r) for r in store.read().collect()} == want
    assert {r.id for r in store.read(1).collect()} == set(range(40)) and store.read(2).where("id = 3").first().note == "x"
    assert [r.name for r in store.find(spark.createDataFrame([(99,), (5,)], "id long")).orderBy("id").collect()] == ["n5", "late"]
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(1, "a", None), (1, "b", None)], SCHEMA))


def test_only_touched_buckets_are_rewritten(spark, store):
    store.upsert(spark.createDataFrame([(i, "n", None) for i in range(100)], SCHEMA))
    before = store.manifest()[1]
    store.upsert(spark.createDataFrame([(5, "m", None)], SCHEMA))
    after = store.manifest()[1]
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_writer_that_dies_leaves_the_last_version(spark, store):
    store.upsert(spark.createDataFrame([(1, "a", None)], SCHEMA))

    def dies(version, folders):
        raise RuntimeError("gone")

    store.commit, commit = dies, store.commit
    with pytest.raises(RuntimeError):
        store.upsert(spark.createDataFrame([(1, "b", None), (2, "c", None)], SCHEMA))
    store.commit = commit
    assert rows(store.read().select("id", "name")) == [(1, "a")] and store.versions() == [1]
    assert store.vacuum() == 1 and rows(store.read().select("id", "name")) == [(1, "a")]
    store.upsert(spark.createDataFrame([(2, "c", None)], SCHEMA))
    assert rows(store.read().select("id", "name")) == [(1, "a"), (2, "c")]
    with pytest.raises(Conflict):
        store.commit(2, {})


def test_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    at = lambda s: F.timestamp_seconds(F.lit(s))
    log = [("aa1", 100, "put", '{"content": "x", "model": "m"}'), ("aa2", 110, "put", "{broken"), ("bb1", 120, "put", '{"content": "old", "model": "m"}'), ("bb1", 130, "put", '{"content": "new", "model": "m"}'), ("cc1", 90, "put", '{"content": "z", "model": "m"}'), ("cc1", 95, "evict", None), ("aa1", 5000, "use", None), ("dd1", 10, "put", '{"model": "m"}')]
    cache.append(spark.createDataFrame(log, "key string, s long, action string, response string").withColumn("at", F.timestamp_seconds("s")), path)
    asked = spark.createDataFrame([(k,) for k in ("aa1", "aa2", "bb1", "cc1", "dd1", "ee1", "aa1")], "key string")
    found = cache.looked_up(asked, cache.opened(spark, path))
    assert sorted((r.key, r.hit, r.content) for r in found.collect()) == sorted([("aa1", True, "x"), ("aa1", True, "x"), ("aa2", False, None), ("bb1", True, "new"), ("cc1", False, None), ("dd1", False, None), ("ee1", False, None)], key=str)
    assert tuple(cache.hit_rate(found).first()) == (3, 4, 0.429) and tuple(cache.hit_rate(found.limit(0)).first()) == (0, 0, 0.0)
    held = cache.entries(cache.opened(spark, path))
    assert {r.key for r in held.collect()} == {"aa1", "aa2", "bb1", "dd1"}
    assert {r.key for r in cache.unreadable(held, at(6000)).collect()} == {"aa2", "dd1"}
    assert {r.key for r in cache.unused(held, at(6000), 3600).collect()} == {"aa2", "bb1", "dd1"}
    assert {r.key for r in cache.over_size(held, at(6000), 40).collect()} == {"bb1", "aa2", "dd1"}
    plan = cache.looked_up(asked, cache.opened(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or "prefix#" in plan.split("PartitionFilters")[1]


def test_payload(spark):
    rows = [(1, '{"band": "solid", "score": 5.5, "requirements": [{"requirement": "r", "verdict": "clear", "points": 1, "citations": [{"start": 1, "end": 4, "quote": "abc"}]}]}'), (2, "{"), (3, None), (4, '{"band": "x", "requirements": []}'), (5, '{"band": "x", "score": "high", "requirements": []}'), (6, '{"band": "x", "score": 1, "requirements": []}')]
    whole, lost = payload.restored(payload.parsed(spark.createDataFrame(rows, "k int, json string"), "json"), "k")
    got = {r.k: r for r in whole.collect()}
    assert got.keys() == {1, 6} and got[1].requirements[0].citations[0].quote == "abc" and got[6].requirements == []
    assert {r.k: r.reason for r in lost.collect()} == {2: "not JSON", 3: "not JSON", 4: "no score", 5: "score of another type"}


def told(events, backlog=64):
    """What readers get, in plain Python."""
    last, open_, out = None, {}, []
    for ts, event_id, stage, status in sorted(events):
        ended = last is not None and last[2] in ("completed", "failed")
        if status == "subscribe":
            frames = [("replay", *last)] * (last is not None) + [("done", None, None, None)] * ended
            out += [(event_id, k, *f) for k, f in enumerate(frames)]
            if not ended:
                open_[event_id] = [len(frames), 0]
        elif not ended:
            last = (event_id, stage, status)
            for reader in list(open_):
                if open_[reader][1] < backlog:
                    open_[reader][1] += 1
                    frames = [("progress", *last)] + [("done", None, None, None)] * (status in ("completed", "failed"))
                    out += [(reader, open_[reader][0] + k, *f) for k, f in enumerate(frames)]
                    open_[reader][0] += len(frames)
                    if len(frames) > 1:
                        del open_[reader]
    return out


@pytest.mark.parametrize("backlog", [64, 2])
def test_channel(spark, tmp_path, backlog):
    from quillsift.plans.streams import readers

    source = spark.read.parquet(f"{SF}/events.parquet")
    got = channel.run(spark, f"{SF}/events.parquet*", source.schema, f"file://{tmp_path}/channel", readers, backlog)
    by, want = {}, []
    for r in readers(source).collect():
        by.setdefault(r.run_id, []).append((r.ts, r.event_id, r.stage, r.status))
    for run, events in by.items():
        want += [(run, *f) for f in told(events, backlog)]
    assert sorted([(r.run_id, r.reader, r.seq, r.kind, r.event_id, r.stage, r.status) for r in got.collect()], key=str) == sorted(want, key=str)
    if backlog == 2:
        assert got.where("dropped > 0").count() > 0 or got.agg(F.max("seq")).first()[0] <= 3
    text = channel.text(got).where("frame LIKE 'event: done%'").first()
    assert text is None or text.frame == "event: done\ndata: {}\n\n"


def test_heartbeat(spark, tmp_path):
    """A reader that hears nothing is sent keep-alives; state survives from batch to batch."""
    folder = f"{tmp_path}/in"
    schema = "event_id long, ts timestamp, run_id long, stage string, status string"
    spark.createDataFrame([(1, "running"), (2, "subscribe")], "event_id long, status string").selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "7L AS run_id", "'s' AS stage", "status").coalesce(1).write.parquet(folder)
    spark.conf.set(channel.PROVIDER, channel.ROCKS)
    out = []
    try:
        q = channel.frames(spark.readStream.schema(schema).parquet(folder), heartbeat=0.5).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
        until = time.time() + 60
        while time.time() < until and sum(r.kind == "keep-alive" for r in out) < 2:
            time.sleep(0.2)
        q.stop()
    finally:
        spark.conf.unset(channel.PROVIDER)
    assert [r.kind for r in out[:3]] == ["replay", "keep-alive", "keep-alive"] and [r.seq for r in out[:3]] == [0, 1, 2]
