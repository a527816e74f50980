"""The response cache: a log of what was put, used and evicted, partitioned by the first two digits of the key.

Rows are (prefix, key, at, action, response); a response is JSON with content and model. The last `put` of a key holds
unless an `evict` came after it; a `use` renews the time by which a key is evicted. Appending a row is all that a change takes,
so nothing is rewritten and a writer that dies leaves whole rows or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "key string, at timestamp, action string, response string, prefix string"


def prefixed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prefix", F.substring("key", 1, 2))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows (key, at, action, response) to the log."""
    prefixed(rows.select("key", "at", "action", "response")).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def entries(log: DataFrame) -> DataFrame:
    """What the cache holds: (prefix, key, response, put_at, used_at, bytes, readable), a row per key that isn't evicted."""
    put = F.max(F.when(F.col("action") == "put", F.struct("at", "response")))
    gone = F.max(F.when(F.col("action") == "evict", F.col("at")))
    got = log.groupBy("prefix", "key").agg(put.alias("p"), gone.alias("gone"), F.max(F.when(F.col("action") != "evict", F.col("at"))).alias("used_at"))
    live = got.where("p IS NOT NULL AND (gone IS NULL OR gone < p.at)")
    parsed = F.from_json("p.response", "content string, model string")
    readable = F.coalesce(parsed["content"].isNotNull() & parsed["model"].isNotNull(), F.lit(False))
    return live.select("prefix", "key", "p.response", F.col("p.at").alias("put_at"), "used_at", F.octet_length("p.response").cast("long").alias("bytes"), readable.alias("readable"))


def looked_up(requests: DataFrame, log: DataFrame) -> DataFrame:
    """requests (key, ...) with content, model and hit. A response that can't be read is a miss.

    Only partitions of the requests' prefixes are read, 256 at most, and of those only rows of keys that are asked for
    are grouped.
    """
    asked = prefixed(requests.select("key").distinct())
    prefixes = [r[0] for r in asked.select("prefix").distinct().collect()]
    near = log.where(F.col("prefix").isin(prefixes)).join(asked, ["prefix", "key"], "left_semi")
    known = entries(near).where("readable").select(F.col("key").alias("_k"), F.from_json("response", "content string, model string").alias("_r"))
    return requests.join(known, F.col("key") == F.col("_k"), "left").select(*requests.columns, F.col("_r.content").alias("content"), F.col("_r.model").alias("model"), F.col("_k").isNotNull().alias("hit"))


def hit_rate(found: DataFrame, *by: str) -> DataFrame:
    """Hits, misses and their rate (3 places, 0 without requests) of looked_up()."""
    got = found.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return got.withColumn("hit_rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 3))


def _evict(rows: DataFrame, at: Column) -> DataFrame:
    return rows.select("key", at.cast("timestamp").alias("at"), F.lit("evict").alias("action"), F.lit(None).cast("string").alias("response"))


def unreadable(held: DataFrame, now: Column) -> DataFrame:
    """Log rows that evict what can't be read."""
    return _evict(held.where("NOT readable"), now)


def unused(held: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Log rows that evict what was not used for so many seconds."""
    return _evict(held.where(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds("used_at") > seconds), now)


def over_size(held: DataFrame, now: Column, most: int, slice_seconds: int = 3600) -> DataFrame:
    """Log rows that evict the longest unused, so that at most `most` bytes are left; equal times by key.

    Bytes are counted by slices of time; only the entries of a slice are put in order with each other.
    """
    rows = held.withColumn("slice", F.floor(F.unix_seconds("used_at") / slice_seconds))
    newer = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("slice").agg(F.sum("bytes").alias("own"))
    slices = slices.select("slice", F.coalesce(F.sum("own").over(newer), F.lit(0)).alias("before"))
    within = Window.partitionBy("slice").orderBy(F.desc("used_at"), "key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("bytes").over(within)
    return _evict(rows.join(slices, "slice").withColumn("upto", upto).where(F.col("upto") > most), now)
