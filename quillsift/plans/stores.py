"""Queries over stored tables: upserts by key, the response cache, payloads of assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import payload
from quillsift.plans.registry import query, table
from quillsift.sources import cache
from quillsift.sources.shared import new_path
from quillsift.sources.versions import Versions

JOB = "job_id long, title string, rubric string, score double"


def changed_jobs(spark: SparkSession, sf_dir: str) -> Versions:
    """Orders as jobs: created, a third of them given a rubric, a fifth assessed anew together with new ones, some deleted."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("score"))
    store = Versions(spark, new_path(spark, "jobs"), JOB, "job_id", buckets=16)
    store.upsert(jobs.where("job_id % 2 = 1"))
    store.upsert(jobs.where("job_id % 3 = 0 AND job_id % 2 = 1").select("job_id", F.concat(F.lit("rubric of "), "job_id").alias("rubric")), ["rubric"])
    store.upsert(jobs.where("job_id % 5 = 0").withColumn("score", F.col("score") + 1))
    store.delete(jobs.where("job_id % 7 = 0"))
    return store


@query("store_upsert", """
SELECT o_orderkey AS job_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 THEN 'rubric of ' || o_orderkey END AS rubric, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS score
FROM orders WHERE (o_orderkey % 2 = 1 OR o_orderkey % 5 = 0) AND o_orderkey % 7 <> 0""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_jobs(spark, sf_dir).read()


@query("store_versions", """
WITH v AS (SELECT *, o_orderkey AS k FROM orders), r AS (
  SELECT 1 AS version, k, o_totalprice AS s FROM v WHERE k % 2 = 1 UNION ALL SELECT 2, k, o_totalprice FROM v WHERE k % 2 = 1
  UNION ALL SELECT 3, k, o_totalprice + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END FROM v WHERE k % 2 = 1 OR k % 5 = 0
  UNION ALL SELECT 4, k, o_totalprice + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END FROM v WHERE (k % 2 = 1 OR k % 5 = 0) AND k % 7 <> 0)
SELECT version, count(*) AS jobs, round(sum(s), 2) AS total FROM r GROUP BY 1""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version as it was."""
    store, out = changed_jobs(spark, sf_dir), None
    for v in store.versions():
        part = store.read(v).agg(F.count("*").alias("jobs"), F.round(F.sum("score"), 2).alias("total")).withColumn("version", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


# The cache: turns of conversations as requests. Even turns are put, some cut short, every third conversation's are used later.
CACHE_SQL = """
WITH m AS (SELECT conv_id, turn, sha256(concat_ws(chr(31), 'v1', role, text, conv_id::VARCHAR, turn::VARCHAR)) AS key, '{"content": "answer ' || conv_id || '", "model": "m"}' AS whole, conv_id * 60 + turn AS put_at FROM conversations),
put AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN substr(whole, 1, length(whole) - 3) ELSE whole END AS response, conv_id % 7 <> 0 AS readable, CASE WHEN conv_id % 3 = 0 THEN put_at + 7200 ELSE put_at END AS used FROM m WHERE turn % 2 = 0),
h AS (SELECT *, strlen(response) AS bytes, row_number() OVER (ORDER BY used DESC, key) AS place, max(used) OVER () AS latest FROM put)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillsift.sources.store import cache_key

    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn"))
    return c.select("conv_id", "turn", cache_key(F.lit("v1"), F.col("role"), F.col("text"), F.col("conv_id"), F.col("turn")).alias("key"), at.alias("at"))


def filled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    path, rows = new_path(spark, "cache"), requests(spark, sf_dir).where("turn % 2 = 0")
    whole = F.concat(F.lit('{"content": "answer '), "conv_id", F.lit('", "model": "m"}'))
    response = F.when(F.col("conv_id") % 7 == 0, F.left(whole, F.length(whole) - 3)).otherwise(whole)
    cache.append(rows.select("key", "at", F.lit("put").alias("action"), response.alias("response")), path)
    later = F.timestamp_seconds(F.unix_seconds("at") + 7200)
    cache.append(rows.where("conv_id % 3 = 0").select("key", later.alias("at"), F.lit("use").alias("action"), F.lit(None).cast("string").alias("response")), path)
    return cache.opened(spark, path), path


@query("cache_read", CACHE_SQL + "SELECT m.conv_id, m.turn, coalesce(readable, false) AS hit, CASE WHEN readable THEN 'answer ' || m.conv_id END AS content FROM m LEFT JOIN put USING (conv_id, turn)")
def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests against the cache: those never put and those that can't be read are misses."""
    return cache.looked_up(requests(spark, sf_dir), filled(spark, sf_dir)[0]).select("conv_id", "turn", "hit", "content")


@query("cache_hit_rate", CACHE_SQL + "SELECT m.turn, count(*) FILTER (readable) AS hits, count(*) FILTER (readable IS NOT TRUE) AS misses, round(count(*) FILTER (readable) / count(*), 3) AS hit_rate FROM m LEFT JOIN put USING (conv_id, turn) GROUP BY 1")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.hit_rate(cache.looked_up(requests(spark, sf_dir), filled(spark, sf_dir)[0]), "turn")


def _left(spark: SparkSession, sf_dir: str, evict) -> DataFrame:
    """The entries that are left once evict(entries) has been appended to the log."""
    log, path = filled(spark, sf_dir)
    cache.append(evict(cache.entries(log)), path)
    return cache.entries(cache.opened(spark, path)).select("key", "bytes")


@query("cache_by_age", CACHE_SQL + "SELECT key, bytes FROM h WHERE 10000 - used <= 3600")
def cache_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left(spark, sf_dir, lambda held: cache.unused(held, F.timestamp_seconds(F.lit(10_000)), 3600))


@query("cache_by_size", CACHE_SQL + ", s AS (SELECT *, sum(bytes) OVER (ORDER BY place) AS upto FROM h) SELECT key, bytes FROM s WHERE upto <= 5000")
def cache_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left(spark, sf_dir, lambda held: cache.over_size(held, F.timestamp_seconds(F.lit(10**9)), 5000))


@query("cache_unreadable", CACHE_SQL + "SELECT key, bytes FROM h WHERE readable")
def cache_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _left(spark, sf_dir, lambda held: cache.unreadable(held, F.timestamp_seconds(F.lit(10**9))))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assessments, their line items as requirements with a citation each."""
    item = F.struct(
        F.concat(F.lit("r"), "l_linenumber").alias("requirement"), F.when(F.col("l_quantity") > 25, "strong").otherwise("weak").alias("verdict"), F.col("l_discount").alias("points"),
        F.array(F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + 9).alias("end"), F.col("l_returnflag").alias("quote"))).alias("citations"),
    )
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("requirements"))
    return table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderstatus").alias("band"), F.col("o_totalprice").alias("score"), "requirements")


@query("payload_restore", """
SELECT o_orderkey, o_orderstatus AS band, o_totalprice AS score, 'r' || l_linenumber AS requirement, CASE WHEN l_quantity > 25 THEN 'strong' ELSE 'weak' END AS verdict, l_discount AS points, l_partkey AS start, l_partkey + 9 AS "end", l_returnflag AS quote
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def payload_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a variant, read, and restored: the same rows again."""
    path = new_path(spark, "assessments")
    payload.persisted(assessments(spark, sf_dir), "o_orderkey").write.parquet(path)
    whole, _ = payload.restored(spark.read.parquet(path), "o_orderkey")
    rows = whole.select("o_orderkey", "band", "score", F.inline("requirements"))
    return rows.select("o_orderkey", "band", "score", "requirement", "verdict", "points", F.inline("citations"))


@query("payload_damaged", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'no score' WHEN 3 THEN 'requirements of another type' END AS reason FROM orders WHERE o_orderkey % 5 IN (1, 2, 3) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def payload_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as JSON text, some cut short, some without a field, some with a field of another type: the damaged ones."""
    rows, k = assessments(spark, sf_dir), F.col("o_orderkey") % 5
    whole = F.to_json(F.struct(*payload.FIELDS))
    text = F.when(k == 1, F.left(whole, F.length(whole) - 4)).when(k == 2, F.to_json(F.struct("band", "requirements"))).when(k == 3, F.to_json(F.struct("band", "score", F.lit("all met").alias("requirements")))).otherwise(whole)
    return payload.restored(payload.parsed(rows.select("o_orderkey", text.alias("json")), "json"), "o_orderkey")[1]
