"""Label and store queries: orders as labels; customer = job, order modulo 7 = candidate, price = tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import labels
from quillsift.plans.registry import query, table

TIER_LIST = ", ".join(f"'{t}'" for t in labels.TIERS)
LABEL_SQL = f"""
WITH l AS (SELECT o_custkey AS job, o_orderkey % 7 AS candidate, [{TIER_LIST}][(least(4, floor(o_totalprice / 100000)) + 1)::INT] AS tier, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'because' END AS rationale, o_orderkey AS seq FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY job, candidate ORDER BY seq DESC) AS n FROM l), v AS (SELECT * FROM n WHERE n = 1)
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tier = F.element_at(F.array(*map(F.lit, labels.TIERS)), (F.least(F.lit(4), F.floor(F.col("o_totalprice") / 100000)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), (k % 7).alias("candidate"), tier.alias("tier"), F.when(k % 3 == 0, "").otherwise("because").alias("rationale"), k.alias("seq"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after upserting the odd orders over the even ones, and each over its elders."""
    r = rows(spark, sf_dir)
    return labels.upsert(r.limit(0), r, "job", "candidate")


@query("label_upsert", LABEL_SQL + ", w AS (SELECT *, row_number() OVER (PARTITION BY job, candidate ORDER BY seq % 2 DESC, seq DESC) AS m FROM l) SELECT job, candidate, tier, seq FROM w WHERE m = 1")
def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return labels.upsert(r.where("seq % 2 = 0"), r.where("seq % 2 = 1"), "job", "candidate").select("job", "candidate", "tier", "seq")


@query("document_upsert", "SELECT o_custkey AS id, min(o_orderkey) AS seq FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are there already stay."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return labels.upsert(r.where("seq % 2 = 0"), r.where("seq % 2 = 1"), "id", replace=False)


@query("label_missing", LABEL_SQL + "SELECT c_custkey AS job, c.candidate FROM customer, range(7) c(candidate) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.job = c_custkey AND v.candidate = c.candidate)")
def label_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("candidate"))
    return labels.missing(expected, current(spark, sf_dir))


@query("tier_distribution", LABEL_SQL + f", t AS (SELECT unnest([{TIER_LIST}]) AS tier), j AS (SELECT DISTINCT job FROM v) SELECT j.job, t.tier, count(v.job) AS n FROM j CROSS JOIN t LEFT JOIN v ON v.job = j.job AND v.tier = t.tier GROUP BY 1, 2")
def tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.tier_distribution(current(spark, sf_dir))


@query("label_quality", LABEL_SQL + """,
g AS (SELECT job, count(*) AS n, count(DISTINCT tier) AS t, count_if(trim(rationale) = '') AS bare FROM v GROUP BY 1)
SELECT job, 'too_few_labels' AS code FROM g WHERE n < 5 UNION ALL SELECT job, CASE WHEN t < 2 THEN 'no_variance' ELSE 'low_variance' END FROM g WHERE n >= 5 AND t <= 2 UNION ALL SELECT job, 'missing_rationales' FROM g WHERE n >= 5 AND bare > n / 2""")
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.quality_warnings(current(spark, sf_dir))


@query("label_join", "SELECT (doc_id IN (SELECT doc_id FROM documents)) AS known, quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by whether their document is there."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d")).distinct()
    both = table(spark, sf_dir, "labels").join(docs, F.col("doc_id") == F.col("d"), "left")
    return both.groupBy(F.col("d").isNotNull().alias("known"), "quality", "toxic").agg(F.count("*").alias("n"))


@query("paged_listing", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 100")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, of 500 asked but 200 allowed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return labels.page(o, 500, 100, F.desc("o_orderdate"), "o_orderkey")


ASKED_SQL = "WITH a AS (SELECT event_id AS pos, user_id * 13 AS o_orderkey FROM events)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 13).alias("o_orderkey"))


@query("get_many_ordered", ASKED_SQL + "SELECT o_orderkey, pos, o_custkey FROM a JOIN orders USING (o_orderkey) ORDER BY pos")
def get_many_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.in_given_order(asked(spark, sf_dir), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "pos", "o_custkey")


@query("unknown_ids", ASKED_SQL + "SELECT o_orderkey, pos FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 2) ORDER BY pos LIMIT 5")
def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked ids that the store lacks; a fifth of the orders isn't stored."""
    return labels.unknown(asked(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 2").select("o_orderkey"), "o_orderkey").select("o_orderkey", "pos")


@query("cache_lookup", """
WITH r AS (SELECT conv_id, turn, sha256(role || chr(31) || text) AS key FROM conversations), c AS (SELECT DISTINCT key FROM r WHERE conv_id % 2 = 0)
SELECT conv_id, turn, key, key IN (SELECT key FROM c) AS hit FROM r""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests; the even conversations are in the cache."""
    from quillsift.sources.store import cache_keys, cached

    asked = cache_keys(table(spark, sf_dir, "conversations"), "role", "text").select("conv_id", "turn", "key")
    cache = asked.where("conv_id % 2 = 0").select("key", F.lit("answer").alias("response")).distinct()
    return cached(asked, cache).select("conv_id", "turn", "key", "hit")


@query("job_counts", "SELECT c_mktsegment AS segment, count(*) AS jobs, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("jobs"), F.countDistinct("c_nationkey").alias("nations"))
