"""Evaluation queries: customers as candidates; score = balance, human = tier of their number of orders, job = market segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import metrics
from quillsift.plans.registry import query, table

PAIR_SQL = """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT c_mktsegment AS job, c_custkey AS item, c_acctbal AS score, least(4, coalesce(n, 0) // 4)::DOUBLE AS human FROM customer LEFT JOIN n ON o_custkey = c_custkey),
a AS (SELECT *, rank() OVER (PARTITION BY job ORDER BY score) + (count(*) OVER (PARTITION BY job, score) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY job ORDER BY human) + (count(*) OVER (PARTITION BY job, human) - 1) / 2.0::DOUBLE AS y FROM p)
"""
TIE_SQL = PAIR_SQL.replace("c_acctbal AS score", "floor(c_acctbal / 1000) AS score")
KENDALL_SQL = TIE_SQL + """,
k AS (SELECT i.job, count_if((i.score - j.score) * (i.human - j.human) > 0) AS c, count_if((i.score - j.score) * (i.human - j.human) < 0) AS d, count_if(i.score = j.score) AS tx, count_if(i.human = j.human) AS ty, count_if(i.score = j.score AND i.human = j.human) AS tb,
  count_if(i.human <> j.human) AS comparable FROM p i JOIN p j ON i.job = j.job AND i.item < j.item GROUP BY 1)
"""


def pairs(spark: SparkSession, sf_dir: str, tied: bool = False) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    human = F.least(F.lit(4), F.floor(F.coalesce("n", F.lit(0)) / 4)).cast("double")
    score = F.floor(F.col("c_acctbal") / 1000).cast("double") if tied else F.col("c_acctbal")
    return rows.select(F.col("c_mktsegment").alias("job"), F.col("c_custkey").alias("item"), score.alias("score"), human.alias("human"))


@query("avg_ranks", PAIR_SQL + "SELECT job, item, x AS score_rank, y AS human_rank FROM a")
def avg_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return metrics.average_ranks(metrics.average_ranks(p, "score", "score_rank", "job"), "human", "human_rank", "job").select("job", "item", "score_rank", "human_rank")


@query("zscore_pool", PAIR_SQL + "SELECT job, item, round(CASE WHEN count(*) OVER w >= 2 AND stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 6) AS z FROM p WINDOW w AS (PARTITION BY job)")
def zscore_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.z_scores(pairs(spark, sf_dir), "score", "z", "job").select("job", "item", "z")


@query("pearson", PAIR_SQL + "SELECT job, round(CASE WHEN count(*) >= 2 AND stddev_pop(score) * stddev_pop(human) > 0 THEN covar_pop(score, human) / (stddev_pop(score) * stddev_pop(human)) ELSE 0 END, 6) AS pearson, count(*) AS n FROM p GROUP BY 1")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pearson(pairs(spark, sf_dir), "job")


@query("spearman", PAIR_SQL + "SELECT job, round(CASE WHEN count(*) >= 2 AND stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END, 6) AS spearman, count(*) AS n FROM a GROUP BY 1")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(pairs(spark, sf_dir), "job")


@query("kendall_tau", KENDALL_SQL + "SELECT job, round(CASE WHEN (c + d + tx) * (c + d + ty) > 0 THEN (c - d) / sqrt((c + d + tx)::DOUBLE * (c + d + ty)) ELSE 0 END, 6) AS kendall, round(CASE WHEN (c + d + tx - tb) * (c + d + ty - tb) > 0 THEN (c - d) / sqrt((c + d + tx - tb)::DOUBLE * (c + d + ty - tb)) ELSE 0 END, 6) AS tau_b FROM k")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kendall(pairs(spark, sf_dir, True), "job").select("job", "kendall", "tau_b")


@query("inversions", KENDALL_SQL + "SELECT job, d AS discordant, round(CASE WHEN comparable > 0 THEN d / comparable ELSE 0 END, 6) AS inversion_rate FROM k")
def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kendall(pairs(spark, sf_dir, True), "job").select("job", "discordant", "inversion_rate")


@query("topk_precision", PAIR_SQL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, item) AS r, row_number() OVER (PARTITION BY job ORDER BY human DESC, item) AS h FROM p), t AS (SELECT job, min(human) AS bar, count(*) AS k FROM o WHERE h <= 3 GROUP BY 1)
SELECT o.job, round(count_if(human >= bar) / any_value(k), 6) AS precision, any_value(k) AS k FROM o JOIN t USING (job) WHERE r <= 3 GROUP BY 1""")
def topk_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_k_precision(pairs(spark, sf_dir), 3, "item", "job")


@query("mae", PAIR_SQL + "SELECT job, round(avg(abs(score - human)), 6) AS mae FROM p GROUP BY 1")
def mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_absolute_error(pairs(spark, sf_dir), "job")


@query("distribution", PAIR_SQL + "SELECT job, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, round(min(score), 6) AS min, round(max(score), 6) AS max, count(*) AS n FROM p GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("job").agg(*metrics.distribution(F.col("score")))


@query("metric_block", TIE_SQL + """
SELECT job, count(*) AS n, count(DISTINCT human) > 1 AS usable, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 4) AS spearman, round(covar_pop(score, human) / (stddev_pop(score) * stddev_pop(human)), 4) AS pearson FROM a GROUP BY 1 HAVING count(DISTINCT human) > 1 AND count(DISTINCT score) > 1""")
def metric_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job, only where the labels differ; rounded to 4 places."""
    p = pairs(spark, sf_dir, True)
    usable = p.groupBy("job").agg(F.countDistinct("human").alias("h"), F.countDistinct("score").alias("s")).where("h > 1 AND s > 1").select("job", F.lit(True).alias("usable"))
    both = metrics.spearman(p, "job").join(metrics.pearson(p, "job").drop("n"), "job").join(usable, "job")
    return both.select("job", "n", "usable", F.round("spearman", 4).alias("spearman"), F.round("pearson", 4).alias("pearson"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: job = language, score = length, human = quality and not toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("lang").alias("job"), F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("score"), (F.col("quality") * 2 - F.col("toxic")).cast("double").alias("human"))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bootstrap(labelled(spark, sf_dir), "job")


@query("random_ceiling")
def random_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chance_ceiling(labelled(spark, sf_dir), metrics.TRIALS, metrics.TRIAL_SEED, "job")


@query("regression_gate", """
WITH s AS (SELECT s_suppkey AS run, s_acctbal / 10000 AS spearman, (s_suppkey % 10) / 10.0::DOUBLE AS best, (s_suppkey % 7) / 10.0::DOUBLE AS ceiling, 1 - (s_suppkey % 5) / 20.0::DOUBLE AS validity, (s_suppkey % 3) / 3.0::DOUBLE AS agreement, (s_suppkey % 11) / 11.0::DOUBLE AS old, 0.5::DOUBLE AS old_agreement, s_suppkey % 4 > 0 AS stored FROM supplier),
f AS (SELECT run, concat_ws(',', CASE WHEN spearman <= best THEN 'baseline' END, CASE WHEN spearman <= ceiling THEN 'noise' END, CASE WHEN validity < 0.9::DOUBLE THEN 'validity' END, CASE WHEN stored AND old - spearman > 0.05::DOUBLE THEN 'drop' END, CASE WHEN stored AND old_agreement - agreement > 0.05::DOUBLE THEN 'consistency' END) AS failures FROM s)
SELECT run, failures, failures = '' AS passed FROM f""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as evaluation runs with made-up numbers; three quarters have stored ones to be compared with."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    run = s.select(k.alias("run"), (F.col("s_acctbal") / 10000).alias("spearman"), (k % 10 / F.lit(10.0)).alias("best_baseline"), (k % 7 / F.lit(10.0)).alias("ceiling"), (1 - k % 5 / F.lit(20.0)).alias("validity"), (k % 3 / F.lit(3.0)).alias("agreement"))
    stored = s.where(k % 4 > 0).select(k.alias("run"), (k % 11 / F.lit(11.0)).alias("spearman"), F.lit(0.5).alias("agreement"))
    return metrics.gate(run, stored)
