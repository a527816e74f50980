"""Scoring queries: line items are sampled verdicts; order = candidate, part modulo 4 = requirement.

(l_orderkey, l_linenumber) is no key, so samples are a multiset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import risks, scoring
from quillsift.plans.registry import query, table

# Fixed values of this catalogue: requirement, kind, weight.
REQUIREMENTS = [(0, "must_have", 40.0), (1, "must_have", 30.0), (2, "nice_to_have", 20.0), (3, "bonus", 10.0)]
SAMPLE_SQL = """
WITH q(requirement, kind, weight) AS (VALUES (0, 'must_have', 40.0::DOUBLE), (1, 'must_have', 30.0::DOUBLE), (2, 'nice_to_have', 20.0::DOUBLE), (3, 'bonus', 10.0::DOUBLE)),
s AS (SELECT l_orderkey AS candidate, (l_partkey % 4)::INT AS requirement, least(4, floor(l_quantity / 10))::INT AS o, [0.0::DOUBLE, 0.2, 0.5, 0.8, 1.0][least(4, floor(l_quantity / 10))::INT + 1] AS v FROM lineitem),
m AS (SELECT candidate, requirement, count(*) AS n_samples, quantile_disc(o, 0.5) AS m, min(v) AS low, max(v) AS high, list(o) AS os FROM s GROUP BY 1, 2),
c AS (SELECT candidate, requirement, n_samples, low, high, ['none', 'weak', 'partial', 'clear', 'strong'][m + 1] AS verdict, round(len(list_filter(os, lambda x: x = m)) / len(os), 6) AS agreement, high - low > 0.3::DOUBLE AS ambiguous, [0.0::DOUBLE, 0.2, 0.5, 0.8, 1.0][m + 1] AS value FROM m),
r AS (SELECT c.*, kind, weight, weight * value AS points, weight * low AS low_points, weight * high AS high_points, verdict IN ('strong', 'clear') AS is_met, verdict IN ('none', 'weak') AS is_unmet FROM c JOIN q USING (requirement)),
t AS (SELECT candidate, round(sum(points), 1) AS score, round(sum(low_points), 1) AS score_low, round(sum(high_points), 1) AS score_high, round(avg(agreement), 3) AS mean_agreement, count_if(kind = 'must_have' AND is_unmet) AS unmet_must_haves, count_if(ambiguous) AS n_ambiguous FROM r GROUP BY 1),
b AS (SELECT *, round(score_high - score_low, 1) AS uncertainty, unmet_must_haves = 0 AS meets_all, CASE WHEN unmet_must_haves > 0 THEN 'missing_must_have' WHEN score >= 75 THEN 'strong' WHEN score >= 55 THEN 'solid' WHEN score >= 35 THEN 'mixed' ELSE 'weak' END AS band FROM t)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.least(F.lit(4), F.floor(F.col("l_quantity") / 10)).cast("int")
    verdict = F.element_at(F.array(*map(F.lit, scoring.NAMES)), level + 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), (F.col("l_partkey") % 4).cast("int").alias("requirement"), verdict.alias("verdict"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    requirements = F.broadcast(spark.createDataFrame(REQUIREMENTS, "requirement int, kind string, weight double"))  # four rows
    return scoring.requirement_scores(scoring.consensus(samples(spark, sf_dir), "candidate", "requirement"), requirements)


@query("verdict_consensus", SAMPLE_SQL + "SELECT candidate, requirement, n_samples, verdict, agreement FROM c")
def verdict_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.consensus(samples(spark, sf_dir), "candidate", "requirement").select("candidate", "requirement", "n_samples", "verdict", "agreement")


@query("ambiguity", SAMPLE_SQL + "SELECT candidate, requirement, ambiguous FROM c")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.consensus(samples(spark, sf_dir), "candidate", "requirement").select("candidate", "requirement", "ambiguous")


@query("requirement_scores", SAMPLE_SQL + "SELECT candidate, requirement, kind, points, low_points, high_points, is_met, is_unmet FROM r")
def requirement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("candidate", "requirement", "kind", "points", "low_points", "high_points", "is_met", "is_unmet")


@query("candidate_scores", SAMPLE_SQL + "SELECT candidate, score, score_low, score_high, uncertainty, mean_agreement, unmet_must_haves, n_ambiguous FROM b")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.candidate_scores(scored(spark, sf_dir), "candidate").drop("meets_all", "band")


@query("score_band", SAMPLE_SQL + "SELECT band, count(*) AS n, round(avg(score), 4) AS mean_score FROM b GROUP BY 1")
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.candidate_scores(scored(spark, sf_dir), "candidate").groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("shortlist", SAMPLE_SQL + ", x AS (SELECT b.*, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY meets_all DESC, score DESC, candidate) AS rank FROM b JOIN orders ON o_orderkey = candidate) SELECT o_custkey AS job, candidate, score, meets_all, rank FROM x WHERE rank <= 3")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each customer's orders."""
    c = scoring.candidate_scores(scored(spark, sf_dir), "candidate")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate"), F.col("o_custkey").alias("job"))
    return scoring.shortlist(c.join(jobs, "candidate"), 3, "candidate", "job").select("job", "candidate", "score", "meets_all", F.col("rank").cast("long"))


@query("biggest_losses", SAMPLE_SQL + ", x AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY kind = 'must_have' DESC, weight - points DESC, requirement) AS place FROM r) SELECT candidate, requirement, round(weight - points, 6) AS lost, place FROM x WHERE place <= 2")
def biggest_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of a candidate, must-haves first, then by what they cost; the first two."""
    from pyspark.sql import Window

    lost = F.col("weight") - F.col("points")
    order = Window.partitionBy("candidate").orderBy(F.desc(F.col("kind") == "must_have"), lost.desc(), "requirement")
    return scored(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 2").select("candidate", "requirement", F.round(lost, 6).alias("lost"), F.col("place").cast("long"))


@query("judgement_flags", SAMPLE_SQL + """
SELECT candidate, 'unmet_must_have' AS code, 'high' AS level, count(*) AS n, array_to_string(list_sort(list(requirement))[1:3], ',') AS first FROM r WHERE kind = 'must_have' AND is_unmet GROUP BY 1 UNION ALL
SELECT candidate, 'ambiguous_judgement', 'medium', count(*), array_to_string(list_sort(list(requirement))[1:3], ',') FROM r WHERE ambiguous GROUP BY 1""")
def judgement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks.judgement_flags(scored(spark, sf_dir), "candidate")


@query("grounding_flags", """
WITH g AS (SELECT l_orderkey AS document_id, count(*) AS total, count_if(l_returnflag <> 'A') AS grounded, count_if(l_linestatus = 'F' AND l_discount > 0.09) AS failed FROM lineitem GROUP BY 1)
SELECT document_id, 'low_grounding' AS code, 'high' AS level FROM g WHERE total > 0 AND grounded / total < 0.7::DOUBLE UNION ALL SELECT document_id, 'failed_sections', 'high' FROM g WHERE failed > 0""")
def grounding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") != "A").alias("grounded"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.09)).alias("failed_sections"))
    return risks.grounding_flags(stats)


@query("rubric_weights", """
WITH w AS (SELECT o_custkey AS job, o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN 'must_have' WHEN o_orderstatus = 'F' THEN 'nice_to_have' ELSE 'bonus' END AS kind, o_orderpriority AS text FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY job, lower(text) ORDER BY seq) AS n FROM w), k AS (SELECT *, CASE kind WHEN 'must_have' THEN 3.0::DOUBLE WHEN 'nice_to_have' THEN 1.0 ELSE 0.5 END AS base FROM f WHERE n = 1),
x AS (SELECT *, round(base * 100 / sum(base) OVER (PARTITION BY job), 2) AS weight, row_number() OVER (PARTITION BY job ORDER BY seq) AS place FROM k),
d AS (SELECT *, round(100 - sum(weight) OVER (PARTITION BY job), 2) AS drift FROM x)
SELECT job, seq, place, kind, round(weight + CASE WHEN place = 1 THEN drift ELSE 0 END, 2) AS weight FROM d""")
def rubric_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "must_have").when(F.col("o_orderstatus") == "F", "nice_to_have").otherwise("bonus")
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq"), F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("text"), kind.alias("kind"))
    return scoring.rubric(raw).select("job", "seq", F.col("place").cast("long"), "kind", "weight")


@query("quality_block", SAMPLE_SQL + "SELECT round(avg(agreement), 6) AS mean_agreement, round(count_if(ambiguous) / count(*), 6) AS ambiguous_share, (SELECT round(count_if(NOT meets_all) / count(*), 6) FROM b) AS unmet_share, (SELECT round(avg(uncertainty), 6) FROM b) AS mean_band FROM r")
def quality_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: agreement, share of ambiguous requirements, share of candidates with an unmet must-have, mean range."""
    c = scoring.candidate_scores(scored(spark, sf_dir).withColumn("_a", F.col("agreement")), "candidate")
    r = scored(spark, sf_dir).agg(F.round(F.avg("agreement"), 6).alias("mean_agreement"), F.round(F.count_if("ambiguous") / F.count("*"), 6).alias("ambiguous_share"))
    b = c.agg(F.round(F.count_if(~F.col("meets_all")) / F.count("*"), 6).alias("unmet_share"), F.round(F.avg("uncertainty"), 6).alias("mean_band"))
    one = F.lit(1).alias("one")
    return r.select("*", one).join(b.select("*", one), "one").drop("one")


@query("cost_block", """
SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count_if((json_extract(props, '$.k'))::INT % 2 = 0) / count(*), 6) AS hit_rate FROM events GROUP BY 1""")
def cost_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls: value is the latency, an even k in props a cache hit."""
    hit = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.count_if(hit) / F.count("*"), 6).alias("hit_rate")
    )
