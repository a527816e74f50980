"""Audit queries: orders as observations; candidate = customer, axis = priority (one is the control), group = status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import audit
from quillsift.plans.registry import query, table

AXES = {"1-URGENT": "gender", "2-HIGH": "ethnicity", "3-MEDIUM": "university", "4-NOT SPECIFIED": "location", "5-LOW": "null"}
AXIS_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AXES.items()) + " END"
OBS_SQL = f"""
WITH o AS (SELECT o_custkey AS candidate, {AXIS_SQL} AS axis, o_orderstatus AS "group", o_orderkey % 2 = 0 AS blind, round(o_totalprice / 5000, 2) AS score, o_orderkey AS k, o_orderkey % 5 > 0 AS meets FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY axis, "group", blind ORDER BY score DESC, candidate, k) AS rank FROM o),
e AS (SELECT axis, blind, candidate, count(*) AS n, max(score) - min(score) AS drift, min(rank) < max(rank) AS flip, min(meets::INT) <> max(meets::INT) AS must FROM r GROUP BY 1, 2, 3),
x AS (SELECT axis, blind, sum(n)::BIGINT AS observations, round(coalesce(max(drift) FILTER (n >= 2), 0), 2) AS max_drift, round(coalesce(avg(drift) FILTER (n >= 2), 0), 2) AS mean_drift, count_if(n >= 2 AND flip) AS rank_flips, count_if(n >= 2 AND must) AS must_have_flips FROM e GROUP BY 1, 2),
f AS (SELECT round(coalesce(avg(mean_drift), 0), 4) AS floor_mean, coalesce(max(max_drift), 0) AS floor_max FROM x WHERE axis = 'null'),
d AS (SELECT x.*, round(greatest(0, max_drift - floor_max), 4) AS excess FROM x, f WHERE axis <> 'null')
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.lit(None).cast("string")
    for k, v in AXES.items():
        axis = F.when(F.col("o_orderpriority") == k, v).otherwise(axis)
    k = F.col("o_orderkey")
    obs = table(spark, sf_dir, "orders").select(F.struct(F.col("o_custkey"), k).alias("candidate"), axis.alias("axis"), F.col("o_orderstatus").alias("group"), (k % 2 == 0).alias("blind"), F.round(F.col("o_totalprice") / 5000, 2).alias("score"), (k % 5 > 0).cast("int").alias("meets"))
    return audit.ranked(obs, "axis", "group", "blind").withColumn("candidate", F.col("candidate.o_custkey"))


@query("rank_flips", OBS_SQL + "SELECT axis, blind, rank_flips, must_have_flips FROM x")
def rank_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.axis_results(observations(spark, sf_dir)).select("axis", "blind", "rank_flips", "must_have_flips")


@query("axis_results", OBS_SQL + "SELECT axis, blind, observations, max_drift, mean_drift FROM x")
def axis_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.axis_results(observations(spark, sf_dir)).select("axis", "blind", "observations", "max_drift", "mean_drift")


@query("group_gap", OBS_SQL + """, g AS (SELECT axis, blind, "group", round(avg(score), 2) AS mean FROM o GROUP BY 1, 2, 3)
SELECT axis, blind, count(*) AS groups, round(CASE WHEN count(*) > 1 THEN max(mean) - min(mean) ELSE 0 END, 2) AS gap, arg_max("group", mean) AS favoured, arg_min("group", mean) AS disfavoured FROM g GROUP BY 1, 2""")
def group_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.group_gaps(observations(spark, sf_dir))


@query("noise_floor", OBS_SQL + "SELECT floor_mean, floor_max FROM f")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.noise_floor(audit.axis_results(observations(spark, sf_dir)))


@query("excess_drift", OBS_SQL + "SELECT axis, blind, excess, excess <= 2.0 AS within FROM d")
def excess_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = audit.axis_results(observations(spark, sf_dir))
    floor = audit.noise_floor(results).first()["floor_max"]
    return audit.excess(results, floor).select("axis", "blind", "excess", "within")


@query("audit_gate", OBS_SQL + """,
s AS (SELECT CASE WHEN blind AND excess > 2 THEN axis || ':drift' END AS a, CASE WHEN blind AND must_have_flips > 0 THEN axis || ':must_have' END AS b,
  CASE WHEN blind AND must_have_flips = 0 AND rank_flips > 0 THEN axis || ':rank' WHEN NOT blind AND excess > 2 THEN axis || ':sighted' END AS c FROM d),
l AS (SELECT list_sort(coalesce(list(a) FILTER (a IS NOT NULL), []) || coalesce(list(b) FILTER (b IS NOT NULL), []) || CASE WHEN (SELECT floor_max FROM f) > 2 THEN ['noise'] ELSE [] END) AS fails, list_sort(coalesce(list(c) FILTER (c IS NOT NULL), [])) AS notes FROM s)
SELECT array_to_string(fails, ',') AS failures, array_to_string(notes, ',') AS notes, len(fails) = 0 AS passed FROM l""")
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gate(audit.axis_results(observations(spark, sf_dir)))


# Variants: nations, by region as axis; the first two of each axis, all of the control's.
VARIANT_SQL = """
WITH v AS (SELECT CASE n_regionkey WHEN 0 THEN 'null' ELSE 'axis' || n_regionkey END AS axis, n_name AS label, 'g' || n_nationkey % 2 AS "group", n_nationkey AS seq FROM nation),
k AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY seq) AS n FROM v), c AS (SELECT axis, label, "group" FROM k WHERE n <= 2 OR axis = 'null')
"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.when(F.col("n_regionkey") == 0, "null").otherwise(F.concat(F.lit("axis"), F.col("n_regionkey")))
    return table(spark, sf_dir, "nation").select(axis.alias("axis"), F.col("n_name").alias("label"), F.concat(F.lit("g"), F.col("n_nationkey") % 2).alias("group"), F.col("n_nationkey").alias("seq"))


@query("variant_plan", VARIANT_SQL + 'SELECT axis, label, "group" FROM c')
def variant_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.plan(variants(spark, sf_dir), 2).select("axis", "label", "group")


@query("experiment_matrix", VARIANT_SQL + 'SELECT s_suppkey AS profile, axis, label, "group", blind FROM supplier, c, (VALUES (true), (false)) m(blind)')
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("profile"))
    return audit.matrix(profiles, audit.plan(variants(spark, sf_dir), 2))


@query("cost_estimate", VARIANT_SQL + "SELECT count(*) * (SELECT count(*) FROM supplier) * 2 * (6 + 8 * 5) AS calls FROM c")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a model for the whole matrix: 6 sections and 8 requirements judged 5 times."""
    return experiment_matrix(spark, sf_dir).agg((F.count("*") * (6 + 8 * 5)).alias("calls"))
