"""Human labels: upserts, what is missing, coverage, warnings. Rows (job, candidate, tier, rationale, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tiers from worst to best.
TIERS = ["reject", "weak", "mixed", "solid", "strong"]


def upsert(old: DataFrame, new: DataFrame, *keys: str, replace: bool = True) -> DataFrame:
    """Union by key: new rows replace old ones (labels), or old ones stay (jobs, documents); the last new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.desc("_new") if replace else F.asc("_new")
    order = Window.partitionBy(*keys).orderBy(first, F.desc("seq") if replace else F.asc("seq"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def missing(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected (job, candidate) pairs without a label."""
    return expected.join(labels, ["job", "candidate"], "left_anti")


def tier_distribution(labels: DataFrame) -> DataFrame:
    """(job, tier, n) with zeros for tiers that a job doesn't use."""
    counts = labels.groupBy("job").pivot("tier", TIERS).agg(F.count(F.lit(1)))
    pairs = F.array(*[F.struct(F.lit(t).alias("tier"), F.coalesce(F.col(t), F.lit(0)).alias("n")) for t in TIERS])
    return counts.select("job", F.explode(pairs).alias("_p")).select("job", "_p.tier", "_p.n")


def quality_warnings(labels: DataFrame) -> DataFrame:
    """(job, code): too_few_labels stops the others; no_variance or low_variance; missing_rationales."""
    got = labels.groupBy("job").agg(F.count("*").alias("n"), F.countDistinct("tier").alias("tiers"), F.count_if(F.trim(F.coalesce("rationale", F.lit(""))) == "").alias("bare"))
    few = F.col("n") < 5
    codes = F.array_compact(F.array(F.when(few, "too_few_labels"), F.when(~few & (F.col("tiers") < 2), "no_variance").when(~few & (F.col("tiers") == 2), "low_variance"), F.when(~few & (F.col("bare") > F.col("n") / 2), "missing_rationales")))
    return got.select("job", F.explode(codes).alias("code"))


def in_given_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the asked ids (pos, key) in the order asked; unknown ids are left out."""
    return ids.join(rows, key).orderBy("pos")


def unknown(ids: DataFrame, rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The first k asked ids (pos, key) that aren't there."""
    return ids.join(rows, key, "left_anti").orderBy("pos").limit(k)


def page(rows: DataFrame, limit: int, offset: int, *order, most: int = 200) -> DataFrame:
    """One page of a listing, the limit held to 1..most."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
