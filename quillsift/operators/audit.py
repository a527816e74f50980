"""Counterfactual audits: the experiment matrix, ranks, drift, group gaps, noise floor, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 2.0
#: Variants times modes that are broadcast.
MOST_CELLS = 100_000


def plan(variants: DataFrame, per_axis: int) -> DataFrame:
    """The first variants of each axis, in order; controls (axis null) are all kept."""
    order = Window.partitionBy("axis").orderBy("seq")
    return variants.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= per_axis) | (F.col("axis") == "null")).drop("_n")


def matrix(profiles: DataFrame, variants: DataFrame, modes: tuple[bool, ...] = (True, False)) -> DataFrame:
    """Every profile with every variant and mode, which is what an experiment is. The variants of a plan go to the profiles where
    they are counted and few; else the profiles are laid out first."""
    cells = variants.select("axis", "label", "group", F.explode(F.array(*map(F.lit, modes)).cast("array<boolean>")).alias("blind"))
    few = cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    return profiles.crossJoin(F.broadcast(cells) if few else cells)


def ranked(obs: DataFrame, *condition: str) -> DataFrame:
    """Rank of each observation among those of its condition, best score first, ties by candidate."""
    return obs.withColumn("rank", F.row_number().over(Window.partitionBy(*condition).orderBy(F.desc("score"), "candidate")))


def axis_results(obs: DataFrame) -> DataFrame:
    """Per (axis, blind): observations, drift over candidates with two rows and more, rank flips, must-have flips."""
    each = obs.groupBy("axis", "blind", "candidate").agg(
        F.count("*").alias("n"), (F.max("score") - F.min("score")).alias("drift"), (F.min("rank") < F.max("rank")).alias("flip"), (F.min("meets") != F.max("meets")).alias("must"),
    )
    many = F.col("n") >= 2
    return each.groupBy("axis", "blind").agg(
        F.sum("n").alias("observations"), F.round(F.coalesce(F.max(F.when(many, F.col("drift"))), F.lit(0.0)), 2).alias("max_drift"), F.round(F.coalesce(F.avg(F.when(many, F.col("drift"))), F.lit(0.0)), 2).alias("mean_drift"),
        F.count_if(many & F.col("flip")).alias("rank_flips"), F.count_if(many & F.col("must")).alias("must_have_flips"),
    )


def group_gaps(obs: DataFrame) -> DataFrame:
    """Per (axis, blind): gap between the highest and lowest rounded group mean, and which groups they are."""
    means = obs.groupBy("axis", "blind", "group").agg(F.round(F.avg("score"), 2).alias("mean"))
    best = F.max_by("group", F.struct("mean", "group"))
    return means.groupBy("axis", "blind").agg(F.count("*").alias("groups"), F.round(F.when(F.count("*") > 1, F.max("mean") - F.min("mean")).otherwise(0.0), 2).alias("gap"), best.alias("favoured"), F.min_by("group", F.struct("mean", "group")).alias("disfavoured"))


def noise_floor(results: DataFrame) -> DataFrame:
    """Over the control axis, blind and sighted: mean of mean drifts, largest drift."""
    got = results.where("axis = 'null'").agg(F.avg("mean_drift").alias("m"), F.max("max_drift").alias("x"))
    return got.select(F.round(F.coalesce("m", F.lit(0.0)), 4).alias("floor_mean"), F.coalesce("x", F.lit(0.0)).alias("floor_max"))


def excess(results: DataFrame, floor_max: float, threshold: float = THRESHOLD) -> DataFrame:
    """Drift above the noise floor, never below 0, and whether it stays within the threshold; without controls."""
    rows = results.where("axis <> 'null'").withColumn("excess", F.round(F.greatest(F.lit(0.0), F.col("max_drift") - F.lit(floor_max)), 4))
    return rows.withColumn("within", F.col("excess") <= threshold)


def gate(results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: failures and notes by axis, and whether the audit passes."""
    floor = noise_floor(results).first()
    rows = excess(results, floor["floor_max"], threshold)
    blind = F.col("blind")
    fail = F.when(blind & (F.col("excess") > threshold), F.concat("axis", F.lit(":drift")))
    must = F.when(blind & (F.col("must_have_flips") > 0), F.concat("axis", F.lit(":must_have")))
    note = F.when(blind & (F.col("must_have_flips") == 0) & (F.col("rank_flips") > 0), F.concat("axis", F.lit(":rank"))).when(~blind & (F.col("excess") > threshold), F.concat("axis", F.lit(":sighted")))
    got = rows.agg(F.collect_list(fail).alias("a"), F.collect_list(must).alias("b"), F.collect_list(note).alias("c"))
    noisy = F.when(F.lit(floor["floor_max"]) > threshold, F.array(F.lit("noise"))).otherwise(F.array().cast("array<string>"))
    said = F.array_sort(F.concat("a", "b", noisy))
    return got.select(F.array_join(said, ",").alias("failures"), F.array_join(F.array_sort("c"), ",").alias("notes"), (F.size(said) == 0).alias("passed"))
