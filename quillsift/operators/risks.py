"""Flags on a candidate: gaps between roles, vague claims, missing links, weak grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.dates import PRESENT

# Phrases of a vague claim.
VAGUE = ["responsible for", "worked on", "helped with", "involved in", "participated in", "assisted with", "familiar with", "exposure to"]
GAP_MONTHS, LEAST_GROUNDING, MAX_GAPS = 12, 0.7, 8


def is_vague(claim: Column) -> Column:
    return ~claim.rlike("[0-9]") & F.lower(claim).rlike("|".join(VAGUE))


def role_end(start: Column, end: Column, current: Column) -> Column:
    """A role that goes on ends at PRESENT; one whose end can't be read ends where it starts."""
    return F.when(current, F.lit(PRESENT)).otherwise(F.least(F.coalesce(end, start), F.lit(PRESENT)))


def employment_gaps(periods: DataFrame) -> DataFrame:
    """(document_id, start, gap): a year or more between a role and the latest end before it; ongoing roles leave no gap."""
    before = Window.partitionBy("document_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = periods.where("start IS NOT NULL").withColumn("latest", F.max("end").over(before))
    return rows.where((F.col("start") - F.col("latest") >= GAP_MONTHS) & (F.col("latest") != PRESENT)).select("document_id", "start", (F.col("start") - F.col("latest")).alias("gap"))


def vague_claims(highlights: DataFrame) -> DataFrame:
    """Candidates with three or more highlights of which two or more are vague: (document_id, n_highlights, n_vague)."""
    got = highlights.groupBy("document_id").agg(F.count("*").alias("n_highlights"), F.count_if(is_vague(F.col("text"))).alias("n_vague"))
    return got.where("n_highlights >= 3 AND n_vague >= 2")


def unlinked_projects(projects: DataFrame) -> DataFrame:
    """Candidates with two or more projects without a link: level medium, the first four names."""
    bare = F.coalesce(F.col("url"), F.lit("")) == ""
    names = F.array_sort(F.collect_list(F.when(bare, F.struct("seq", "name"))))
    got = projects.groupBy("document_id").agg(F.count_if(bare).alias("n_unlinked"), names.alias("_n"))
    return got.where("n_unlinked >= 2").select("document_id", "n_unlinked", F.lit("medium").alias("level"), F.array_join(F.transform(F.slice("_n", 1, 4), lambda x: x["name"]), ", ").alias("names"))


def grounding_flags(stats: DataFrame) -> DataFrame:
    """From (document_id, total, grounded, failed_sections): low_grounding and failed_sections rows, both high."""
    rate = F.col("grounded") / F.col("total")
    low = stats.where((F.col("total") > 0) & (rate < LEAST_GROUNDING)).select("document_id", F.lit("low_grounding").alias("code"), F.lit("high").alias("level"))
    failed = stats.where(F.col("failed_sections") > 0).select("document_id", F.lit("failed_sections").alias("code"), F.lit("high").alias("level"))
    return low.unionByName(failed)


def judgement_flags(scored: DataFrame, *keys: str) -> DataFrame:
    """unmet_must_have (high) and ambiguous_judgement (medium) with the first three requirements."""
    def flag(code: str, level: str, when: Column) -> DataFrame:
        rows = scored.where(when).groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("requirement")), 1, 3).cast("array<string>"), ",").alias("first"))
        return rows.select(*keys, F.lit(code).alias("code"), F.lit(level).alias("level"), "n", "first")

    return flag("unmet_must_have", "high", (F.col("kind") == "must_have") & F.col("is_unmet")).unionByName(flag("ambiguous_judgement", "medium", F.col("ambiguous")))


def interview_gaps(scored: DataFrame, *keys: str) -> DataFrame:
    """At most eight reasons to ask, in order: unmet must-haves, partial evidence, ambiguous verdicts not named yet."""
    kind = F.when((F.col("kind") == "must_have") & F.col("is_unmet"), 0).when(F.col("verdict") == "partial", 1).when(F.col("ambiguous"), 2)
    rows = scored.withColumn("reason", kind).where("reason IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("reason", "requirement")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_GAPS).select(*keys, "place", "requirement", "reason")
