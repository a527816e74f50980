"""Sampled verdicts to scores, bands, gates and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import let

# Ordinal verdicts and what they are worth; kinds of requirement and their raw weights.
VERDICTS = {"none": 0.0, "weak": 0.2, "partial": 0.5, "clear": 0.8, "strong": 1.0}
KIND_WEIGHTS = {"must_have": 3.0, "nice_to_have": 1.0, "bonus": 0.5}
NAMES = list(VERDICTS)
AMBIGUOUS = 0.3


def worth(verdict: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in VERDICTS.items():
        out = F.when(verdict == k, F.lit(v)).otherwise(out)
    return out


def ordinal(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, NAMES)), verdict).cast("int") - 1


def asked_words(requirement: Column) -> Column:
    """The words of more than four letters of a requirement, as the built-in judge seeks them."""
    return F.transform(F.filter(F.split(F.lower(requirement), r"\s+"), lambda w: F.length(w) > 4), lambda w: F.regexp_replace(F.regexp_replace(w, "^[,.]+|[,.]+$", ""), "s+$", ""))


def overlap(words: Column, evidence: Column) -> Column:
    """Share of asked_words() that are found in the evidence; 0 without words."""
    return let(F.struct(words.alias("a"), F.lower(evidence).alias("e")), lambda x: F.size(F.filter(x["a"], lambda w: x["e"].contains(w))) / F.greatest(F.size(x["a"]), F.lit(1)))


#: Least shares of the verdicts, the best first; a weak one must be above its own.
LEAST_SHARES = {"strong": 0.55, "clear": 0.38, "partial": 0.22, "weak": 0.08}


def ordinal_of_share(share: Column) -> Column:
    """Place in NAMES of the built-in judge's verdict for a share of words."""
    strong, clear, partial, weak = LEAST_SHARES.values()
    return F.when(share >= strong, 4).when(share >= clear, 3).when(share >= partial, 2).when(share > weak, 1).otherwise(0)


def judged_by_overlap(requirement: Column, evidence: Column, leniency: float = 0.0) -> Column:
    """Verdict of the built-in judge: share of the requirement's words of more than four letters found in the evidence,
    and so much more if it's lenient (less, if negative)."""
    return F.element_at(F.array(*map(F.lit, NAMES)), let(overlap(asked_words(requirement), evidence) + leniency, ordinal_of_share) + 1)


def consensus(samples: DataFrame, *keys: str) -> DataFrame:
    """Lower median of each key's sampled verdicts, their number, and the share that agrees with it (1 without samples)."""
    rows = samples.withColumn("_o", ordinal(F.col("verdict")))
    middle = F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _o)").cast("int"), F.lit(0))
    got = rows.groupBy(*keys).agg(F.count("_o").alias("n_samples"), middle.alias("_m"), F.collect_list("_o").alias("_all"), F.min(worth(F.col("verdict"))).alias("low"), F.max(worth(F.col("verdict"))).alias("high"))
    agree = F.when(F.size("_all") > 0, F.size(F.filter("_all", lambda o: o == F.col("_m"))) / F.size("_all")).otherwise(1.0)
    verdict = F.element_at(F.array(*map(F.lit, NAMES)), F.col("_m") + 1)
    return got.withColumns({"verdict": verdict, "agreement": F.round(agree, 6), "ambiguous": F.coalesce(F.col("high") - F.col("low") > F.lit(AMBIGUOUS), F.lit(False))}).drop("_m", "_all")


def requirement_scores(agreed: DataFrame, requirements: DataFrame) -> DataFrame:
    """Adds kind, weight, points, lowest and highest points, is_met and is_unmet; a partial verdict is neither."""
    rows = agreed.join(requirements, "requirement")
    value = worth(F.col("verdict"))
    return rows.withColumns({
        "points": F.col("weight") * value, "low_points": F.col("weight") * F.coalesce("low", value), "high_points": F.col("weight") * F.coalesce("high", value),
        "is_met": F.col("verdict").isin("strong", "clear"), "is_unmet": F.col("verdict").isin("none", "weak"),
    })


def band(score: Column, meets_all: Column) -> Column:
    return F.when(~meets_all, "missing_must_have").when(score >= 75, "strong").when(score >= 55, "solid").when(score >= 35, "mixed").otherwise("weak")


def candidate_scores(scored: DataFrame, *keys: str) -> DataFrame:
    """One row per candidate: score and its range, agreement, must-have gate, band."""
    must = F.col("kind") == "must_have"
    got = scored.groupBy(*keys).agg(
        F.round(F.sum("points"), 1).alias("score"), F.round(F.sum("low_points"), 1).alias("score_low"), F.round(F.sum("high_points"), 1).alias("score_high"),
        F.round(F.coalesce(F.avg("agreement"), F.lit(1.0)), 3).alias("mean_agreement"), F.count_if(must & F.col("is_unmet")).alias("unmet_must_haves"), F.count_if("ambiguous").alias("n_ambiguous"),
    )
    met = F.col("unmet_must_haves") == 0
    return got.withColumns({"uncertainty": F.round(F.col("score_high") - F.col("score_low"), 1), "meets_all": met, "band": band(F.col("score"), met)})


def shortlist(candidates: DataFrame, k: int, seq: str, *groups: str) -> DataFrame:
    """The k best of each group: those that meet all must-haves first, then by score, then by seq."""
    order = Window.partitionBy(*groups).orderBy(F.desc("meets_all"), F.desc("score"), seq)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rubric(raw: DataFrame) -> DataFrame:
    """Requirements (job, seq, text, kind) without repeats (by collapsed, lower-cased text), weights adding up to 100.

    The rounding drift goes to the first requirement.
    """
    from quillsift.functions.text import normalised

    first = Window.partitionBy("job", normalised(F.col("text"))).orderBy("seq")
    rows = raw.where(normalised(F.col("text")) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    base = F.lit(None).cast("double")
    for k, v in KIND_WEIGHTS.items():
        base = F.when(F.col("kind") == k, F.lit(v)).otherwise(base)
    job = Window.partitionBy("job")
    rows = rows.withColumn("_w", base).withColumn("weight", F.round(F.col("_w") * 100 / F.sum("_w").over(job), 2))
    drift = F.round(100 - F.sum("weight").over(job), 2)
    place = F.row_number().over(job.orderBy("seq"))
    rows = rows.withColumns({"_d": drift, "place": place})
    return rows.select("job", "seq", "place", "text", "kind", F.round(F.col("weight") + F.when(F.col("place") == 1, F.col("_d")).otherwise(0.0), 2).alias("weight"))
