"""Small column rules: labels, summaries, guards, guesses at sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import let

# What a posting says that lists requirements; characters a token; tokens of an answer if no limit is set.
STATES_REQUIREMENTS = ("requirement", "must have", "you will need", "essential")
CHARS_PER_TOKEN, ANSWER_TOKENS = 3.6, 700
THINKING, FENCE = r"(?is)<think>.*?</think>", r"(?s)```(?:json|JSON)?\s*(.*?)\s*```"
# Tier of a label that is made up from a profile's quality where the profile fits the job.
TIERS_OF_QUALITY = {"strong": "strong_yes", "solid": "yes", "mixed": "maybe", "weak": "no"}


def candidate_label(document_id: Column, filename: Column, blind: Column | bool) -> Column:
    return F.when(F.lit(blind) if isinstance(blind, bool) else blind, F.concat(F.lit("candidate-"), F.substring(document_id, 1, 8))).otherwise(filename)


def initials(label: Column) -> Column:
    """First letters of the first and last word, or two letters of a single word; ? without words. Runs of blanks and - part words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(label, r"[^\p{L}\p{N}\s-]", " ")), r"[\s-]+"), lambda w: w != "")
    last = lambda w: F.get(w, F.size(w) - 1)
    two = lambda w: F.when(F.size(w) == 0, "?").when(F.size(w) == 1, F.substring(F.get(w, F.lit(0)), 1, 2)).otherwise(F.concat(F.substring(F.get(w, F.lit(0)), 1, 1), F.substring(last(w), 1, 1)))
    return F.upper(let(words, two))


def contact_email(name: Column, email: Column) -> Column:
    """The email, or one made from the name."""
    made = F.concat(F.replace(F.replace(F.lower(name), F.lit(" "), F.lit(".")), F.lit("'"), F.lit("")), F.lit("@example.com"))
    return F.coalesce(F.nullif(email, F.lit("")), made)


def token_estimate(chars: Column, max_tokens: Column) -> Column:
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)) + F.coalesce(F.nullif(max_tokens, F.lit(0)), F.lit(ANSWER_TOKENS))


def rate_tone(rate: Column, good: float = 0.9) -> Column:
    return F.when(rate >= good, "strong").when(rate >= good - 0.2, "partial").otherwise("weak")


def said_score(score: Column, low: Column, high: Column, band: Column, agreement: Column) -> Column:
    return F.format_string("%.0f/100 (band %.0f to %.0f), %s, agreement %.0f%%", score, low, high, band, agreement * 100)


def line_at(text: Column, offset: Column) -> Column:
    """The line that holds a place of the text; the line end belongs to the line before it."""
    return F.concat(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1), F.substring_index(F.substring(text, offset + 1, F.length(text)), "\n", 1))


def box_union(a: Column, b: Column) -> Column:
    """Smallest box around two boxes (x0, y0, x1, y1), with its width and height."""
    x0, y0, x1, y1 = (F.least(a[k], b[k]) if k.endswith("0") else F.greatest(a[k], b[k]) for k in ("x0", "y0", "x1", "y1"))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))


def extract_json(answer: Column) -> Column:
    """The JSON in an answer: without thoughts and fences, the outermost {} that parses, else [], else what is left."""
    bare = F.trim(F.regexp_replace(answer, THINKING, ""))
    plain = let(bare, lambda t: F.when(t.rlike(FENCE), F.trim(F.regexp_extract(t, FENCE, 1))).otherwise(t))

    def outermost(t: Column, opened: str, closed: str) -> Column:
        found = F.regexp_extract(t, rf"(?s)(\{opened}.*\{closed})", 1)
        return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)

    return let(plain, lambda t: F.coalesce(outermost(t, "{", "}"), outermost(t, "[", "]"), t))


def github_url(profiles: Column) -> Column:
    """The url of the first profile (network, url) that is one of GitHub."""
    mine = F.filter(profiles, lambda p: F.lower(p["network"]).contains("github") | F.lower(p["url"]).contains("github.com"))
    return F.get(mine, F.lit(0))["url"]


def degenerate_rubrics(requirements: DataFrame, postings: DataFrame) -> DataFrame:
    """Jobs whose posting lists requirements while their rubric (job, kind) has no must-have: (job, n_requirements)."""
    counts = requirements.groupBy("job").agg(F.count("*").alias("n_requirements"), F.count_if(F.col("kind") == "must_have").alias("_m"))
    said = F.lower("text").rlike("|".join(STATES_REQUIREMENTS))
    return postings.where(said).select("job").join(counts, "job", "left").where(F.coalesce("_m", F.lit(0)) == 0).select("job", F.coalesce("n_requirements", F.lit(0)).alias("n_requirements"))


def bad_rubrics(requirements: DataFrame) -> DataFrame:
    """Jobs whose weights (job, weight) don't add up to 100, give or take a half."""
    return requirements.groupBy("job").agg(F.round(F.sum("weight"), 2).alias("total")).where(F.abs(F.col("total") - 100) > 0.5)


def first_per_quality(profiles: DataFrame, seq: str = "seq") -> DataFrame:
    """The first profile of each quality."""
    rest = [c for c in profiles.columns if c != "quality"]
    return profiles.groupBy("quality").agg(F.min_by(F.struct(*rest), seq).alias("p")).select("quality", "p.*")


def placeholder_tier(quality: Column, target: Column, job: Column) -> Column:
    """A made-up tier: by quality for the profile's own job, low for profiles without one, lowest for others."""
    own = F.lit("maybe")
    for k, v in TIERS_OF_QUALITY.items():
        own = F.when(quality == k, v).otherwise(own)
    return F.when(target == job, own).when(F.coalesce(target, F.lit("")) == "", F.when(quality == "mixed", "maybe").otherwise("no")).otherwise("strong_no")


def biased_verdict(verdict: Column, evidence: Column, favoured: list[str]) -> Column:
    """A judge with a bias that an audit must find: evidence that names a favoured institution counts as strong."""
    return F.when(F.exists(F.array(*map(F.lit, favoured)), lambda name: evidence.contains(name)), "strong").otherwise(verdict)


def overridden(overrides: Column, key: str, own: Column) -> Column:
    """A variant's value for a key of its map of overrides, else the profile's own."""
    return F.coalesce(F.try_element_at(overrides, F.lit(key)), own)


def roll_up(entries: DataFrame, *keys: str) -> DataFrame:
    """Of (keys, meets_must_haves, grounding_rate, validity_rate, agreement): number, number that meet all, mean rates."""
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return entries.groupBy(*keys).agg(F.count("*").alias("screened"), F.count_if("meets_must_haves").alias("meeting"), mean("grounding_rate"), mean("validity_rate"), mean("agreement"))


def paired_by_place(left: DataFrame, right: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of two tables of the same key and place among the key's rows, by equi-join; rows without a partner go."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(place))
    return left.withColumn("_n", n).join(right.withColumn("_n", n).drop(place), [key, "_n"]).drop("_n")
