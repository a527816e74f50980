"""Cited resumes as nested columns: each leaf is a value with the citations that it rests on; reading, counting and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = "struct<start:bigint,end:bigint,quote:string>"
CITED = f"struct<value:string,citations:array<{CITATION}>,confidence:double>"
#: Cited leaves of an entry, in order, and its lists of them.
LEAVES = {
    "profiles": (["network", "url"], []), "work": (["company", "position", "start_date", "end_date"], ["highlights"]),
    "education": (["institution", "degree", "field_of_study", "start_date", "end_date", "score"], []), "projects": (["name", "description", "url"], ["technologies", "highlights"]),
    "skills": (["name"], []), "awards": (["title", "awarder", "date"], []),
}
BASICS = ["name", "email", "phone", "location", "headline"]
RESUME = (
    f"struct<basics:struct<{','.join(f'{n}:{CITED}' for n in BASICS)}>,"
    + ",".join(f"{kind}:array<struct<{','.join([f'{n}:{CITED}' for n in leaves] + [f'{n}:array<{CITED}>' for n in lists])}>>" for kind, (leaves, lists) in LEAVES.items())
    + ">"
)


def all_values(resume: Column) -> Column:
    """All cited values of a resume (of type RESUME), section by section, entry by entry; absent ones are left out."""
    none = F.array().cast(f"array<{CITED}>")

    def of(kind: str) -> Column:
        leaves, lists = LEAVES[kind]
        entry = lambda e: F.concat(F.array(*[e[n] for n in leaves]), *[F.coalesce(e[n], none) for n in lists])
        return F.coalesce(F.flatten(F.transform(resume[kind], entry)), none)

    return F.array_compact(F.concat(F.array(*[resume["basics"][n] for n in BASICS]), *map(of, LEAVES)))


def is_grounded(value: Column) -> Column:
    return F.coalesce(F.size(value["citations"]) > 0, F.lit(False))


def skill_names(resume: Column) -> Column:
    return F.coalesce(F.transform(resume["skills"], lambda s: s["name"]["value"]), F.array().cast("array<string>"))


def is_empty(resume: Column) -> Column:
    """Whether it has no work, education, projects or skills."""
    some = [F.coalesce(F.size(resume[k]), F.lit(0)) > 0 for k in ("work", "education", "projects", "skills")]
    return ~(some[0] | some[1] | some[2] | some[3])


def stats(values: Column) -> Column:
    """Of all_values(): fields, those that are grounded, their share (0 without fields), and citations."""
    n, grounded = F.size(values), F.size(F.filter(values, is_grounded))
    citations = F.aggregate(values, F.lit(0), lambda s, v: s + F.coalesce(F.size(v["citations"]), F.lit(0)))
    rate = F.when(n > 0, grounded / n).otherwise(0.0)
    return F.struct(n.alias("total"), grounded.alias("grounded"), F.round(rate, 6).alias("grounding_rate"), citations.alias("citations"))


def said_grounding(total: Column, grounded: Column, citations: Column, valid: Column) -> Column:
    share = lambda a, b, default: F.round(F.when(b > 0, a.cast("double") * 100 / b).otherwise(default * 100)).cast("long")  # noqa: E731  times 100 first: 23 / 40 * 100 is below 57.5
    return F.format_string("%d/%d fields grounded (%d%%), %d/%d citations valid (%d%%)", grounded, total, share(grounded, total, 0.0), valid, citations, share(valid, citations, 1.0))


def said_rubric(requirements: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, said): the role and how many requirements of each kind, those that it has."""
    kinds = ["must_have", "nice_to_have", "bonus"]
    counts = requirements.groupBy("job").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds])
    parts = [F.when(F.col(f"_{k}") > 0, F.concat(F.col(f"_{k}").cast("string"), F.lit(" " + k.replace("_", " ")))) for k in kinds]
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("role"))
    return jobs.join(counts, "job").select("job", F.concat(title, F.lit(": "), F.concat_ws(", ", *parts)).alias("said"))


def claim(quote: Column, text: Column) -> Column:
    """What a unit of evidence says: its quote, else its text."""
    return F.coalesce(F.nullif(quote, F.lit("")), text)


def as_citation(start: Column, end: Column, quote: Column, text: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), claim(quote, text).alias("quote"))


def asked(hint: Column, text: Column) -> Column:
    """What a requirement is searched by: its hint, else its text."""
    return F.coalesce(F.nullif(hint, F.lit("")), text)


def is_blocking(kind: Column) -> Column:
    return kind == "must_have"


def has_link(url: Column) -> Column:
    return F.coalesce(F.trim(url) != "", F.lit(False))


def bad_spans(spans: DataFrame) -> DataFrame:
    """Spans that begin before the text or end before they begin."""
    return spans.where((F.col("start") < 0) | (F.col("end") < F.col("start")))


def empty_rubrics(requirements: DataFrame, jobs: DataFrame) -> DataFrame:
    return jobs.join(requirements.select("job").distinct(), "job", "left_anti").select("job")


def needs_review(scored: DataFrame, *keys: str) -> DataFrame:
    """The requirements of each candidate whose verdict is ambiguous, in order."""
    return scored.where("ambiguous").groupBy(*keys).agg(F.sort_array(F.collect_list("requirement")).alias("needs_review"))


def originals(requests: DataFrame, retained: DataFrame) -> DataFrame:
    """requests (document_id) with the bytes as they were uploaded and found; not found where they weren't retained."""
    kept = retained.where("raw IS NOT NULL").select(F.col("document_id").alias("_d"), "raw")
    return requests.join(kept, F.col("document_id") == F.col("_d"), "left").select(*requests.columns, "raw", F.col("_d").isNotNull().alias("found"))


def section_texts(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, texts): a map from each kind of section that a document has to its text, several joined by line feeds."""
    from quillsift.operators.beside import passages

    rows = passages(sections.select("document_id", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), docs, "body")
    each = rows.groupBy("document_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "body"))), lambda x: x["body"]), "\n").alias("text"))
    return each.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "text")))).alias("texts"))


def following(rows: DataFrame, key: str, place: str, step: int = 10_000) -> DataFrame:
    """(key, place, next): the next place of the key's rows, null for the last; places are whole numbers, each once per key.

    By slices of `step` places, then from slice to slice, so a key with most rows isn't one task's.
    """
    from pyspark.sql import Window

    cut = rows.select(key, place).withColumn("_s", F.floor(F.col(place) / step))
    within = cut.withColumn("next", F.lead(place).over(Window.partitionBy(key, "_s").orderBy(place)))
    firsts = cut.groupBy(key, "_s").agg(F.min(place).alias("_first"))
    firsts = firsts.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.lead("_first").over(Window.partitionBy(key).orderBy("_s")).alias("_after"))
    met = within.join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")), "left")
    return met.select(key, place, F.coalesce("next", "_after").alias("next"))
