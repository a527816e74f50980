"""Personal data: detection, overlap resolution, masking that keeps every length."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import let, matches, stripped

# Patterns, city and gender words, and words that no name has. (?U): letters and digits of any script.
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"(?U)(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,5}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?"
URL = r"(?U)\b(?:https?://|www\.)\S+|\b[\w-]+\.(?:com|org|net|io|dev|me|ai)/\S*"
INSTITUTION = (
    r"(?U)\b(?:University\s+of\s+[A-Z][\w.-]*(?:\s+[A-Z][\w.-]*)?"
    r"|[A-Z][\w.-]*(?:\s+[A-Z][\w.-]*)?\s+(?:University|College|Institute|Polytechnic|Academy)"
    r"|(?:IIT|NIT|IIIT|BITS|MIT|ETH|EPFL|KTH)\s+[A-Z][\w.-]*|\b(?:IIT|NIT|IIIT|BITS)\b)"
)
GENDER_WORDS = (
    "he", "him", "his", "she", "her", "hers", "mr", "mrs", "ms", "miss", "sir", "madam", "male", "female", "fraternity", "sorority", "husband",
    "wife", "maternity", "paternity",
)
CITIES = (
    "bengaluru", "bangalore", "mumbai", "delhi", "hyderabad", "chennai", "pune", "kolkata", "ahmedabad", "jaipur", "lucknow", "noida", "gurgaon",
    "gurugram", "london", "manchester", "berlin", "munich", "paris", "amsterdam", "dublin", "toronto", "vancouver", "sydney", "melbourne",
    "singapore", "dubai", "york", "francisco", "seattle", "austin", "boston", "chicago", "denver",
)
NOT_NAMES = (
    "curriculum", "vitae", "resume", "cv", "profile", "summary", "objective", "experience", "education", "skills", "projects", "contact", "about",
)
#: Each institution that INSTITUTION finds holds one of these.
INSTITUTIONS = ("University", "College", "Institute", "Polytechnic", "Academy", "IIT", "NIT", "BITS", "MIT", "ETH", "EPFL", "KTH")
GENDER = r"(?iU)\b(?:%s)\b" % "|".join(GENDER_WORDS)
CITY = r"(?iU)\b(?:%s)\b" % "|".join(CITIES)
YEARS = "\\s*(19|20)\\d{2}\\s*[-–—]\\s*(19|20)\\d{2}\\s*"
#: Categories in the order in which equal spans win; all but url are masked by default.
CATEGORIES = ["email", "url", "institution", "location", "gender_term", "phone", "name"]
MASKED = [c for c in CATEGORIES if c != "url"]
SPAN = "array<struct<start:int,end:int,category:string,text:string>>"


#: A run of so many characters in which no address starts where its first word does has none further on: it's stepped over as a
#: match of its own, so that it isn't tried again from each of its words.
LONG_RUNS = {"email": r"|\b[\w.+-]{200,}+", "url": r"|\b[\w-]{200,}+(?<!www)(?<!http)(?<!https)"}


def emails(t: Column) -> Column:
    """Matches of EMAIL."""
    return F.filter(matches(t, EMAIL + LONG_RUNS["email"]), lambda m: F.contains(m["text"], F.lit("@")))


def urls(t: Column) -> Column:
    """Matches of URL; each holds a dot or a colon."""
    return F.filter(matches(t, URL + LONG_RUNS["url"]), lambda m: F.contains(m["text"], F.lit(".")) | F.contains(m["text"], F.lit(":")))


def _spans(found: Column, category: str, ok=None) -> Column:
    """Matches as spans of a category; no pattern's match begins or ends with a blank."""
    return F.transform(F.filter(found, lambda m: ok(m["text"])) if ok else found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(category).alias("category"), m["text"].alias("text")))


def phone_like(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, r"(?U)\D", ""))
    return digits.between(7, 15) & ~text.rlike(f"^(?:{YEARS})$")


def name_span(t: Column) -> Column:
    """At most one span: the first line of the first 400 characters that looks like a name."""
    header = F.split(F.substring(t, 1, 400), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        s = stripped(line)
        parts = F.split(s, r"\s+")
        shaped = F.forall(parts, lambda w: w.rlike(r"^[A-Za-z][A-Za-z'.\-]*$") & ~F.lower(w).isin(*NOT_NAMES))
        cased = (F.upper(s) == s) | F.forall(parts, lambda w: w.rlike("^[A-Z]"))
        good = (F.size(acc["out"]) == 0) & (s != "") & F.size(parts).between(2, 4) & (F.length(s) <= 45) & shaped & cased
        begin = acc["at"] + F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        span = F.array(F.struct(begin.alias("start"), (begin + F.length(s)).alias("end"), F.lit("name").alias("category"), s.alias("text"))).cast(SPAN)
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(good, span).otherwise(acc["out"]).alias("out"))

    return F.aggregate(header, start, step, lambda acc: acc["out"])


def _among(t: Column, words: tuple[str, ...]) -> Column:
    """Whether a text may hold one of the words, whatever the case of its letters (also ones with special case forms)."""
    return reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words])


def detected(t: Column) -> Column:
    """All spans of all categories; they may overlap. A pattern is tried only on texts that hold what each match of it needs."""
    none = F.array().cast(SPAN)
    found = lambda needs, *args: F.when(needs, _spans(*args)).otherwise(none)

    def spans(t: Column, folded: Column) -> Column:
        return F.concat(
            found(F.contains(t, F.lit("@")), emails(t), "email"), found(_among(t, ("http", "www.", "/")), urls(t), "url"),
            found(_among(t, INSTITUTIONS), matches(t, INSTITUTION), "institution"), found(_among(folded, CITIES), matches(t, CITY), "location"),
            found(_among(folded, GENDER_WORDS), matches(t, GENDER), "gender_term"), found(t.rlike(r"(?U)\d{3}"), matches(t, PHONE), "phone", phone_like), name_span(t),
        )

    return let(F.struct(t.alias("t"), F.lower(F.upper(t)).alias("folded")), lambda x: spans(x["t"], x["folded"]))


def _greedy(spans: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the spans (start, end, number) of an island that are kept, in order."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        at = bisect_left(kept, s)
        if not any(k[0] < s[1] and s[0] < k[1] for k in kept[max(0, at - 1) : at + 1]):
            kept.insert(at, s)
    return [k[2] for k in kept]


def _resolved(spans: pa.Array) -> pa.Array:
    sizes, flat = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), spans.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    wide = int(end.max(initial=0)) + 1  # apart by so much, the rows of a batch stand in one line
    order = np.lexsort((end, start, row))
    begins, upto = (start + row * wide)[order], np.maximum.accumulate((end + row * wide)[order])
    heads = np.flatnonzero(np.append(True, begins[1:] >= upto[:-1])) if len(order) else order
    counts = np.diff(np.append(heads, len(order)))
    alone = np.zeros(len(order), bool)
    alone[heads[counts == 1]] = True
    keep = np.where(alone, order, -1)
    for at, n in zip(heads[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
        own = order[at : at + n]
        best = _greedy(list(zip(start[own].tolist(), end[own].tolist(), own.tolist(), strict=True)))
        keep[at : at + len(best)] = best
    keep = keep[keep >= 0]
    offsets = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(sizes)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(keep)), mask=spans.is_null())


def resolved(rows: DataFrame, column: str) -> DataFrame:
    """rows whose column of spans is resolved: longest first, then earliest, then in the order found; what overlaps a kept span
    goes. Ordered by start.

    A batch's spans are sorted at once; only those that overlap, directly or by way of others, are compared.
    """
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, column, _resolved(batch.column(at)))

    return rows.mapInArrow(run, rows.schema)


def masked(t: Column, spans: Column, categories: list[str] = MASKED) -> Column:
    """The text with a mask of the same length over each span: [CATEGORY]### or only #. The spans are in order and apart, as resolved() has them."""

    def mask(s: Column) -> Column:
        width = s["end"] - s["start"]
        label = F.concat(F.lit("["), F.upper(s["category"]), F.lit("]"))
        return F.when(F.length(label) <= width, F.rpad(label, width, F.lit("#"))).otherwise(F.repeat(F.lit("#"), width))

    def built(chosen: Column) -> Column:
        pieces = F.transform(chosen, lambda s, i: let(F.when(i == 0, 0).otherwise(F.get(chosen, i - 1)["end"]), lambda at: F.concat(F.substring(t, at + 1, s["start"] - at), mask(s))))
        rest = let(F.get(chosen, F.size(chosen) - 1)["end"], lambda at: F.substring(t, at + 1, F.length(t)))
        return F.concat(F.array_join(pieces, ""), rest)

    return let(F.filter(spans, lambda s: s["category"].isin(categories)), lambda chosen: F.when(F.size(chosen) == 0, t).otherwise(built(chosen)))


def _masked(texts: pa.Array, spans: pa.ListArray, categories: list[str]) -> pa.Array:
    """masked() of a batch whose spans are resolved."""
    flat, label = spans.flatten(), {c: f"[{c.upper()}]" for c in categories}
    found = [*zip(*(flat.field(k).to_pylist() for k in range(3)), strict=True)]
    out, at = [], 0
    for text, size in zip(texts.to_pylist(), spans.value_lengths().to_pylist(), strict=True):
        pieces, upto = [], 0
        for start, end, category in found[at : at + size]:
            if category in label:
                own, width = label[category], end - start
                pieces += (text[upto:start], own.ljust(width, "#") if len(own) <= width else "#" * width)
                upto = end
        out.append("".join([*pieces, text[upto:]]) if pieces else text)
        at += size
    return pa.array(out, pa.string())


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: list[str] = MASKED) -> DataFrame:
    """(document_id, spans, redacted_text). A batch's spans are resolved and its texts are masked at once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("document_id"), detected(t).alias("spans"), t.alias("redacted_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _resolved(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, _masked(batch.column(2), spans, categories)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def counts(redacted: DataFrame) -> DataFrame:
    """(document_id, category, n)."""
    return redacted.select("document_id", F.explode("spans.category").alias("category")).groupBy("document_id", "category").agg(F.count("*").alias("n"))


def report(redacted: DataFrame) -> DataFrame:
    """(document_id, category, n, n_chars, text_sha256): spans by category, with the length and the digest of the masked text. A document
    without spans has one row, without a category."""
    each = F.transform(F.array(*map(F.lit, CATEGORIES)), lambda c: F.struct(c.alias("category"), F.size(F.filter("spans", lambda s: s["category"] == c)).cast("long").alias("n")))
    text = F.col("redacted_text")
    rows = redacted.select("document_id", F.filter(each, lambda x: x["n"] > 0).alias("each"), F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    return rows.select("document_id", F.inline_outer("each"), "n_chars", "text_sha256").select("document_id", "category", F.coalesce("n", F.lit(0)).alias("n"), "n_chars", "text_sha256")
