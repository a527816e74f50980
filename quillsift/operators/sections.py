"""Headings to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import let

# Heading keywords by section.
KEYWORDS = {
    "work": ["work experience", "professional experience", "employment history", "work history", "experience", "employment", "internships", "internship"],
    "education": ["education", "academic background", "qualifications", "academics"],
    "projects": ["projects", "personal projects", "side projects", "selected projects", "open source", "portfolio"],
    "skills": ["skills", "technical skills", "technologies", "tech stack", "competencies", "languages and tools"],
    "awards": ["awards", "achievements", "honors", "honours", "certifications", "certificates", "publications"],
}
#: Longest first; of equal length in the order above.
ORDERED = sorted(((k, s) for s, ks in KEYWORDS.items() for k in ks), key=lambda p: -len(p[0]))


def classify(heading: Column) -> Column:
    """Section of a heading that equals, starts or ends with a keyword, the longest counts; null for others and for more than 40 characters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", " "), "^ | $", "")
    known = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in ORDERED]), F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(s).alias("section")) for n, (_, s) in enumerate(ORDERED)]))
    ends = [k for n in range(1, 1 + max(len(k.split()) for k, _ in ORDERED)) for k in (n, -n)]

    def section(t: Column) -> Column:
        found = F.array_min(F.array(*[F.try_element_at(known, F.substring_index(t, " ", k)) for k in ends]))
        return F.when((t != "") & (F.length(t) <= 40), found["section"])

    return let(plain, section)


#: First and last words of the keywords: other lines than those that begin or end with one are no headings. The last ones are
#: sought from the end of the line, backwards, so that both patterns are tried at one place only.
_ENDS = [sorted({k.split()[n] for k, _ in ORDERED}) for n in (0, -1)]
BEGINS, ENDS = rf"^[^a-z0-9]*(?:{'|'.join(_ENDS[0])})", rf"^[^a-z0-9]*(?:{'|'.join(w[::-1] for w in _ENDS[1])})"
BLANKS = " \t\n\x0b\f\r"


def maybe(line: Column) -> Column:
    """Whether a line is short and begins or ends as a heading does; boundaries() look at such lines alone."""
    return likely(F.btrim(line, F.lit(BLANKS)))


def likely(s: Column) -> Column:
    """maybe() of a line without blanks at its ends."""
    return (s != "") & (F.length(s) <= 40) & (F.lower(s).rlike(BEGINS) | F.reverse(F.lower(s)).rlike(ENDS))


def boundaries(lines: DataFrame) -> DataFrame:
    """Heading lines with their section, from lines(document_id, start, end, line); short lines only."""
    s = F.btrim("line", F.lit(BLANKS))
    lead = F.length("line") - F.length(F.ltrim("line", F.lit(BLANKS)))
    rows = lines.where(maybe(F.col("line"))).withColumn("kind", classify(s)).where("kind IS NOT NULL")
    return rows.select("document_id", (F.col("start") + lead).alias("start"), (F.col("start") + lead + F.length(s)).alias("end"), "kind", s.alias("heading"))


def segment(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(document_id, kind, start, end, heading): a section runs to the next heading; what is before the first is basics;
    a document without headings is one section, other."""
    order = Window.partitionBy("document_id").orderBy("start")
    long = lambda c: c.cast("bigint")
    rows = lengths.join(found.select("document_id", "kind", "start", "heading"), "document_id", "left")
    rows = rows.withColumns({"end": F.coalesce(F.lead("start").over(order), long(F.col("length"))), "_k": F.row_number().over(order)})
    section = lambda kind, start, end, heading: F.struct(kind.alias("kind"), long(start).alias("start"), long(end).alias("end"), heading.alias("heading"))
    none, zero = F.lit(""), F.lit(0)
    own = section(F.col("kind"), F.col("start"), F.col("end"), F.col("heading"))
    basics = F.when(F.col("_k") == 1, section(F.lit("basics"), zero, F.col("start"), none))
    each = F.when(F.col("kind").isNull(), F.array(section(F.lit("other"), zero, F.col("length"), none))).otherwise(F.array(basics, own))
    return rows.select("document_id", F.explode(each).alias("s")).select("document_id", "s.*").where("end > start")


def hull(sections: DataFrame) -> DataFrame:
    """From the first start to the last end of each kind."""
    return sections.groupBy("document_id", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
