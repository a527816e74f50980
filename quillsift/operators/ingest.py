"""Documents to line blocks with offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import running

#: Suffix -> format. Fixed values.
FORMATS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".txt": "text", ".md": "text", ".markdown": "text"}
#: Lines from which some_lines() works out all places at once.
MANY = 2_000
#: Line ends as str.splitlines() has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def format_of(path: Column) -> Column:
    """pdf, docx or text; null for other suffixes."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in FORMATS.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def probably_scanned(chars: Column, pages: Column) -> Column:
    """Fewer than 100 characters a page."""
    return chars / F.greatest(pages, F.lit(1)) < 100


def is_heading(line: Column) -> Column:
    """All capitals and shorter than 40 characters."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) < 40)


def is_latin_heading(line: Column) -> Column:
    """Shorter than 40 characters, with a capital and no small letter of Latin-1 (A-Z, À-Þ; a-z, à-ÿ); other scripts' letters don't count."""
    s = F.regexp_replace(line, r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")
    return s.rlike("[A-ZÀ-Þ]") & ~s.rlike("[a-zà-ÿ]") & (F.length(s) < 40)


def _numbered(docs: DataFrame, id_col: str, text_col: str, pattern: str, form=lambda line: line) -> DataFrame:
    """(document_id, line_no, start, end, line), with the offsets from the line lengths of the row itself: no shuffle."""
    split = docs.select(F.col(id_col).alias("document_id"), F.transform(F.split(F.coalesce(text_col, F.lit("")), pattern, -1), form).alias("_lines"))
    ends = running(F.transform("_lines", lambda line: F.length(line) + 1))
    rows = split.select("document_id", F.posexplode(F.arrays_zip(F.col("_lines").alias("line"), ends.alias("upto"))).alias("line_no", "x"))
    end = F.col("x.upto") - 1
    return rows.select("document_id", "line_no", (end - F.length("x.line")).alias("start"), end.alias("end"), F.col("x.line").alias("line"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "\n") -> DataFrame:
    """(document_id, line_no, start, end, line): every line with its place in the text as it is."""
    return _numbered(docs, id_col, text_col, pattern)


def some_lines(docs: DataFrame, keep: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lines() for which keep(line) holds: places are worked out for these alone, but for all where a text has more than MANY lines."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("document_id"), t.alias("_t"), F.split(t, "\n", -1).alias("_l"))
    rows = rows.withColumn("_ends", F.when(F.size("_l") > MANY, running(F.transform("_l", lambda line: F.length(line) + 1))))
    rows = rows.select("document_id", "_t", "_ends", F.posexplode("_l").alias("line_no", "line")).where(keep(F.col("line")))
    before = F.length(F.call_function("substring_index", F.col("_t"), F.lit("\n"), F.col("line_no"))) + F.least(F.col("line_no"), F.lit(1))
    start = F.coalesce(F.get("_ends", F.col("line_no")) - 1 - F.length("line"), before.cast("long"))
    return rows.select("document_id", "line_no", start.alias("start"), (start + F.length("line")).alias("end"), "line")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LINE_END) -> DataFrame:
    """(document_id, line_no, start, end, line, is_heading) in the accumulated text: right-trimmed lines, each with a
    line end; blank lines take one place and make no block."""
    rows = _numbered(docs, id_col, text_col, pattern, lambda line: F.regexp_replace(line, r"\s+$", ""))
    return rows.where("line <> ''").withColumn("is_heading", is_heading(F.col("line")))


def reading_order(pdf_lines: DataFrame) -> DataFrame:
    """Lines of pages, with (document_id, page, x0, y0, width), in reading order: two columns if each holds a quarter of the lines.

    Adds `column` and `place`.
    """
    page = Window.partitionBy("document_id", "page")
    right = (F.col("x0") >= F.col("width") / 2).cast("int")
    share = F.least(F.sum(right).over(page), F.sum(1 - right).over(page)) / F.count("*").over(page)
    rows = pdf_lines.withColumn("column", F.when(share >= 0.25, right).otherwise(0))
    order = page.orderBy("column", F.round("y0", 1), "x0")
    return rows.withColumn("place", F.row_number().over(order))


def font_headings(pdf_lines: DataFrame) -> DataFrame:
    """Adds is_heading: at least 1.15 times the page's median positive font size."""
    page = Window.partitionBy("document_id", "page")
    middle = F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(page)
    return pdf_lines.withColumn("is_heading", F.coalesce(F.col("font_size") >= middle * 1.15, F.lit(False)))


def upload_report(files: DataFrame, store: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """Accept or reject each of (path, content): id, reason (null if accepted) and created (not in store's ids before)."""
    size = F.length("content")
    reason = F.when(format_of(F.col("path")).isNull(), "unsupported").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > max_bytes, "too large")
    rows = files.select("path", content_id(F.col("content")).alias("document_id"), reason.alias("reason"))
    known = store.select(F.col("document_id").alias("known")).distinct()
    rows = rows.join(known, F.col("document_id") == F.col("known"), "left")
    return rows.select("path", "document_id", "reason", (F.col("reason").isNull() & F.col("known").isNull()).alias("created"))
