"""Files to documents: text, Markdown and DOCX by the standard library, PDF where a PDF library is installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators.ingest import content_id, format_of, probably_scanned

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, document_id string, format string, text string, pages int, error string"


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then table rows with their cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    lines = [said(p) for p in body.findall(f"{W}p")]
    lines += [" | ".join(said(c) for c in row.findall(f"{W}tc")) for row in body.iter(f"{W}tr")]
    return "\n".join(line.rstrip() for line in lines if line.strip())


def pdf_text(content: bytes) -> tuple[str, int]:
    """Text and number of pages; needs pypdf."""
    from pypdf import PdfReader

    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    return "\n".join(pages), len(pages)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, doc, kind, content in zip(batch["path"], batch["document_id"], batch["format"], batch["content"], strict=True):
            text, pages, error = None, 1, None
            try:
                if kind == "docx":
                    text = docx_text(content)
                elif kind == "pdf":
                    text, pages = pdf_text(content)
                else:
                    text = content.decode("utf-8", errors="replace")
            except ImportError as e:
                error = f"no reader for {kind}: {e.name}"
            except Exception as e:  # noqa: BLE001  a file that can't be read is a row with its reason, not a failed job
                error = f"{type(e).__name__}: {e}"
            rows.append((path, doc, kind, text, pages, error))
        yield pd.DataFrame(rows, columns=["path", "document_id", "format", "text", "pages", "error"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below path: text, or the reason why there is none; scanned marks texts too short for their pages.

    Unsupported files are rows with a reason. Spark's file scan leaves files of no bytes out; upload_report() takes the
    contents themselves and reports those.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", content_id(F.col("content")).alias("document_id"), format_of(F.col("path")).alias("format"), "content")
    bad = rows.where(F.col("format").isNull()).select("path", "document_id", "format", F.lit(None).cast("string").alias("text"), F.lit(0).alias("pages"), F.lit("unsupported").alias("error"))
    good = rows.where(F.col("format").isNotNull()).select("path", "document_id", "format", "content").mapInPandas(_parse, SCHEMA)
    both = good.unionByName(bad)
    return both.withColumn("scanned", F.coalesce((F.col("format") == "pdf") & probably_scanned(F.length("text"), F.col("pages")), F.lit(False)))
