"""Rows beside the text of their document: a document's rows come together, and its text is joined once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Results of a document's function: name -> (Spark's type, Arrow's type).
#: Rows that are Python objects at once, but for a document that has more.
SLICE = 2_000
Added = dict[str, tuple[str, pa.DataType]]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch a few documents at a time, with SLICE rows in all in the lists of a column, or one document that has more."""
    before = np.cumsum(batch.column(column).value_lengths().to_numpy()) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        if at < end:
            yield batch.slice(at, end - at)


def beside(rows: DataFrame, docs: DataFrame, use: list[str], work: Callable[[str | None, list[dict]], list[tuple]], added: Added) -> DataFrame:
    """rows (document_id, ...) with the columns `added`: work(text, rows) gives a tuple for each of a document's rows.

    work sees the columns `use` alone, the others pass by as they are; a document that isn't in docs has the text None. What is
    held at once, besides a batch as it comes, is a document with its rows, or a few with SLICE rows in all.
    """
    own = [c for c in rows.columns if c != "document_id"]
    lists = rows.groupBy("document_id").agg(F.collect_list(F.struct(*own)).alias("_rows"))
    met = lists.join(docs.select("document_id", F.col("text").alias("_text")), "document_id", "left").select("document_id", "_text", "_rows")
    schema = StructType([rows.schema[c] for c in ("document_id", *own)])
    for name, (kind, _) in added.items():
        schema = schema.add(name, DataType.fromDDL(kind))

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        seen = list(zip(*(flat.field(own.index(c)).to_pylist() for c in use), strict=True))
        found: list[tuple] = []
        at = 0
        for text, size in zip(batch.column(1), sizes.tolist(), strict=True):
            found += work(text.as_py(), [dict(zip(use, r, strict=True)) for r in seen[at : at + size]])
            at += size
        columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *(flat.field(k) for k in range(len(own)))]
        columns += [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(added.values())]
        return pa.RecordBatch.from_arrays(columns, [*("document_id", *own), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(piece, slices(batch, 2))

    return met.mapInArrow(run, schema)


def passages(rows: DataFrame, docs: DataFrame, name: str = "there") -> DataFrame:
    """rows (document_id, start, end, ...) with the text of their spans; null if a span isn't within the text."""

    def work(text: str | None, spans: list[dict]) -> list[tuple]:
        size = -1 if text is None else len(text)
        fits = lambda s: s["start"] is not None and s["end"] is not None and 0 <= s["start"] and s["end"] <= size
        return [(text[s["start"] : max(s["start"], s["end"])] if fits(s) else None,) for s in spans]

    return beside(rows, docs, ["start", "end"], work, {name: ("string", pa.string())})
