"""Vectors as codes: product quantisation in whole numbers, nearest entries found by segment-mean lower bounds.

1. Rows without a vector, or with null, non-finite or too large components, are dropped. A component x is the integer
   floor(SCALE * x); vectors are cut into PARTS equal parts. Each part position has a codebook of ENTRIES entries at most,
   at first those parts of the smallest ids.
2. A round gives each part its nearest entry (squared Euclidean distance, ties to the lower index), then each used entry
   becomes its parts' componentwise floor of the mean. Map tasks add up counts and sums per entry, Spark adds those; what
   comes to the driver is one number per entry and component, whatever the input.
3. Nearest entries, coarse to fine: with L components in a segment, s their sums and r the norms of what is left without
   the mean, (s1 - s2)**2 / L + (r1 - r2)**2 is at most the squared distance over the segment. One segment first, then
   SEGMENTS of them, rule entries out against the distance to the most promising one; what survives is measured exactly, in
   integers. Bounds are lowered by more than their rounding can be, so the result is that of measuring every entry.

Definitions: a component beyond +-LARGEST after scaling counts as non-finite, as its square doesn't fit the distance's 64
bits. The smallest id's vector sets the dimension, which must be a multiple of PARTS; vectors of other lengths are dropped. Null ids
come last; equal ids are ordered by their vectors. Repeated rows count and are coded each. With fewer vectors than ENTRIES the
codebooks are shorter. A vector is one short row; there are no texts. Only the named columns are read and results have names of their own,
so further columns may have any names. Where nothing is kept, the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import release, sized, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SEGMENTS = 4
LARGEST = 1 << 27
#: Vectors that are compared with a codebook at once.
BLOCK = 2000


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over sqrt(L), and norms of what is left without the mean, of `count` equal segments of each row of integers."""
    y = x.reshape(len(x), count, -1)
    length, sums = y.shape[2], y.sum(2)
    left = length * (y * y).sum(2) - sums * sums  # exact: the components are bounded
    return sums / np.sqrt(length), np.sqrt(left / length)


def bound(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """At most the squared distance, of rows that are aligned or broadcast."""
    found = ((one[0] - two[0]) ** 2 + (one[1] - two[1]) ** 2).sum(-1)
    return found * (1 - 1e-6) - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the lowest index of the nearest row of book, its squared distance, and how many were measured."""
    fill = -x.shape[1] % SEGMENTS  # zeros in both change no distance
    x, book = (np.pad(y, ((0, 0), (0, fill))) for y in (x, book))
    coarse, fine = ([segments(y, k) for y in (x, book)] for k in (1, SEGMENTS))
    low = bound((coarse[0][0][:, None], coarse[0][1][:, None]), (coarse[1][0][None], coarse[1][1][None]))
    most = ((x - book[low.argmin(1)]) ** 2).sum(1)
    i, j = np.nonzero(low <= most[:, None])
    near = bound((fine[0][0][i], fine[0][1][i]), (fine[1][0][j], fine[1][1][j])) <= most[i]
    i, j = i[near], j[near]
    far = ((x[i] - book[j]) ** 2).sum(1)
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])  # each row has the entry that set `most`
    least = np.minimum.reduceat(far, starts)
    hit = np.flatnonzero(far == least[i])
    _, first = np.unique(i[hit], return_index=True)
    return j[hit[first]], least, len(i)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows, PARTS) of vectors (rows, PARTS, width); books: (PARTS, entries, width)."""
    codes, far = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for at in range(0, len(x), BLOCK):
        for p in range(x.shape[1]):
            codes[at : at + BLOCK, p], far[at : at + BLOCK, p], _ = nearest(x[at : at + BLOCK, p], books[p])
    return codes, far


def _vectors(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, books.shape[0], books.shape[2])


def _sums(books: np.ndarray) -> Callable:
    """A task's counts and sums of the parts of each entry: (slot, count, total), a slot being part, entry, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, books)
                codes, _ = assigned(x, books)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], x[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.repeat(count.ravel(), width)
        slot = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(used[slot]), pa.array(total.ravel()[slot])], ["slot", "count", "total"])

    return run


def _codes(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, far = assigned(_vectors(batch, books), books)
                said = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(far.sum(1))], ["id", "label", "code", "error"])

    return run


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, x): the rows whose vectors are usable, as integers."""
    scaled = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * SCALE))
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.abs(v.cast("double")) * SCALE < LARGEST)
    rows = vectors.where(F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), usable))
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(scaled, lambda v: v.cast("int")).alias("x"))


def trained(rows: DataFrame, first: list, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) after the rounds; first: the vectors that they start from."""
    books = np.array(first, np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(books), "slot long, count long, total long").groupBy("slot").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
        for slot, count, total in sums.collect():  # at most one number per entry and component
            books.reshape(-1)[slot] = total // count
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, code, error) of each usable row, stored, and the codebooks; those are None if nothing is usable."""
    rows = stored(kept(vectors, id_col, vector_col, label_col), "vectors")
    first = [r[0] for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).select("x").collect()]
    width = len(first[0]) if first else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not width:
        return rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    fit = rows.where(F.size("x") == width)
    books = trained(fit, [r[0] for r in fit.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()], rounds)
    out = stored(fit.mapInArrow(_codes(books), kinds), "codes")
    release(rows)
    return out, books


def said(books: np.ndarray | None) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encode(table(spark, sf_dir, "embeddings"))
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    met = codes.join(sized(sums), codes["label"].eqNullSafe(sums["of"]))
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(said(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The query in SQL: components as rows, one CTE per assignment and per update."""
    near = "SELECT vec_id, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (SELECT x.vec_id, x.p, b.e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS far FROM x JOIN b{k} b ON x.p = b.p AND x.q = b.q GROUP BY ALL) GROUP BY ALL"
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda z: floor(1024 * z::DOUBLE)::BIGINT) AS c, len(embedding) // 4 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS q, c[i + 1] AS v FROM k, unnest(range(len(c))) t(i))",
        "b0 AS MATERIALIZED (SELECT x.p, f.e, x.q, x.v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256) f USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        if k < ROUNDS:
            mean = f"SELECT a.p, a.e, x.q, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM a{k} a JOIN x ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY ALL"
            parts.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.q, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN ({mean}) m ON b.p = m.p AND b.e = m.e AND b.q = m.q)")
    parts.append(f"r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    parts.append(f"h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, q)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h"


ORACLE = _oracle()
