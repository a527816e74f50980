"""Removal of byte strings of LENGTH that also start in a document with a smaller id: suffix arrays of shards.

1. Shards. A window is a place where LENGTH bytes start. It goes where the least hash of the GRAM-byte strings within it says
   (its key), so equal windows have equal keys; windows that follow one another with one key make a segment. A
   document's keys are kept if another document has them; only those documents' texts are cut into segments.
2. Equal segments are one row with the smallest id. A key's segments lie in one shard; keys with one segment are done.
   A shard's suffix array is made by induced sorting (suffixes.py), and its permuted common prefixes; suffixes next to each other
   with LENGTH bytes in common are equal windows, and the smallest id of such a class decides. Keys with more than
   `crowd` segments (a phrase that stands in many surroundings) are dealt out by the window's digest instead,
   where equal windows are one row after the aggregation in the map tasks.
3. A segment's windows are covered in a document if the same segment has a smaller id (copies of a segment), else
   where the shard found a smaller one. Copies of whole documents are found first, by digest, and covered throughout.
4. Each text meets its covered bytes in a join and is cut.

Definitions: texts are UTF-8 bytes; null text is empty, texts under LENGTH bytes lose nothing. Ids are whole numbers; a null id counts as
larger than all others; rows with one id never cover each other. Covers are judged on the input, not on what is left.
What is left of a text may cut a character, so it is bytes. A very long text is read in steps of STEP bytes; its
covers are one row. Repeated rows get a row each. Only the id and text columns are read, results have names of their own, so
further columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import release, sized, sliced, small_batches, stored, table
from quillsift.llm.suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 50, 24
STEP = 1 << 18
#: Bytes of segments that are sorted together.
SHARD = 1 << 20
CROWD = 5000
LAST = (1 << 63) - 1  # stands for a null id
ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def keys(body: np.ndarray) -> np.ndarray:
    """The key of each window of some bytes."""
    h, n = body.astype(np.uint64), 1
    while n < GRAM:  # twice as many bytes each time, overlapping in the last step
        more = min(n, GRAM - n)
        h = h[:-more] * ODD[n.bit_length() - 1] + h[more:]
        n += more
    h ^= h >> np.uint64(32)
    h *= ODD[0]
    h ^= h >> np.uint64(29)
    wide, n = LENGTH - GRAM + 1, 1
    while 2 * n <= wide:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return (np.minimum(h[: len(h) - wide + n], h[wide - n :]) if n < wide else h).view(np.int64)


def pieces(bodies: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first window, windows, key) of the segments of some texts, about STEP bytes at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = keys(np.frombuffer(b"".join(x[2] for x in held), np.uint8))
        lengths = np.array([len(x[2]) for x in held])
        begin = np.cumsum(lengths) - lengths
        change = np.flatnonzero(own[1:] != own[:-1]) + 1
        start = np.union1d(change, np.concatenate([begin, (begin + lengths - LENGTH + 1)[:-1]]))
        end = np.append(start[1:], len(own))
        owner = np.searchsorted(begin, start, "right") - 1
        fits = start <= begin[owner] + lengths[owner] - LENGTH  # no window that reaches into the next text
        start, end, owner = start[fits], end[fits], owner[fits]
        number, offset = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        return number[owner], offset[owner] + start - begin[owner], end - start, own[start]

    for k, body in enumerate(bodies):
        for at in range(0, len(body) - LENGTH + 1, STEP):
            held.append((k, at, body[at : at + STEP + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= STEP:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, body) -> the different (key, doc)."""
    for batch in sliced(batches):
        docs, bodies = batch.column(0).to_numpy(), [x.as_py() for x in batch.column(1)]
        for number, _, _, key in pieces(bodies):
            order = np.lexsort((key, number))
            n, k = number[order], key[order]
            first = np.concatenate(([True], (n[1:] != n[:-1]) | (k[1:] != k[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(docs[n[first]])], ["key", "doc"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, body, keys) -> the segments with one of these keys: (key, mold, doc, mark, at, segment)."""
    for batch in sliced(batches, 200):
        docs, marks, bodies = batch.column(0).to_numpy(), batch.column(1), [x.as_py() for x in batch.column(2)]
        shared = np.unique(batch.column(3).flatten().to_numpy())  # a key that is shared is listed wherever it occurs
        for number, at, count, key in pieces(bodies):
            place = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            hit = np.flatnonzero(shared[place] == key)
            number, at, count, key = number[hit], at[hit], count[hit], key[hit]
            found = [bodies[n][a : a + c + LENGTH - 1] for n, a, c in zip(number.tolist(), at.tolist(), count.tolist(), strict=True)]
            molds = pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), molds, pa.array(docs[number]), marks.take(pa.array(number)), pa.array(at.astype(np.int32)), pa.array(found, pa.binary())], ["key", "mold", "doc", "mark", "at", "segment"])


def covered(segments: list[bytes], docs: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment number, start, end) of the bytes covered by windows that also start in a segment with a smaller id."""
    text = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    text[ends] = 1
    text[-1] = 0
    order = suffix_array(text, 258)
    shared = common_prefixes(text, order, 1)[order] >= LENGTH
    label = np.cumsum(~shared) - 1  # of the classes of equal windows
    both = shared | np.append(shared[1:], False)
    where, label = order[both], label[both]
    if not len(where):
        return []
    owner = np.searchsorted(ends, where)
    starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    least = np.repeat(np.minimum.reduceat(docs[owner], starts), np.diff(np.append(starts, len(label))))
    late = np.sort(where[docs[owner] > least])
    return _spans(np.searchsorted(ends, late), late - np.concatenate(([0], ends + 1))[np.searchsorted(ends, late)])


def _spans(owner: np.ndarray, window: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, start, end) of the bytes of sorted windows; windows that follow one another are one span."""
    if not len(owner):
        return []
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1))))
    last = np.append(first[1:], len(owner)) - 1
    return [*zip(owner[first].tolist(), window[first].tolist(), (window[last] + LENGTH).tolist(), strict=True)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, mold, doc, segment) sorted by key -> (mold, start, end), shard by shard."""
    group: list[tuple] = []
    shard: list[tuple] = []
    size, now = 0, None

    def done() -> pa.RecordBatch:
        found = covered([r[2] for r in shard], np.array([r[1] for r in shard]))
        return pa.RecordBatch.from_arrays([pa.array([shard[k][0] for k, _, _ in found], pa.binary()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], ["mold", "start", "end"])

    for batch in batches:
        for key, mold, doc, segment in zip(*(batch.column(c).to_pylist() for c in ("key", "mold", "doc", "segment")), strict=True):
            if key != now:
                if len(group) > 1:
                    shard += group
                    size += sum(len(r[2]) for r in group)
                if size >= SHARD:
                    yield done()
                    shard, size = [], 0
                group, now = [], key
            group.append((mold, doc, segment))
    if len(group) > 1:
        shard += group
    if shard:
        yield done()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments -> (digest, mold, doc, window) of each of their windows."""
    for batch in sliced(batches):
        rows = [(xxhash.xxh3_128_digest(s[w : w + LENGTH]), m, d, w) for m, d, s in zip(*(batch.column(c).to_pylist() for c in ("mold", "doc", "segment")), strict=True) for w in range(len(s) - LENGTH + 1)]
        digest, mold, doc, window = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(mold, pa.binary()), pa.array(doc, pa.int64()), pa.array(window, pa.int32())], ["digest", "mold", "doc", "window"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body, spans) -> (id, n_bytes, n_removed, spans, kept)."""
    for batch in sliced(batches, 200):
        rows = []
        for body, spans in zip(batch.column(1), batch.column(2), strict=True):
            body, kept, at, runs = body.as_py(), [], 0, []
            for start, end in sorted((s["start"], s["end"]) for s in spans.as_py() or []):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(end, runs[-1][1])
                else:
                    runs.append([start, end])
            for start, end in runs:
                kept.append(body[at:start])
                at = end
            kept.append(body[at:])
            rows.append((len(body), sum(b - a for a, b in runs), [{"start": a, "end": b} for a, b in runs], b"".join(kept)))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "spans", "kept"])


def repeats(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc, mark, start, end): bytes covered in the texts (doc, mark, body); mark tells texts with one id apart. It is stored."""
    hashed = stored(texts.select("doc", "mark", F.sha2("body", 256).alias("whole"), F.length("body").alias("n")), "hashed")
    firsts = hashed.groupBy("whole").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    copies = stored(hashed.join(firsts, "whole").where(f"doc > first AND n >= {LENGTH}").select("doc", "mark", "n").distinct(), "copies")
    release(hashed)

    found = stored(texts.select("doc", "body").mapInArrow(_keys, "key long, doc long"), "keys", "zstd")
    gone = sized(copies.select("doc").distinct(), 500_000)
    alone = found.join(gone, "doc", "left_anti")
    several = stored(alone.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key"), "several")
    wanted = stored(alone.join(several, "key").groupBy("doc").agg(F.collect_list("key").alias("keys")), "wanted")
    release(found, several)

    cut = texts.join(wanted, "doc").select("doc", "mark", "body", "keys").mapInArrow(_segments, "key long, mold binary, doc long, mark long, at int, segment binary")
    placed = stored(cut, "segments", "zstd")
    molds = placed.groupBy("mold").agg(F.min("doc").alias("doc"), F.min_by(F.struct("key", "segment"), "doc").alias("of"))
    molds = stored(molds.select("mold", "doc", "of.key", "of.segment"), "molds", "zstd")
    crowded = stored(molds.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    small = sized(crowded)
    spans = "mold binary, start int, end int"
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = molds.join(small, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key").select("key", "mold", "doc", "segment").mapInArrow(_shards, spans)
    windows = stored(molds.join(small, "key", "left_semi").select("mold", "doc", "segment").mapInArrow(_windows, "digest binary, mold binary, doc long, window int"), "windows")
    low = windows.groupBy("digest").agg(F.min("doc").alias("low"))
    dense = windows.join(low, "digest").where("doc > low").select("mold", F.col("window").alias("start"), (F.col("window") + LENGTH).alias("end"))
    inner = stored(shards.unionByName(dense).groupBy("mold").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "inner")

    facts = molds.select("mold", F.col("doc").alias("low")).join(inner, "mold", "left")
    joined = placed.select("mold", "doc", "mark", "at", F.length("segment").alias("n")).join(facts, "mold")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    own = F.transform(F.when(F.col("doc") > F.col("low"), whole).otherwise(F.col("spans")), lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    out = joined.select("doc", "mark", F.inline(own))
    out = stored(out.unionByName(copies.select("doc", "mark", F.lit(0).alias("start"), F.col("n").alias("end"))), "covers")
    release(wanted, placed, molds, crowded, windows, inner, copies)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (start, end of the removed runs), kept (the bytes that are left)."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), body.alias("body"))
    texts = texts.select("id", "doc", F.xxhash64("body").alias("mark"), "body")
    covers = repeats(texts.drop("id"), crowd).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.join(covers, ["doc", "mark"], "left").select("id", "body", "spans")
    return joined.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
