"""Exact dedup with an extendible-hash index on shared files.

1. Map tasks write an entry file per document: key (64 bits of the hash), full hash, length, id. No text is moved, and
   none goes to Python: normalising and SHA-256 are Spark functions.
2. The directory doubles until no bucket has more than `capacity` different keys, or it has 2**MAX_DEPTH slots. It is
   worked out from counts by key prefix (at most 2**MAX_DEPTH numbers), and written beside the entries. A group of
   copies is one key, so it never overfills a bucket.
3. Map tasks read and hash the texts again, and go on with those whose key is in a Bloom filter of the keys that occur
   twice (64 MB at most; a text that passes by chance is a group of one), before any shuffle of texts. They collapse copies that they meet (comparing bytes), so a group
   holding a third of all rows sends one text per map task. Owner tasks take whole buckets, each a range of keys,
   sorted by key; texts of one key are chained and compared byte by byte.
4. Entries are joined with the chains.

Definitions: null text is empty; texts are equal if equal after deleting [\\x20\\x09-\\x0D]; all-blank texts are one
group. Of equal texts the row with most code points stays, then the smallest id (null ids last); of rows repeated with
their id, one stays (any of them: they differ in other columns at most). Ids are integers or strings. Only the id and text
columns are read; other columns may have any name. A very long text is one row, held
once or twice by a worker. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import cut, flagged, new_folder, release, resting, same, sliced, small_batches, table, unused

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
MAX_DEPTH = 16
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
#: A map task hands on the texts it has collapsed when they reach this many bytes.
FLUSH_BYTES = 16 << 20
#: So many rows (id, hash, size) of texts that go are broadcast.
MOST_GONE = 200_000


def sha256(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def directory(counts: dict[int, int], capacity: int, bits: int) -> list[tuple[int, int]]:
    """Bucket number and its depth for each of the 2**depth slots; counts: keys by the first `bits` bits.

    Starts with one bucket. An overfull bucket is split by its next bit; if its depth is that of the directory, the
    directory doubles first.
    """
    depth, slots, buckets = 0, [0], [(0, 0)]  # buckets: (depth, first `depth` bits)
    sums = [counts]
    for d in range(bits - 1, -1, -1):
        up: dict[int, int] = {}
        for k, n in sums[0].items():
            up[k >> 1] = up.get(k >> 1, 0) + n
        sums.insert(0, up)
    todo = [0]
    while todo:
        b = todo.pop()
        own, prefix = buckets[b]
        if own == bits or sums[own].get(prefix, 0) <= capacity:
            continue
        if own == depth:
            slots, depth = [s for s in slots for _ in (0, 1)], depth + 1
        buckets[b] = (own + 1, prefix << 1)
        buckets.append((own + 1, prefix << 1 | 1))
        low = (prefix << 1 | 1) << depth - own - 1
        slots[low : low + (1 << depth - own - 1)] = [len(buckets) - 1] * (1 << depth - own - 1)
        todo += [b, len(buckets) - 1]
    return [(s, buckets[s][0]) for s in slots]


def _entries(kind: str, with_body: bool, digest: Callable[[bytes], bytes]) -> tuple[Callable, str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [(x.as_py() or "") for x in batch.column(1)]
            bodies = [t.encode().translate(None, BLANK) for t in texts]
            hashes = [digest(b) for b in bodies]
            columns = [batch.column(0), pa.array([int.from_bytes(h[:8], "big", signed=True) for h in hashes], pa.int64()), pa.array([h.hex() for h in hashes]), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bodies, pa.binary())] * with_body, ["id", "key", "hash", "size"] + ["body"] * with_body)

    return run, f"id {kind}, key long, hash string, size long" + ", body binary" * with_body


def hashed(picked: DataFrame, digest: Callable[[bytes], bytes], with_body: bool) -> DataFrame:
    """id, key, hash, size of rows (id, text), and the normalised text as bytes if asked for; SHA-256 is Spark's own, another digest Python's."""
    if digest is not sha256:
        run, schema = _entries(picked.schema["id"].dataType.simpleString(), with_body, digest)
        return picked.mapInArrow(run, schema)
    text = F.coalesce("text", F.lit(""))
    rows = picked.select("id", F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("body"), F.length(text).cast("long").alias("size"))
    rows = rows.withColumn("hash", F.sha2("body", 256))
    key = F.conv(F.substring("hash", 1, 16), 16, -10).cast("long").alias("key")
    return rows.select("id", key, "hash", "size", *([F.col("body").cast("binary").alias("body")] if with_body else []))


def _better(a: tuple, b: tuple) -> tuple:
    """The one of two (size, id) that stays."""
    order = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0)
    return min(a, b, key=order)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _collapse(schema: pa.Schema) -> Callable:
    """Copies within a map task become one row: key, hash, body, rows, size, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list] = {}
        held = 0
        for batch in sliced(batches):
            for i, key, digest, size, body in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "hash", "size", "body")), strict=True):
                if (row := met.get(body)) is None:
                    met[body] = [key, digest, body, 1, size, i]
                    held += len(body) + 200
                else:
                    row[3] += 1
                    row[4], row[5] = _better((row[4], row[5]), (size, i))
            if held > FLUSH_BYTES:
                yield _batch([tuple(r) for r in met.values()], schema)
                met, held = {}, 0
        if met:
            yield _batch([tuple(r) for r in met.values()], schema)

    return run


def _chain(schema: pa.Schema) -> Callable:
    """An owner's rows come sorted by key; the different texts of a key form its chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for batch in batches:
            done = []
            for key, digest, body, rows, size, i in zip(*(batch.column(c).to_pylist() for c in ("key", "hash", "body", "rows", "size", "id")), strict=True):
                if key != now:
                    done += [tuple(x) for x in chain]
                    now, chain = key, []
                for link in chain:
                    if link[2] == body:
                        link[3] += rows
                        link[4], link[5] = _better((link[4], link[5]), (size, i))
                        break
                else:
                    chain.append([key, digest, body, rows, size, i])
            if done:
                yield _batch(done, schema)
        if chain:
            yield _batch([tuple(x) for x in chain], schema)

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per document: id, hash (hex), size, keep_id, keep_size, group_size, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    folder = new_folder(spark, "hash-index")
    again = Window.partitionBy("id", "key", "hash").orderBy(F.desc("size"))
    hashed(picked, digest, False).withColumn("copy", F.row_number().over(again)).write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")

    keys = cut(entries.groupBy("key").agg(F.count("*").alias("n")))
    slot = lambda bits: F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    counts = {r[0]: r[1] for r in keys.groupBy(slot(MAX_DEPTH).alias("k")).count().collect()}
    slots = directory(counts, capacity, MAX_DEPTH)
    spark.createDataFrame([(k, b, d) for k, (b, d) in enumerate(slots)], "slot long, bucket int, depth int").coalesce(1).write.parquet(f"{folder}/directory")
    buckets = F.broadcast(spark.read.parquet(f"{folder}/directory"))

    fields = "key long, hash string, body binary, rows long, size long, id " + kind
    arrow = pa.schema([("key", pa.int64()), ("hash", pa.string()), ("body", pa.binary()), ("rows", pa.int64()), ("size", pa.int64()), ("id", ARROW[kind])])
    texts = flagged(hashed(picked, digest, True), F.col("key"), keys.where("n > 1").select("key"), "again").where("again").drop("again")
    owned = texts.mapInArrow(_collapse(arrow), fields).withColumn("slot", slot(len(slots).bit_length() - 1)).join(buckets, "slot").drop("slot", "depth")
    owned = owned.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("key", "hash").drop("bucket")
    whole = owned.mapInArrow(_chain(arrow), fields).select("key", "hash", "body", F.col("rows").alias("group_size"), F.col("size").alias("keep_size"), F.col("id").alias("keep_id"))
    chains = cut(whole.drop("body"))

    found = chains.withColumnsRenamed({"key": "k", "hash": "h"})
    clash = chains.groupBy("key", "hash").count().where("count > 1").select("key", "hash")
    clashes = clash.limit(1).count() > 0
    if clashes:  # different texts with the same full hash: their rows are told apart by text
        bodies = cut(whole.join(clash, ["key", "hash"], "left_semi"))
        theirs = hashed(picked, digest, True).join(clash, ["key", "hash"], "left_semi")
        mark = F.row_number().over(Window.partitionBy("id", "key", "hash", "body").orderBy(F.desc("size")))
        split = theirs.withColumn("copy", mark).join(bodies, ["key", "hash", "body"]).drop("body")
        entries = entries.join(clash, ["key", "hash"], "left_anti")
    release(keys)
    joined = entries.join(found, (F.col("key") == F.col("k")) & (F.col("hash") == F.col("h")), "left").drop("k", "h")
    if clashes:
        joined = joined.unionByName(split.select(joined.columns))
    group = F.coalesce("group_size", F.lit(1)).cast("long")
    alone = F.col("group_size").isNull()
    out = joined.select(
        "id", "hash", "size", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_size", "size").alias("keep_size"), group.alias("group_size"),
        (alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size")) & (F.col("copy") == 1))).alias("kept"), "copy",
    )
    return resting(out, folder, chains, *([bodies] if clashes else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("hash").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact dedup drops; all columns stay as they are.

    Rows whose hash isn't in a Bloom filter of those that go stay without a shuffle, where those that go are too many to broadcast.
    """
    found = groups(docs, id_col, text_col)
    digest, size, flag = unused(docs, "_hash", "_size", "_flag")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumns({digest: F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256), size: F.length(text)})
    i, h, n = unused(marked, "_gone_id", "_gone_hash", "_gone_size")
    gone = cut(found.where("NOT (id <=> keep_id AND size = keep_size)").select(F.col("id").alias(i), F.col("hash").alias(h), F.col("size").alias(n)).distinct())
    repeated = found.where("copy > 1").limit(1).count() > 0
    release(found)
    apart = lambda rows, out: rows.join(out, same(rows, out, {id_col: i, digest: h, size: n}), "left_anti")
    if gone.limit(MOST_GONE + 1).count() <= MOST_GONE:
        left = apart(marked, F.broadcast(gone))
    else:
        rows = flagged(marked, F.xxhash64(F.col(digest)), gone.select(F.xxhash64(F.col(h)).alias("k")), flag)
        left = rows.where(~F.col(flag)).drop(flag).unionByName(apart(rows.where(F.col(flag)).drop(flag), gone))
    if repeated:
        left = left.dropDuplicates([id_col, digest])
    return left.drop(digest, size)


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
