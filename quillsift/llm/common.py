"""Shared helpers: the folder all executors see, cutting lineage, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting by which a finished query's shuffle files are removed, not only once the driver's memory is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and the master is local (tests)."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillsift-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quillsift-{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, what: str = "cut", codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder now, as Parquet, and go on from the written rows; its shuffle files go at once."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


cut = stored


def release(*frames: DataFrame | None) -> None:
    """Delete what stored() has written for these frames, if it has, and what resting() names; nothing may read them any more."""
    for df in frames:
        for folder in filter(None, [getattr(df, "_folder", None), *getattr(df, "_folders", [])]):
            _delete(df.sparkSession, folder)


def resting(df: DataFrame, *parts: DataFrame | str) -> DataFrame:
    """df, noting that it reads these stored frames or folders, so that release(df) deletes them."""
    df._folders = [p if isinstance(p, str) else p._folder for p in parts]
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, without empty ones; what a worker makes of a slice stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()  # workers are kept for other tasks


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of this session have at most so many rows: texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) links: one row (id, class_id) per id that has a link; it is stored.

    class_id is the smallest id of the component. Alternating large-star and small-star steps. A step's smallest
    neighbours come from an aggregation with map-side combine and are stored before the join, so the join is one of two
    plain shuffles (or a broadcast, where few), and a hub with very many links is split by the skew join. Self links and
    repeated links do no harm; an empty input gives an empty result.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs, seen = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        mark = pairs.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = stored(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        release(pairs, least, down, low)
        pairs = after
    roots = pairs.groupBy("a").agg(F.min("b").alias("class_id")).select(F.col("a").alias("id"), "class_id")
    return stored(roots.unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("class_id")).distinct()), "classes")


def sized(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df, marked for broadcast only if it has been counted and has at most max_rows (short) rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many `_` in front that no column of df has it, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: A Bloom filter has at most so many blocks of 64 words of 64 bits: 64 MB.
MOST_BLOCKS = 1 << 17


def flagged(df: DataFrame, key: Column, keys: DataFrame, flag: str, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """df with a boolean column `flag`: false only if key isn't in keys' one column (long, without nulls). Nothing of df is shuffled.

    A blocked Bloom filter of 16 bits a key, broadcast; its size is bounded, so beyond 33 million keys the flag is true
    for more and more other rows (under 1 % of them up to there, 60 % at ten times as many).
    """
    blocks = max(1, min(most_blocks, keys.count() // 256 + 1))
    h = lambda k: F.xxhash64(k, F.lit(7))
    bits = lambda k: [F.shiftrightunsigned(h(k), 6 * n).bitwiseAND(F.lit(63)).cast("int") for n in range(1, 4)]
    place, word = (lambda k: F.pmod(F.xxhash64(k), F.lit(blocks)).cast("int")), (lambda k: h(k).bitwiseAND(F.lit(63)).cast("int"))
    mask = lambda k: reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits(k)])
    k = F.col(keys.columns[0])
    words = keys.groupBy(place(k).alias("p"), word(k).alias("w")).agg(F.bit_or(mask(k)).alias("m"))
    found = words.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("m"))  # 64 words at most
    block, own = unused(df, "_block", "_words")
    found = found.select(F.col("p").alias(block), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0).cast("long"))).alias(own))
    met = df.join(F.broadcast(found), place(key) == F.col(block), "left")
    hit = F.get(own, word(key)).bitwiseAND(mask(key)) == mask(key)
    return met.select(*columns(df), F.coalesce(hit, F.lit(False)).alias(flag))


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]):
    """Join condition left.k <=> right.v for each pair; null equals null."""
    out = F.lit(True)
    for k, v in pairs.items():
        out = out & left[k].eqNullSafe(right[v])
    return out


Pairs = Callable[[DataFrame], DataFrame]


class Stars:
    """Classes of ids that share buckets and are links, found by comparing a bucket's members with a few hubs of it.

    A round takes rows (bucket, id long, weight, fact). Buckets whose members are all of one class drop out. In
    every other one some members become hubs (the one of the largest weight, and about `hubs` more, by hash) and are
    compared with the members of other classes; after that a hub has nothing more to find and leaves the bucket. So a
    round's comparisons are hubs times members, not pairs, a bucket of copies is done after one round, and no pair of
    different classes goes unseen once no bucket is left.

    candidates: from joined rows (id, fact, hub, hub_fact) to distinct rows (a, b, ...); verify: those that are links.
    """

    def __init__(self, candidates: Pairs, verify: Pairs) -> None:
        self.candidates, self.verify = candidates, verify
        self.groups: DataFrame | None = None  # (id, class_id) of the ids that have links
        self.links: list[DataFrame] = []

    def round(self, rows: DataFrame, hubs: int) -> DataFrame | None:
        """The rows that are left after a round; None if no bucket is mixed. The rows given are released."""
        best = F.max_by("id", F.struct("weight", F.xxhash64("id")))
        state = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("class_id").alias("low"), F.max("class_id").alias("high"), best.alias("best"))
        state = stored(state.where("low < high").select("bucket", "members", "best"), "buckets")
        if not state.limit(1).count():
            return release(rows, state)
        turn = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("members") / hubs))
        live = stored(rows.join(state, "bucket").withColumn("is_hub", (F.col("members") <= 3) | (F.col("id") == F.col("best")) | ((turn == 0) & F.lit(hubs > 1))).drop("members", "best"), "members")
        release(rows, state)
        hub = live.where("is_hub").select("bucket", F.col("id").alias("hub"), F.col("fact").alias("hub_fact"), F.col("class_id").alias("hub_class"))
        met = live.join(hub, "bucket").where("class_id <> hub_class AND (NOT is_hub OR id > hub)")
        pairs = stored(self.candidates(met), "pairs")
        links = self.verify(pairs)
        release(pairs)
        left = live.where("NOT is_hub").select(rows.columns)
        if not links.limit(1).count():
            release(links)
            left._folder = live._folder
            return left
        edges, former = links.select("a", "b"), self.groups
        self.groups = components(edges if former is None else edges.unionByName(former.select(F.col("id").alias("a"), F.col("class_id").alias("b"))))
        self.links.append(links)
        now = left.drop("class_id").join(self.groups, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        left = stored(now.select(rows.columns), "left")
        release(former, live)
        return left

    def run(self, rows: DataFrame, hubs: int = 1, factor: int = 16) -> None:
        """Rounds with more and more hubs, until no bucket is mixed."""
        left: DataFrame | None = rows.withColumn("class_id", F.col("id"))
        if self.groups is not None:  # classes that are known before
            left = rows.join(self.groups, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        left._folder = getattr(rows, "_folder", None)  # released by the first round
        while left is not None:
            left = self.round(left, hubs)
            hubs *= factor
