"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are put in an order by hash. A document's virtual finish time is the running total of its
source's tokens, itself included, divided by the source's target; the second time a document is used its source's
whole size is added. Entries are range-sorted by virtual finish time over all sources and taken until the total budget
is used up; the entry that crosses it is cut. All sources reach their targets at time 1, so each one's taken words
come within one document of its target.

Running totals are made in two steps, so a hot source isn't one task: totals by source and slice of the hash range,
then within a slice; the global order likewise, by slice of virtual time.

Definitions: a null source is a source of its own, ordered last; null text has size 0; documents of size 0 take 0. The
targets of sources share `factor` times all sizes by weights 3, 1, 2, repeating in code point order of the source; a
target stops at 2 times its source's size and the excess is shared again by weight (closed form: the water level at
which min(2 * size, level * weight) adds up). Equal hashes are ordered by id, then size. Only the id, source and text
columns are read, further ones may have any name. A very long text is one row, and is cut in its row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import columns, cut, release, resting, same, table, unused

SEED, FACTOR, MOST = "mix-1", 1.5, 2
#: Slices of a source's hash range (hex digits) and of virtual time.
SLICE_DIGITS, TIME_SLICES = 3, 20_000


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), order.alias("order"), F.xxhash64(text).alias("mark"))


def targets(by_source: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row per source, so windows over all are small."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % 3
    known = by_source.withColumn("weight", F.when(turn == 0, 3).when(turn == 1, 1).otherwise(2)).withColumn("total", F.sum("source_size").over(everything))
    # Sources fill up in the order of size / weight: with the first k full, the level is what is left by weight.
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    full, weights = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.col("total") * F.lit(float(factor)) - full * MOST) / weights
    known = known.withColumn("own", level).withColumn("fits", F.col("own") * F.col("weight") < F.col("source_size") * MOST)
    level = F.min_by(F.when(F.col("fits"), F.col("own")), F.when(F.col("fits"), F.col("source_size") / F.col("weight"))).over(everything)
    target = F.least(F.col("source_size") * F.lit(float(MOST)), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return known.select("source", "source_size", target.alias("target"))


def take(sized: DataFrame, factor: float = FACTOR) -> DataFrame:
    """How many words of each row of (id, source, size, order, mark) the mix takes; adds source_size, target and taken."""
    sized = cut(sized.withColumn("slice", F.substring("order", 1, SLICE_DIGITS)))
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = kept = cut(slices.withColumn("before", F.coalesce(F.sum("in_slice").over(before), F.lit(0))))
    goals = goals_kept = cut(targets(slices.groupBy("source").agg(F.sum("in_slice").alias("source_size")), factor))
    slices = slices.withColumnsRenamed({"source": "_s", "slice": "_l"}).drop("in_slice")
    inner = Window.partitionBy("source", "slice").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("within", F.sum("size").over(inner))
    run = run.join(slices, same(run, slices, {"source": "_s", "slice": "_l"})).withColumn("upto", F.col("before") + F.col("within")).drop("_s", "_l")
    goals = goals.withColumnRenamed("source", "_s")
    run = run.join(F.broadcast(goals) if goals.limit(100_001).count() <= 100_000 else goals, run.source.eqNullSafe(goals._s)).drop("_s", "within", "before", "slice")
    run = run.withColumn("row", F.monotonically_increasing_id())

    passes = F.posexplode(F.sequence(F.lit(1), F.lit(MOST)))
    entries = run.select("id", "source", "size", "order", "mark", "source_size", "target", "row", "upto", passes.alias("again", "turn"))
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("again") * F.col("source_size")) / F.col("target")).otherwise(F.lit(float(MOST * 10)))
    entries = entries_kept = cut(entries.withColumn("finish", finish).withColumn("slice", F.least(F.floor(F.col("finish") * (TIME_SLICES // 2)), F.lit(TIME_SLICES)).cast("int")))
    budget = goals.agg(F.coalesce(F.floor(F.sum("target") + 0.5), F.lit(0)).cast("long")).first()[0]
    release(sized, kept, goals_kept)
    times = entries.groupBy("slice").agg(F.sum("size").alias("in_slice"))  # at most TIME_SLICES + 1 rows
    times = times.withColumn("before", F.coalesce(F.sum("in_slice").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    times = times.select("slice", "in_slice", (F.lit(budget) - F.col("before")).alias("left"))
    entries = entries.join(F.broadcast(times), "slice")
    whole = entries.where("left >= in_slice").withColumn("taken", F.col("size"))
    none = entries.where("left <= 0").withColumn("taken", F.lit(0).cast("long"))
    ahead = F.sum("size").over(Window.partitionBy("slice").orderBy("finish", "source", "order", "again", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    edge = entries.where("left > 0 AND left < in_slice").withColumn("taken", F.greatest(F.lit(0), F.least("size", F.col("left") - ahead)))
    taken = whole.unionByName(none).unionByName(edge)
    out = taken.groupBy("row", "id", "source", "size", "mark", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")
    return resting(out, entries_kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = take(sizes(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of docs: a document is there as often as it is taken, a part of it cut after its words.

    length_col, if docs has it, is the length of the text again where the text was cut. Rows equal in id, source and text
    share what they take; what isn't divisible by their number is one more part of one of them.
    """
    entries = take(sizes(docs, id_col, source_col, text_col))
    mark, source = unused(docs, "_mark", "_source")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumns({mark: F.xxhash64(text), source: F.col(source_col).cast("string")})
    i, s, m, n, share, rest, turn = unused(marked, "_i", "_s", "_m", "_n", "_share", "_rest", "_turn")
    both = F.sum("taken").cast("long"), F.count("*")
    found = entries.groupBy(F.col("id").alias(i), F.col("source").alias(s), F.col("mark").alias(m), F.col("size").alias(n))
    found = cut(found.agg(F.floor(both[0] / both[1]).alias(share), F.pmod(*both).alias(rest)).where((F.col(share) > 0) | (F.col(rest) > 0)))
    release(entries)
    met = lambda which: marked.join(which, same(marked, which, {id_col: i, source: s, mark: m}))
    rows = met(found.where(F.col(share) > 0).drop(rest))
    left = found.where(F.col(rest) > 0)
    if left.limit(1).count():
        rows = rows.unionByName(met(left.drop(share).withColumnRenamed(rest, share)).dropDuplicates([id_col, source, mark]))
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(0), F.ceil(F.col(share) / F.col(n)).cast("int") - 1)))
    words = F.least(F.col(n), F.col(share) - F.col(turn) * F.col(n)).cast("int")
    start = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, words), "")
    part = words < F.col(n)
    changed = {text_col: F.when(part, start).otherwise(F.col(text_col))}
    if length_col in docs.columns:
        changed[length_col] = F.when(part, F.length(start)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return rows.withColumns(changed).select(*columns(docs))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total * {FACTOR}::DOUBLE - coalesce(sum(source_size) OVER o, 0) * 2) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS own FROM w
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce((SELECT arg_min(own, source_size / weight) FROM l WHERE own * weight < source_size * 2), 'inf'::DOUBLE) * weight) AS target FROM l),
e AS (SELECT d.*, g.source_size, g.target, again, CASE WHEN target > 0 THEN (sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) + again * g.source_size) / target ELSE 20 END AS finish
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, range(2) r(again) WHERE again = 0
  UNION ALL SELECT d.*, g.source_size, g.target, again, CASE WHEN target > 0 THEN (sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) + again * g.source_size) / target ELSE 20 END
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, range(2) r(again) WHERE again = 1),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, ord, again, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead, (SELECT floor(sum(target) + 0.5) FROM g) AS budget FROM e)
SELECT doc_id, size, source_size, any_value(target) AS target, sum(greatest(0, least(size, budget - ahead)))::BIGINT AS taken FROM t GROUP BY doc_id, size, source_size
"""
