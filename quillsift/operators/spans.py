"""Half-open spans (document_id, start, end): overlap joins, containment, unions, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Spans meet by stretches of this many characters, so a long document isn't one join key.
STRETCH = 2_000


def _stretches(start: str, end: str) -> Column:
    """The stretches of the text that a span lies in; an empty span lies in one."""
    return F.sequence(F.floor(F.col(start) / STRETCH), F.floor(F.greatest(F.col(start), F.col(end) - 1) / STRETCH))


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of overlapping spans of a document; right's start and end come back as r_start and r_end.

    Spans are laid out by stretch, document and stretch are the equi-key, and a pair counts in the first stretch it shares.
    """
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end", "document_id": "_d"}).withColumn("_r", F.explode(_stretches("r_start", "r_end")))
    rows = left.withColumn("_l", F.explode(_stretches("start", "end")))
    first = F.greatest(F.floor(F.col("start") / STRETCH), F.floor(F.col("r_start") / STRETCH))
    on = (F.col("document_id") == F.col("_d")) & (F.col("_l") == F.col("_r")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("_l") == first)
    return rows.join(r, on).drop("_d", "_l", "_r")


def page_of(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """The page of the first block (by block_seq) that holds each span's start; null if none does."""
    b = blocks.select(F.col("document_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), "page", "block_seq").withColumn("_b", F.explode(_stretches("_s", "_e")))
    at = F.floor(F.col("start") / STRETCH)
    hit = points.join(b, (F.col("document_id") == F.col("_d")) & (at == F.col("_b")) & (F.col("_s") <= F.col("start")) & (F.col("start") < F.col("_e")), "left")
    return hit.groupBy(*points.columns).agg(F.min_by("page", "block_seq").alias("page"))


def outermost(spans: DataFrame, seq: str = "seq") -> DataFrame:
    """Spans that no span before them (by start, longest first) contains."""
    before = Window.partitionBy("document_id").orderBy("start", F.desc("end"), seq).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_e", F.coalesce(F.max("end").over(before), F.lit(-1))).where("_e < end").drop("_e")


def merged(spans: DataFrame) -> DataFrame:
    """Unions of overlapping or touching spans."""
    order = Window.partitionBy("document_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("document_id", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def coverage(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Share of each document of (document_id, length) that its spans cover, 1 at most, 0 for an empty document."""
    covered = merged(spans).groupBy("document_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    share = F.when(F.col("length") > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("length"))).otherwise(0.0)
    return lengths.join(covered, "document_id", "left").select("document_id", F.coalesce("covered", F.lit(0)).alias("covered"), share.alias("coverage"))


def segments(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """The text cut at all span ends: (document_id, start, end, n_spans, ids), ids of the spans over each piece in order."""
    ends = spans.select("document_id", F.explode(F.array("start", "end")).alias("at")).unionByName(lengths.select("document_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("length").cast("bigint"))).alias("at")))
    pieces = ends.distinct().withColumn("end", F.lead("at").over(Window.partitionBy("document_id").orderBy("at"))).where("end IS NOT NULL").withColumnRenamed("at", "start")
    s = spans.select(F.col("document_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), "id").withColumn("_b", F.explode(_stretches("_s", "_e")))
    at = F.floor(F.col("start") / STRETCH)
    over = pieces.join(s, (F.col("document_id") == F.col("_d")) & (at == F.col("_b")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")), "left")
    return over.groupBy("document_id", "start", "end").agg(F.count("id").alias("n_spans"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def verify(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """Citations (document_id, start, end, quote) with `valid`: within the text, and the quote stands for what is there."""
    from quillsift.functions.text import same_text
    from quillsift.operators.beside import passages

    found = passages(citations, docs, "_there")
    return found.withColumn("valid", F.coalesce((F.col("quote") == F.col("_there")) | same_text(F.col("quote"), F.col("_there")), F.lit(False))).drop("_there")
