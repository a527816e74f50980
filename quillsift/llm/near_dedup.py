"""MinHash near-dedup with ProbMinHash signatures, banding and exact verification.

1. Map tasks turn each whole text into its five-word shingles, each with the weight 1 + ln(count), so that a line said
   very often doesn't outweigh all else, and a ProbMinHash signature: a shingle arrives at random registers as a Poisson process with its weight as rate, a register keeps the shingle that
   arrived first, and an element is given up once its next arrival is later than every register's (early
   termination). Two texts agree in a register with the probability Jaccard of their weighted shingles. A text that repeats
   some shingles more than others has a second signature with all weights 1, for the Jaccard of the sets.
2. Texts with the same shingles and counts collapse to one representative before any bucket is made, by an aggregation.
3. BANDS bands of ROWS registers of each signature make buckets. A pair at 0.8 by either measure shares none with
   probability 3e-6.
4. Links in a bucket are found by stars (see Stars). The first hub of a bucket is its most central member, that shares
   most buckets with others; most copies are found by it, in as many comparisons as the buckets have members. Rounds
   with other hubs go on among members of different classes until each bucket is of one class. No bucket, group or
   candidate is capped. Member and hub are a candidate only if they may be alike enough: each set is marked in MARKS bits,
   a shingle flips one of them, so as many bits as differ in two sets' marks, so many shingles differ at least (d). As no
   weight is below 1, the probability Jaccard is at most 1 - d / (sum of both texts' weights). That is exact, and decided
   within the join.
5. A pair is a link if the Jaccard similarity of its shingle sets, or the probability Jaccard of its weighted shingles, is
   at least LEAST; both are worked out exactly, from the whole texts.

Definitions: words are runs of letters, digits and characters beyond ASCII, lower-cased; a text of one to four words is
one shingle; texts without words (null, empty, blank) form one class. class_id is the smallest id of the class,
class_size its rows; repeated rows each count. Texts of rows with one id count as texts of one document. Rows with a null
id get a null class. Only the id (an integer) and the text are read, under names of their own, so further columns may
have any names. Equal similarities need no order: a link is a link. Very long texts are one row of as many shingles as
they have words, about 12 bytes a word in a worker. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import Stars, flagged, release, resting, sliced, small_batches, stored, table, unused

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Shingles that are signed together.
BLOCK = 150_000
MARKS = 1024
#: So many ids of documents that go are broadcast.
MOST_GONE = 500_000
SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def step(k: int) -> np.uint64:
    """k * ODD modulo 2**64."""
    return np.uint64(k * int(ODD) % (1 << 64))


class Words(dict):
    """Word -> 64-bit hash; the words that were met are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = found
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of a text, sorted, and their counts."""
    found = (text or "").lower().encode().translate(SPACED).split()
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.array([*map(words.__getitem__, found)], np.uint64)
    n = max(1, len(h) - WORDS + 1)
    s = np.full(n, len(h) < WORDS, np.uint64)
    for j in range(min(WORDS, len(h))):
        s = mix(s * ODD + h[j : j + n])
    return np.unique(s, return_counts=True)


def is_plain(counts: np.ndarray) -> bool:
    return not len(counts) or bool((counts == counts[0]).all())


def weights_of(counts: np.ndarray) -> np.ndarray:
    """1 + ln(count); 1 each where all are alike."""
    return np.ones(len(counts)) if is_plain(counts) else 1 + np.log(counts)


def digest(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Of the shingles and their relative weights."""
    return xxhash.xxh3_128_digest(hashes.tobytes() + (b"" if is_plain(counts) else counts.tobytes()))


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of shingles a with weights x and b with weights y: the sum over i in both of 1 / sum over j of max(x[j] / x[i], y[j] / y[i]).

    Sorted by x / y, the maximum is the first ratio from i on and the second before it, so running sums give all of them.
    """
    every = np.union1d(a, b)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, a)], q[np.searchsorted(every, b)] = x, y
    with np.errstate(divide="ignore"):
        order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    above, below = np.cumsum(p[::-1])[::-1], np.cumsum(q) - q
    both = (p > 0) & (q > 0)
    return float((1 / (above[both] / p[both] + below[both] / q[both])).sum())


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """REGISTERS shingle hashes for each of `docs` texts; element e, of text owner[e], has hash hashes[e] and weight weights[e]."""
    first = np.full(docs * REGISTERS, np.inf)
    kept = np.zeros(docs * REGISTERS, np.uint64)
    latest = np.full(docs, np.inf)
    h, w, o, time = hashes, weights, owner, np.zeros(len(hashes))
    turn = 0
    while len(h):
        draw = mix(h + step(2 * turn + 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / w
        live = time < latest[o]
        if not live.all():
            h, w, o, time = h[live], w[live], o[live], time[live]
        at = o * REGISTERS + (mix(h + step(2 * turn + 2)) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = h[won]
        latest = first.reshape(docs, REGISTERS).max(1)
        turn += 1
    return kept.reshape(docs, REGISTERS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, digest, n, bands, marks, plain, mass); plain: all shingles have one weight, so one signature says it all."""
    words = Words()

    def done(ids: list, found: list) -> pa.RecordBatch:
        sets, counts = [s for s, _ in found], [c for _, c in found]
        lengths = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), lengths)
        plain = [is_plain(c) for c in counts]
        again = [k for k, p in enumerate(plain) if not p]  # signed by weight too
        own = np.concatenate([owner, *(np.full(lengths[k], len(sets) + j) for j, k in enumerate(again))])
        weights = np.concatenate([np.ones(len(owner)), *(weights_of(counts[k]) for k in again)])
        sig = signatures(np.concatenate([*sets, *(sets[k] for k in again)]), weights, own, len(sets) + len(again))
        bands = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            bands = mix(bands * ODD + sig[:, r::ROWS])
        bands = bands.view(np.int64)
        of = {k: np.union1d(bands[k], bands[len(sets) + j]) for j, k in enumerate(again)}
        bands = [list(of.get(k, bands[k])) if n else [] for k, n in enumerate(lengths)]
        flips = np.bincount(owner * MARKS + ((np.concatenate(sets) >> np.uint64(40)) % np.uint64(MARKS)).astype(np.int64), minlength=len(sets) * MARKS)
        marks = np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(len(sets), -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([*map(digest, sets, counts)], pa.binary()), pa.array(lengths, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array([*marks], pa.list_(pa.int64())), pa.array(plain), pa.array([float(weights_of(c).sum()) for c in counts])],
            ["id", "digest", "n", "bands", "marks", "plain", "mass"],
        )

    for batch in sliced(batches):
        ids, sets, held = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            sets.append(shingles(t.as_py(), words))
            held += len(sets[-1][0]) * (1 if is_plain(sets[-1][1]) else 2) + 50
            if held > BLOCK:
                yield done(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield done(ids, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, digest, shingles, counts); counts are null where all are alike."""
    words = Words()
    for batch in sliced(batches, 200):
        found = [shingles(t.as_py(), words) for t in batch.column(1)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([s for s, _ in found]).view(np.int64)))
        counts = pa.array([None if is_plain(c) else c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(*f) for f in found], pa.binary()), lists, counts], ["id", "digest", "shingles", "counts"])


def _by_weight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, of_a, of_b, x, y) -> (a, b, similarity) of the pairs that are links by weight."""
    for batch in sliced(batches, 200):
        rows = []
        for a, b, one, two, x, y in zip(*(batch.column(k) for k in range(6)), strict=True):
            one, two = (v.values.to_numpy().view(np.uint64) for v in (one, two))
            x, y = (weights_of(v.values.to_numpy()) if v.is_valid else np.ones(len(own)) for v, own in ((x, one), (y, two)))
            rows.append((a.as_py(), b.as_py(), probability_jaccard(one, x, two, y)))
        a, b, found = (np.array(c) for c in zip(*rows, strict=True))
        near = found >= LEAST - 1e-9
        yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near]), pa.array(found[near])], ["a", "b", "similarity"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are links; sets: (id, digest, shingles, counts)."""
    one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}"), F.col("counts").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("of_a", "of_b"))
    met_both = pairs.join(one, "a").join(two, "b").withColumn("both", both).withColumn("either", F.size("of_a") + F.size("of_b") - F.col("both"))
    near = F.col("both") >= LEAST * F.col("either") - 1e-9
    weighed = ~near & (F.col("x").isNotNull() | F.col("y").isNotNull())
    kept = F.when(weighed, F.struct("of_a", "of_b", "x", "y"))
    judged = stored(met_both.where(near | weighed).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"), kept.alias("w")), "judged")
    more = judged.where("w IS NOT NULL").select("a", "b", "w.*").mapInArrow(_by_weight, "a long, b long, similarity double")
    links = stored(judged.where("w IS NULL").drop("w").unionByName(more), "links")
    release(judged)
    return links


def met(joined: DataFrame) -> DataFrame:
    """Pairs (a, b) of members and hubs that may be links: what their shingles can have in common suffices."""
    one, two = F.col("fact"), F.col("hub_fact")
    apart = reduce(Column.__add__, [F.bit_count(one["marks"][k].bitwiseXOR(two["marks"][k])) for k in range(MARKS // 64)])
    total = one["n"] + two["n"]
    most = F.least((total - apart) / 2, one["n"], two["n"])
    by_weight = (~one["plain"] | ~two["plain"]) & (apart <= (1 - LEAST) * (one["mass"] + two["mass"]) + 1e-6)
    fits = joined.where((most * (1 + LEAST) >= LEAST * total - 1e-6) | by_weight)
    return fits.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, class_id, class_size (rows); links between copies of one text aren't expanded."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_sign, "id long, digest binary, n int, bands array<long>, marks array<long>, plain boolean, mass double"), "signatures")
    one = F.first(F.struct("n", "bands", "marks", "plain", "mass")).alias("of")  # the same in all rows of a digest
    reps = stored(signed.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), one), "representatives")

    placed = reps.select(F.explode("of.bands").alias("bucket"), F.col("rep").alias("id"))
    shared = stored(placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    rows = stored(placed.join(shared, "bucket"), "bands")
    ids = stored(rows.groupBy("id").agg(F.sum("members").alias("weight")), "ids")
    facts = ids.join(reps, F.col("id") == F.col("rep")).select("id", "weight", F.struct("of.n", "of.marks", "of.plain", "of.mass").alias("fact"))
    asked = flagged(texts, F.col("id"), ids.select("id"), "asked").where("asked").select("id", "text")  # and a few more by chance
    whole = asked.mapInArrow(_sets, "id long, digest binary, shingles array<long>, counts array<int>")
    sets = stored(whole.groupBy("id", "digest").agg(F.first(F.struct("shingles", "counts")).alias("s")).select("id", "digest", "s.*"), "sets")

    stars = Stars(met, lambda pairs: similar(pairs, sets))
    stars.run(stored(rows.drop("members").join(facts, "id").select("bucket", "id", "weight", "fact"), "placed"))
    release(shared, rows, sets, ids)
    named = reps.select("digest", "rep", "size")
    if stars.groups is None:
        named = named.withColumn("class_id", F.col("rep"))
    else:
        named = named.join(stars.groups, F.col("rep") == F.col("id"), "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    named = stored(named.select(F.col("digest").alias("_d"), "class_id", "size"), "named")
    totals = stored(named.groupBy("class_id").agg(F.sum("size").alias("class_size")), "totals")
    named, former = stored(named.join(totals, "class_id").select("_d", "class_id", "class_size"), "named"), named
    release(former, totals, stars.groups, reps, *stars.links)
    known = F.col("id").isNotNull()
    joined = signed.select("id", "digest").join(named, F.col("digest") == F.col("_d"), "left")
    out = joined.select("id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("class_size")).alias("class_size"))
    return resting(out, signed, named)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each class; all columns stay as they are.

    Rows whose id isn't in a Bloom filter of those that go stay without a shuffle, where those that go are too many to broadcast.
    """
    (own, flag), i = unused(docs, "_gone", "_flag"), F.col(id_col).cast("long")
    found = classes(docs, id_col, text_col)
    gone = stored(found.where("id <> class_id").select(F.col("id").alias(own)).distinct(), "gone")
    release(found)
    if gone.limit(MOST_GONE + 1).count() <= MOST_GONE:
        return docs.join(F.broadcast(gone), i == F.col(own), "left_anti")
    rows = flagged(docs, i, gone, flag)
    maybe = rows.where(F.col(flag)).drop(flag)
    return rows.where(~F.col(flag)).drop(flag).unionByName(maybe.join(gone, i == F.col(own), "left_anti"))
