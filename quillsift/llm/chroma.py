"""Audio fingerprints from pitch classes (chroma), for a column of recordings.

A recording is binary: 8-bit unsigned mono PCM, or WAV (PCM of 8 or 16 bits, channels are averaged). Frames of FRAME
samples, HOP apart, are folded from their spectrum to 12 pitch classes. 16 filters, each the log ratio of two sums over
rectangles of frames and pitch classes, are read off the integral image of the chroma; 2 bits (Gray code) of each make
a 32-bit item, one for each place of a window of WIDTH frames.

Alignment: the histogram of offsets at which equal items of two recordings stand gives the offsets to try; at each that
lets at least half of the shorter one, and LEAST_ITEMS, overlap, the share of differing bits (bit error rate) is counted
over the whole overlap. Pairs of at most MAX_ERROR are links. LEAST_ITEMS is three windows that share no frame: chance
pairs of shorter overlaps pass MAX_ERROR, so shorter recordings are the same only if all their items are.

Search: recordings with the same items are one representative. Each item of a recording (a run of more than SHORT_RUN
equal ones counts once) puts it into a bucket, so all pairs with an equal item meet: all members of a bucket of at most
FEW, then, by stars (see Stars), those of larger ones that aren't of one class by then. A pair gives one offset, and goes
on only if the overlap suffices and the items at the places of AROUND before and after it, where both have them, differ in no more
bits than WRONG and MORE allow (long runs go on without that). That is the search's only loss;
tests measure its recall against align() of all pairs. Items don't travel once for each pair: recordings are dealt into groups by hash, and a cell (two groups) gets each
recording that it needs once.

The test tables have no audio: the query takes the UTF-8 bytes of each whole text as 8-bit PCM, so equal texts are
equal recordings and near copies are recordings that run together in parts.

Definitions: null and empty recordings, and ones that can't be read, have no items and are each a class of their own.
Shorter recordings than a window are padded with silence to one item. Rows with one id count as one recording, the first
by its items; a null id gets a null class. Of alignments of equal error, the one with most votes counts, then the
nearest. Only the id (an integer) and the recording are read, under names of their own. Very long recordings are worked
on in blocks of BLOCK frames. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import Stars, components, flagged, release, sliced, small_batches, stored, table

RATE, FRAME, HOP, WIDTH = 8000, 512, 64, 16
LOW_HZ, HIGH_HZ = 60.0, 1800.0
MAX_ERROR, LEAST_ITEMS = 0.2, 3 * WIDTH
#: Places of items that are compared around an equal one, two (near, far) to a number of 64 bits. So many bits of each may
#: differ, and so many more of all: MAX_ERROR and 2.5 standard deviations, or up to 2.5 bits more, whatever their number.
#: (A line, as the join's condition must stay below 8 000 bytes of code, or the JVM never compiles it.)
AROUND = tuple((side * near, side * far) for near, far in ((8, 16), (24, 32), (40, 56)) for side in (-1, 1))
WRONG, MORE = 15, 8
#: Equal items in a row that are each a place of their own; longer runs are one, and any offset of two runs is tried.
SHORT_RUN = 4
#: Chroma frames that are worked on together.
BLOCK = 20_000
#: Buckets of more members are worked on by stars; hubs of such a one in the first round.
FEW, FIRST_HUBS = 64, 16
#: Bytes of items in a group, offsets in a cell, groups at least; items that are compared at once.
GROUP_BYTES, CELL_PAIRS, GROUPS, AT_ONCE = 100 << 20, 500_000, 6, 2_000_000


def _pitch_classes(rate: int) -> np.ndarray:
    """Spectrum bin -> pitch class, by the nearest half-tone of the bin's frequency."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), 12))
    used = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    out[np.flatnonzero(used), np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return out / np.maximum(1, out.sum(0))


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames): two of each kind and width, spread over the pitch classes."""
    return [(k % 4, 3 * k % 9, 3 + k % 2 * 2 if 3 * k % 9 < 8 else 3, WIDTH >> (k // 8)) for k in range(16)]


FILTERS = _filters()


def _rectangles(kind: int, y: int, h: int, w: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """(frame, pitch class, frames, pitch classes) of the two sides of a filter."""
    x = (WIDTH - w) // 2
    h = min(h, 12 - y)
    a, b = w // 2, max(1, h // 2)
    if kind == 0:  # earlier against later frames
        return [(x, y, a, h)], [(x + a, y, w - a, h)]
    if kind == 1:  # lower against higher pitch classes
        return [(x, y, w, b)], [(x, y + b, w, h - b)]
    if kind == 2:  # the two diagonals
        return [(x, y, a, b), (x + a, y + b, w - a, h - b)], [(x + a, y, w - a, b), (x, y + b, a, h - b)]
    c = w // 4  # middle against outer frames
    return [(x + c, y, w - 2 * c, h)], [(x, y, c, h), (x + w - c, y, c, h)]


def samples(recording: bytes | None) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1, and their rate."""
    if recording and recording[:4] == b"RIFF" and recording[8:12] == b"WAVE":
        try:
            with wave.open(io.BytesIO(recording)) as f:
                raw, width, channels, rate = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels(), f.getframerate()
        except (wave.Error, EOFError):
            return np.empty(0, np.float32), RATE
        if width not in (1, 2):
            return np.empty(0, np.float32), RATE
        got = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128 if width == 1 else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
        return got[: len(got) // channels * channels].reshape(-1, channels).mean(1), rate
    return (np.frombuffer(recording or b"", np.uint8).astype(np.float32) - 128) / 128, RATE


class Chroma:
    """Frames to pitch classes; keeps the tables of each sample rate."""

    def __init__(self) -> None:
        self.window = np.hanning(FRAME).astype(np.float32)
        self.classes: dict[int, np.ndarray] = {}

    def frames(self, x: np.ndarray, rate: int) -> np.ndarray:
        """(frames, 12), every frame of length 1 (silence: all equal)."""
        if rate not in self.classes:
            self.classes[rate] = _pitch_classes(rate).astype(np.float32)
        least = FRAME + (WIDTH - 1) * HOP
        if len(x) < least:
            x = np.concatenate([x, np.zeros(least - len(x), np.float32)])
        cut_up = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        out = []
        for k in range(0, len(cut_up), BLOCK):
            part = cut_up[k : k + BLOCK]
            spectrum = np.fft.rfft((part - part.mean(1, keepdims=True)) * self.window, axis=1)
            out.append((spectrum.real**2 + spectrum.imag**2) @ self.classes[rate])
        chroma = np.sqrt(np.vstack(out)).astype(float) + 1e-6
        return chroma / np.sqrt((chroma**2).sum(1, keepdims=True))


def items(chroma: np.ndarray) -> np.ndarray:
    """32-bit items of consecutive windows."""
    n = len(chroma) - WIDTH + 1
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)

    def mean(parts: list[tuple[int, int, int, int]]) -> np.ndarray:
        total = sum(image[x + w : x + w + n, y + h] - image[x : x + n, y + h] - image[x + w : x + w + n, y] + image[x : x + n, y] for x, y, w, h in parts)
        return total / sum(w * h for _, _, w, h in parts)

    out = np.zeros(n, np.uint64)
    for k, f in enumerate(FILTERS):
        one, two = _rectangles(*f)
        value = np.log(mean(one) / mean(two))
        level = (value > -0.12).astype(np.uint64) + (value > 0) + (value > 0.12)
        out |= (level ^ (level >> np.uint64(1))) << np.uint64(2 * k)
    return out.astype(np.uint32)


def fingerprint(recording: bytes | None, chroma: Chroma) -> np.ndarray:
    x, rate = samples(recording)
    return items(chroma.frames(x, rate)) if len(x) else np.empty(0, np.uint32)


Reader = Callable[[bytes | None, Chroma], np.ndarray]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float, int] | None:
    """Offset (place in a less place in b), bit error rate and overlap of the best alignment; None if no offset has an equal item and overlap enough."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    width = high - low
    at = np.repeat(np.arange(len(a)), width)
    equal = order[np.arange(len(at)) - np.repeat(width.cumsum() - width, width) + np.repeat(low, width)]
    offsets, votes = np.unique(at - equal, return_counts=True)
    best = None
    for offset, n in zip(offsets.tolist(), votes.tolist(), strict=True):
        i, j = max(0, offset), max(0, -offset)
        overlap = min(len(a) - i, len(b) - j)
        if overlap >= LEAST_ITEMS and 2 * overlap >= min(len(a), len(b)):
            error = float(np.bitwise_count(a[i : i + overlap] ^ b[j : j + overlap]).sum()) / (32 * overlap)
            best = min(best, (error, -n, abs(offset), offset, overlap)) if best else (error, -n, abs(offset), offset, overlap)
    return best and (best[3], best[0], best[4])


def _print(batches: Iterator[pa.RecordBatch], read: Reader = fingerprint) -> Iterator[pa.RecordBatch]:
    """(id, recording) -> (id, digest, n, items)."""
    chroma = Chroma()
    for batch in sliced(batches):
        rows = []
        for i, r in zip(batch.column(0), batch.column(1), strict=True):
            found = read(r.as_py(), chroma)
            rows.append((i.as_py(), hashlib.sha256(found.astype("<u4").tobytes()).hexdigest(), len(found), found.view(np.int32)))
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "digest", "n", "items"])


def placed(own: DataFrame) -> DataFrame:
    """Rows (bucket, id, weight, fact) of recordings (id, items): one per item, one per run of equal items where that is long."""
    item = lambda k: F.get("items", k).cast("long")
    n = F.size("items")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get("items", k) != F.get("items", k - 1)))

    def place(k: Column, last: Column) -> Column:
        around = [F.shiftleft(item(k + far), 32).bitwiseOR(item(k + near).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"at{x}") for x, (near, far) in enumerate(AROUND)]
        return F.struct(F.get("items", k).alias("bucket"), F.struct(n.alias("n"), k.alias("first"), last.alias("last"), *around).alias("fact"))

    def run(first: Column, x: Column) -> Column:
        last = F.coalesce(F.get("starts", x + 1), n) - 1
        return F.when(last - first < SHORT_RUN, F.transform(F.sequence(first, last), lambda k: place(k, k))).otherwise(F.array(place(first, last)))

    runs = own.where(n >= LEAST_ITEMS).select("id", "items", starts.alias("starts"))
    return runs.select("id", n.alias("weight"), F.inline(F.flatten(F.transform("starts", run)))).select("bucket", "id", "weight", "fact")


def frequent(own: DataFrame) -> DataFrame:
    """Rows (bucket long): items that stand at more than FEW places of recordings (id, items)."""
    found = own.where(F.size("items") >= LEAST_ITEMS).select(F.explode("items").alias("bucket"))
    return found.groupBy("bucket").count().where(F.col("count") > FEW).select(F.col("bucket").cast("long"))


def paired(rows: DataFrame) -> DataFrame:
    """Joined rows (id, fact, hub, hub_fact) of all pairs in a bucket. Both sides are the same rows, so they are shuffled once (merged: their size is underrated)."""
    both = rows.alias("x").join(rows.alias("y").hint("merge"), F.col("x.bucket") == F.col("y.bucket")).where("x.id > y.id")
    return both.select("x.id", "x.fact", F.col("y.id").alias("hub"), F.col("y.fact").alias("hub_fact"))


def met(joined: DataFrame) -> DataFrame:
    """(a, b, low, high): pairs a > b and the offsets, place in a less place in b, at which a member and a hub may align."""
    one, two = F.col("fact"), F.col("hub_fact")
    low, high = one["first"] - two["last"], one["last"] - two["first"]
    least = F.greatest(F.lit(LEAST_ITEMS), F.shiftright(F.least(one["n"], two["n"]) + 1, 1))
    enough = (low + least <= one["n"]) & (high + two["n"] >= least)  # some offset leaves an overlap of that
    over = sum((F.coalesce(F.bit_count(one[f"at{x}"].bitwiseXOR(two[f"at{x}"])) - WRONG, F.lit(0)) for x in range(len(AROUND))), F.lit(0))
    alike = over <= MORE
    up = F.col("id") > F.col("hub")
    fits = joined.where((F.col("id") != F.col("hub")) & enough & ((low != high) | alike))
    return fits.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"), F.when(up, low).otherwise(-high).alias("low"), F.when(up, high).otherwise(-low).alias("high")).distinct()


def _aligned(pairs: pa.Table, prints: pa.Table) -> pa.Table:
    """Offsets (cell, a, b, low, high) and recordings (home, id, items) of one cell -> (a, b, place, error) of the links."""
    ids, items = prints["id"].to_numpy(), prints["items"].combine_chunks()
    order = np.argsort(ids)
    ids, starts, sizes = ids[order], items.offsets.to_numpy()[:-1][order].astype(np.int64), np.diff(items.offsets.to_numpy())[order].astype(np.int64)
    body = items.values.to_numpy().view(np.uint32)
    out = []
    a, b, low, high = (pairs[c].to_numpy().astype(np.int64) for c in ("a", "b", "low", "high"))
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    todo = np.arange(len(a))
    for part in np.array_split(todo, max(1, math.ceil(int((high - low + 1).sum()) / CELL_PAIRS))):
        tries = (high - low + 1)[part]
        row = np.repeat(part, tries)
        offset = low[row] + np.arange(len(row)) - np.repeat(tries.cumsum() - tries, tries)
        i, j = np.maximum(0, offset), np.maximum(0, -offset)
        overlap = np.minimum(sizes[x[row]] - i, sizes[y[row]] - j)
        fits = (overlap >= LEAST_ITEMS) & (2 * overlap >= np.minimum(sizes[x[row]], sizes[y[row]]))
        row, offset, i, j, overlap = (v[fits] for v in (row, offset, i, j, overlap))
        for k in np.array_split(np.arange(len(row)), max(1, math.ceil(int(overlap.sum()) / AT_ONCE))):
            if not len(k):
                continue
            n = overlap[k]
            heads = n.cumsum() - n
            along = np.arange(int(n.sum())) - np.repeat(heads, n)
            one, two = body[np.repeat(starts[x[row[k]]] + i[k], n) + along], body[np.repeat(starts[y[row[k]]] + j[k], n) + along]
            error = np.add.reduceat(np.bitwise_count(one ^ two).astype(np.int64), heads) / (32 * n)
            votes = np.add.reduceat((one == two).astype(np.int64), heads)
            ok = (error <= MAX_ERROR) & (votes > 0)
            out += [*zip(a[row[k]][ok].tolist(), b[row[k]][ok].tolist(), error[ok].tolist(), (-votes[ok]).tolist(), np.abs(offset[k][ok]).tolist(), offset[k][ok].tolist(), strict=True)]
    best: dict[tuple[int, int], tuple] = {}
    for one, two, *rank in out:
        best[one, two] = min(best.get((one, two), (2.0,)), tuple(rank))
    found = [(*k, v[3], v[0]) for k, v in best.items()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.Table.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["a", "b", "place", "error"])


def recordings(media: DataFrame, id_col: str = "id", audio_col: str = "audio", read: Reader = fingerprint) -> DataFrame:
    """One row per row of media: id, n_items, digest, class_id, aligned_to, place, error.

    aligned_to: another recording of the class that this one was compared with, with fewest bit errors; place: item of
    this recording less the item of that one. Equal recordings are aligned to the first of them at 0.
    read: from a recording to its items.
    """
    small_batches(media.sparkSession)
    sounds = media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).cast("binary").alias("sound"))
    printed = stored(sounds.mapInArrow(partial(_print, read=read), "id long, digest string, n long, items array<int>"), "fingerprints")
    with_items = printed.where("id IS NOT NULL AND n > 0")
    reps = stored(with_items.groupBy("digest").agg(F.min("id").alias("rep"), F.first("items").alias("items")), "recordings")
    own = stored(reps.groupBy(F.col("rep").alias("id")).agg(F.min("items").alias("items")), "items")
    total = 4 * (own.agg(F.sum(F.size("items"))).first()[0] or 0)

    def verify(pairs: DataFrame) -> DataFrame:
        groups = max(GROUPS, math.ceil(total / GROUP_BYTES), math.ceil(math.sqrt(2 * pairs.count() / CELL_PAIRS)))
        cells = groups * (groups + 1) // 2
        x, y = (F.pmod(F.xxhash64(c), F.lit(groups)) for c in ("a", "b"))
        dealt = pairs.select((F.least(x, y) * groups + F.greatest(x, y)).alias("cell"), "a", "b", "low", "high")
        needed = dealt.select("cell", "a", "b").distinct().select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(own, "id").select(F.col("cell").alias("home"), "id", "items")
        both = dealt.repartition(cells, "cell").groupBy("cell").cogroup(needed.repartition(cells, "home").groupBy("home"))
        return stored(both.applyInArrow(_aligned, "a long, b long, place long, error double"), "links")

    stars, keys = Stars(met, verify), stored(frequent(own), "frequent")
    rows = flagged(placed(own), F.col("bucket").cast("long"), keys, "often")
    pairs = stored(met(paired(rows.where("NOT often").select("bucket", "id", "fact"))), "pairs")
    links = verify(pairs)
    release(pairs)
    if links.limit(1).count():
        stars.links, stars.groups = [links], components(links.select("a", "b"))
    stars.run(stored(rows.where("often").drop("often"), "often"), FIRST_HUBS)
    release(own, keys)
    named = reps.select("digest", "rep")
    if stars.groups is None:
        named = named.select("digest", "rep", F.col("rep").alias("class_id"), F.lit(None).cast("long").alias("aligned_to"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("error"))
    else:
        links = reduce(DataFrame.unionByName, stars.links)
        ways = links.select(F.col("a").alias("x"), F.col("b").alias("aligned_to"), "place", "error").unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("aligned_to"), (-F.col("place")).alias("place"), "error"))
        best = ways.groupBy("x").agg(F.min(F.struct("error", "aligned_to", "place")).alias("best"))
        named = named.join(stars.groups, F.col("rep") == F.col("id"), "left").join(best, F.col("rep") == F.col("x"), "left")
        named = named.select("digest", "rep", F.coalesce("class_id", "rep").alias("class_id"), "best.aligned_to", "best.place", "best.error")
    named = stored(named.withColumnRenamed("digest", "_d"), "named")
    release(reps, stars.groups, *stars.links)
    rows = printed.select("id", "digest", "n").join(named, (F.col("digest") == F.col("_d")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    copy = F.col("rep").isNotNull() & (F.col("id") != F.col("rep"))
    return rows.select(
        "id", F.col("n").alias("n_items"), "digest", F.coalesce("class_id", "id").alias("class_id"), F.when(copy, F.col("rep")).otherwise(F.col("aligned_to")).alias("aligned_to"),
        F.when(copy, 0).otherwise(F.col("place")).cast("long").alias("place"), F.when(copy, 0.0).otherwise(F.col("error")).alias("error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sounds = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("audio"))
    found = recordings(sounds, "doc_id")
    return found.withColumnsRenamed({"id": "doc_id", "digest": "fingerprint_sha256", "place": "offset", "error": "bit_error_rate"})
