"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words, its whole text. Every passage is encoded (character classes, word
lengths, repetition within it and against the passage before, hashed words), gated attention weighs the passages, and
the weighted representation is scored: score = sigmoid(c . sum_k a_k h_k + b), a = softmax(w . (tanh(V h) * sigmoid(U h))).

It is fitted by Adam with numpy on the driver, from a bounded sample of labelled rows, each with all its passages: in the
order of the hash of their ids, `max_train` documents, but no more than come to `max_passages` passages (the first one
always counts). Scoring reads every passage. Only the text is an input of a score. Labels come from rows with crc32(id as
text) mod 4 <> 2 only.

Definitions: null text is empty and counts as one empty passage; label rows with a null id or label are left out, of
repeated label rows the mean decides (0.5 and more is 1); without two classes in the sample the score is the share of
label 1 (0.5 without labels). Repeated documents each get their row, and count once in the sample; different texts of one
id each count, ordered by hash, so reruns agree. Further columns may have any name; scores() replaces
one named as its score. A very long text is a bag of as many passages as it has, in one worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, KeysView

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import sliced, small_batches, table, unused

PASSAGE, MAX_TRAIN, MAX_PASSAGES, THRESHOLD = 64, 4_000, 200_000, 0.7
BUCKETS, HIDDEN, GATE, ROUNDS, RATE, DECAY, SEED = 16, 12, 8, 150, 0.03, 1e-4, 11
FEATURES = 13 + BUCKETS


def _classes() -> np.ndarray:
    """Byte -> character class: lower, upper, digit, sentence marks, other ASCII marks, blank, beyond ASCII."""
    out = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        k = 6 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:?'" else 5 if c.isspace() else 4
        out[b, k] = 1
    return out


CLASSES = _classes()


class Buckets(dict):
    """Word -> bucket, by a hash of the bare word; the words that were met are kept, up to a bound."""

    def __missing__(self, word: str) -> int:
        bucket = xxhash.xxh3_64_intdigest(word.strip(".,;:!?").lower()) % BUCKETS
        if len(self) < 100_000:
            self[word] = bucket
        return bucket


def passages(text: str | None) -> list[list[str]]:
    words = (text or "").split()
    return [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]


def encode(bag: list[list[str]], buckets: Buckets) -> np.ndarray:
    """One row of FEATURES per passage. buckets: a worker's memory of hashed words."""
    n = len(bag)
    counts, rest, words = np.zeros((n, 256)), np.zeros((n, 6)), np.zeros((n, BUCKETS))
    before: set[str] | KeysView[str] = set()
    for k, seg in enumerate(bag):
        body = " ".join(seg).encode()
        counts[k] = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
        if m := len(seg):
            own = Counter(seg)
            pairs = sum(map(str.__eq__, seg, seg[1:])) if len(own) < m else 0
            rest[k] = (np.log1p(m), len(body) / m, len(own) / m, max(own.values()) / m, pairs / m, len(own.keys() & before) / len(own))
            words[k] = np.bincount([*map(buckets.__getitem__, own)], minlength=BUCKETS) / len(own)
            before = own.keys()
    shares = counts @ CLASSES
    return np.hstack([shares / np.maximum(1, shares.sum(1, keepdims=True)), rest, words])


def _forward(p: dict, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict:
    """Scores of bags; the passages of bag i are lengths[i] rows of x from starts[i]."""
    h = np.tanh(x @ p["e"] + p["f"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
    logit = (t * s) @ p["w"]
    logit = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), lengths))
    a = logit / np.repeat(np.add.reduceat(logit, starts), lengths)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}


def gradient(p: dict, x: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict:
    """Of the mean cross entropy, by parameter."""
    r = _forward(p, x, starts, lengths)
    dz = (r["y"] - y) / len(y)
    g = {"b": dz.sum(), "c": r["z"].T @ dz}
    dzh = np.repeat(np.outer(dz, p["c"]), lengths, axis=0)
    da = (dzh * r["h"]).sum(1)
    dl = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, starts), lengths))
    g["w"] = (r["t"] * r["s"]).T @ dl
    dt, ds = np.outer(dl, p["w"]) * r["s"] * (1 - r["t"] ** 2), np.outer(dl, p["w"]) * r["t"] * r["s"] * (1 - r["s"])
    g["v"], g["u"] = r["h"].T @ dt, r["h"].T @ ds
    dx = (r["a"][:, None] * dzh + dt @ p["v"].T + ds @ p["u"].T) * (1 - r["h"] ** 2)
    g["e"], g["f"] = x.T @ dx, dx.sum(0)
    return g


def fit(bags: list[np.ndarray], labels: np.ndarray) -> dict:
    """Parameters, with the mean and scale of the features; a constant score if there is one class or none."""
    if not len(labels) or labels.min() == labels.max():
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    lengths = np.array([len(b) for b in bags])
    starts = np.concatenate([[0], lengths.cumsum()[:-1]])
    raw = np.vstack(bags)
    mean, scale = raw.mean(0), raw.std(0) + 1e-3
    x, y = (raw - mean) / scale, labels.astype(float)
    rng = np.random.default_rng(SEED)
    make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"e": make(FEATURES, HIDDEN), "f": np.zeros(HIDDEN), "v": make(HIDDEN, GATE), "u": make(HIDDEN, GATE), "w": make(GATE), "c": make(HIDDEN), "b": np.log(y.mean() / (1 - y.mean()))}
    m, q = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}
    for step in range(1, ROUNDS + 1):
        g = gradient(p, x, y, starts, lengths)
        for k in p:
            grad = g[k] + DECAY * p[k] * (k not in "bf")
            m[k] = 0.9 * m[k] + 0.1 * grad
            q[k] = 0.999 * q[k] + 0.001 * grad**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "scale": scale}


def score(model: dict, bags: list[np.ndarray]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(bags), model["constant"])
    lengths = np.array([len(b) for b in bags])
    starts = np.concatenate([[0], lengths.cumsum()[:-1]])
    return _forward(model, (np.vstack(bags) - model["mean"]) / model["scale"], starts, lengths)["y"]


def held_out(i: Column) -> Column:
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES
) -> dict:
    """Fit on at most max_train labelled documents that aren't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(label_col).alias("_y"))
    known = known.where(~held_out(F.col("_i"))).groupBy("_i").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    first = (F.xxhash64("_i"), F.col("_i"))
    picked = F.broadcast(known.orderBy(*first).limit(max_train))  # short rows, max_train of them
    texts = docs.select(F.col(id_col).alias("_d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).withColumn("_m", F.xxhash64("_t"))
    rows = texts.join(picked, texts["_d"] == picked["_i"]).select("_i", "_y", "_m", "_t")
    long = rows.groupBy("_i", "_m").agg(F.first(F.greatest(F.lit(1), F.ceil(F.regexp_count("_t", F.lit(r"\S+")) / PASSAGE))).alias("n"))
    taken, total = [], 0
    for r in long.orderBy(*first, "_m").limit(max_train).collect():  # short rows again
        total += r.n
        if taken and total > max_passages:
            break
        taken.append((r["_i"], r["_m"]))
    if not taken:
        return fit([], np.empty(0))
    chosen = F.broadcast(spark.createDataFrame(taken, long.select("_i", "_m").schema))
    rows = rows.join(chosen, ["_i", "_m"]).groupBy("_i", "_m").agg(F.first("_y").alias("_y"), F.first("_t").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in sliced(batches):
            xs = [encode(passages(t.as_py()), buckets).astype("<f4").tobytes() for t in batch.column("_t")]
            if xs:
                yield pa.RecordBatch.from_arrays([batch.column("_i").cast(pa.string()), batch.column("_m"), batch.column("_y"), pa.array(xs, pa.binary())], ["i", "m", "y", "x"])

    found = sorted((r.i, r.m, r.y, bytes(r.x)) for r in rows.mapInArrow(run, "i string, m long, y int, x binary").collect())  # len(taken) rows
    return fit([np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float) for *_, x in found], np.array([y for _, _, y, _ in found]))


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """docs' columns with score_col, which replaces one of that name; every passage of every text is read."""
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    fields = docs.schema.fields
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in sliced(batches):
            out: list[float] = []
            bags: list[np.ndarray] = []
            held = 0
            for t in batch.column(at):
                bags.append(encode(passages(t.as_py()), buckets))
                held += len(bags[-1])
                if held > 4096:
                    out += score(model, bags).tolist()
                    bags, held = [], 0
            if bags:
                out += score(model, bags).tolist()
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    plain = [f"c{k}" for k in range(len(fields))]  # whatever characters the names have
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, fields, strict=True))
    return docs.toDF(*plain).mapInArrow(run, f"{kinds}, score double").toDF(*docs.columns, score_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = scores(docs, model).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that score below THRESHOLD."""
    model = train(docs, labels, id_col, text_col)
    (own,) = unused(docs, "__score")
    return scores(docs, model, id_col, text_col, own).where(F.col(own) >= THRESHOLD).drop(own)
