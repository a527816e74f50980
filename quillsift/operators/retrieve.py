"""Retrieval: BM25 by token equi-joins, vector similarity, reciprocal-rank fusion, keyword overlap."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillsift.functions.text import STOPWORDS, dot, let, tokens
from quillsift.operators import embed
from quillsift.sources.shared import kept

K1, B, RRF_K, POOL = 1.5, 0.75, 60, 20
#: Units to a task, so that what a task holds doesn't grow with their number.
UNITS = 10_000
STOP = frozenset(STOPWORDS)


def term_stats(units: DataFrame) -> DataFrame:
    """(corpus, term, df, tf) of units (corpus, unit, text)."""
    rows = units.select("corpus", "unit", F.explode(tokens(F.col("text"))).alias("term"))
    per_unit = rows.groupBy("corpus", "unit", "term").agg(F.count("*").alias("tf"))
    return per_unit.groupBy("corpus", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def bm25(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(corpus, query, unit, score) where a query (corpus, query, text) and a unit (corpus, unit, text) share a term.

    Statistics are those of each corpus, of which there may be many (each document's own units, say). Queries without a
    corpus are put to all of them. Query terms that repeat count again. Only postings of query terms are shuffled.
    """
    if "corpus" in queries.columns:
        return _bm25_by_unit(units, queries)
    on = ["term"]
    sized = units.select("corpus", "unit", tokens(F.col("text")).alias("t"))
    totals = sized.groupBy("corpus").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean_length"))
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy(*on, "query").agg(F.count("*").alias("times"))
    terms = asked.select(*on).distinct()
    postings = sized.select("corpus", "unit", F.size("t").alias("length"), F.explode("t").alias("term")).join(terms, on, "left_semi")
    postings = postings.groupBy("corpus", "term", "unit", "length").agg(F.count("*").alias("tf"))
    rare = postings.groupBy("corpus", "term").agg(F.count("*").alias("df")).join(totals, "corpus")
    rare = rare.select("corpus", "term", "mean_length", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = postings.join(rare, ["corpus", "term"]).join(asked, on)
    return _summed(hits)


def _summed(hits: DataFrame) -> DataFrame:
    tf, scaled = F.col("tf"), F.col("length") / F.col("mean_length")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * scaled)) * F.col("times")
    return hits.groupBy("corpus", "query", "unit").agg(F.round(F.sum(part), 6).alias("score"))


def _bm25_by_unit(units: DataFrame, queries: DataFrame) -> DataFrame:
    """bm25() of queries that name their corpus. Texts are cut into words once; a unit's words come together, with UNITS units to
    a task, and weights of query terms, a small table, go to them: scores are summed up there, and no pair of query and
    unit moves."""
    own = units.select("corpus", "unit", tokens(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    sized = kept(own, "words")
    totals = sized.groupBy("corpus").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    asked = queries.select("corpus", "query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("corpus", "term", "query").agg(F.count("*").alias("times"))
    asked = kept(asked, "asked")
    terms = kept(asked.select("corpus", "term").distinct(), "terms")
    df = sized.select("corpus", F.explode(F.array_distinct("t")).alias("term")).join(terms, ["corpus", "term"], "left_semi").groupBy("corpus", "term").agg(F.count("*").alias("df")).join(totals, "corpus")
    weights = df.select("corpus", "term", "mean_length", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = kept(weights.join(asked, ["corpus", "term"]), "weights")
    least = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = sized.repartition(max(least, sized.count() // UNITS + 1), "corpus", "unit")
    postings = together.select("corpus", "unit", "length", F.explode("t").alias("term")).join(terms, ["corpus", "term"], "left_semi")
    postings = postings.groupBy("corpus", "unit", "length", "term").agg(F.count("*").alias("tf"))
    return _summed(postings.join(weights, ["corpus", "term"]))


def top(scores: DataFrame, k: int, *keys: str, tie: str = "unit", positive: bool = True) -> DataFrame:
    """The k best by score of each key, with their rank; ties by `tie`; scores of 0 and less only if asked for."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), tie)
    return (scores.where("score > 0") if positive else scores).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """`v`: the vector in doubles at length 1; null for a zero vector, which is then similar to nothing."""
    v = F.transform(column, lambda x: x.cast("double"))
    at_one = lambda w: let(F.sqrt(dot(w, w)), lambda norm: F.when(norm > 0, F.transform(w, lambda x: x / norm)))
    return vectors.withColumn("v", let(v, at_one))


def packed(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """(size, names, numbers): up to `rows` vectors of one size (name long, v) side by side in a row, numbers as the bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes[sizes > 0]):
                own = batch.filter(pa.array(sizes == size))
                for at in range(0, own.num_rows, rows):
                    part = own.slice(at, rows)
                    matrix = part.column(1).flatten().to_numpy().astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], ["size", "names", "numbers"])

    return vectors.where("v IS NOT NULL").select(F.col(name).cast("long"), "v").mapInArrow(run, "size long, names array<long>, numbers binary")


def _meet(k: int) -> Callable:
    """(names, numbers, block, block_names, block_numbers, size) -> (query, unit, score): a task's k best of each query.

    A block's k-th best scores run along: a chunk of vectors hands over only what reaches them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, matrix = None, np.empty(0, np.int64), np.empty((0, 0))
        best: tuple[np.ndarray, ...] = ()

        def done() -> Iterator[pa.RecordBatch]:
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(queries[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "unit", "score"])

        for batch in batches:
            for names, numbers, block, asked, theirs, size in zip(*(batch.column(c) for c in ("names", "numbers", "block", "block_names", "block_numbers", "size")), strict=True):
                if block.as_py() != now:
                    yield from done()
                    now, queries, best = block.as_py(), asked.values.to_numpy(), ()
                    matrix = np.frombuffer(theirs.as_buffer(), float).reshape(-1, size.as_py())
                    least = np.full(len(queries), -np.inf)
                units = names.values.to_numpy()
                scores = np.round(matrix @ np.frombuffer(numbers.as_buffer(), float).reshape(-1, size.as_py()).T, 6) + 0.0
                if scores.shape[1] > k:
                    edge = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                else:
                    edge = least
                q, u = np.nonzero(scores >= edge[:, None])
                rows = [q, units[u], scores[q, u]]
                if best:
                    rows = [np.concatenate(x) for x in zip(best, rows, strict=True)]
                order = np.lexsort((rows[1], -rows[2], rows[0]))
                q = rows[0][order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                order = order[place < k]
                best = tuple(x[order] for x in rows)
                full = best[0][np.flatnonzero(np.arange(len(order)) - np.searchsorted(best[0], best[0]) == k - 1)]
                least[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
        yield from done()

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2_000, chunk: int = 2_000, spread: int = 8) -> DataFrame:
    """(query, unit, score, rank): the k most similar of all (unit, v) for each of a stated query set (query, v).

    Exact. Queries and vectors are packed, so many to a row. Each chunk of vectors goes to every block of queries of its
    size (an equi-join on block and slice: a block stands in `spread` slices, so that its chunks aren't one task's), where one
    product of matrices gives all scores; what is shuffled afterwards is k rows per query and task. Equal scores (6 places)
    are ordered by unit.
    """
    blocks = packed(queries, "query", block).select("size", F.col("names").alias("block_names"), F.col("numbers").alias("block_numbers"))
    blocks = kept(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    wide = kept(blocks.groupBy("size").agg(F.collect_list("block").alias("blocks")), "sizes")  # a number for each block
    chunks = packed(vectors, "unit", chunk).join(F.broadcast(wide), "size").withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(spread)))
    chunks = chunks.select("size", "names", "numbers", "slice", F.explode("blocks").alias("block"))
    met = chunks.join(blocks.drop("size").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>"))), ["block", "slice"])
    out = met.select("names", "numbers", "block", "block_names", "block_numbers", "size").mapInArrow(_meet(k), "query long, unit long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "unit")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, *keys: str) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (keys, unit, rank): score, ranks, found_by, place.

    Equal scores: by lexical rank, then by semantic rank.
    """
    a, b = lexical.select(*keys, "unit", F.col("rank").alias("bm25_rank")), semantic.select(*keys, "unit", F.col("rank").alias("dense_rank"))
    both = a.join(b, [*keys, "unit"], "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    score = part("bm25_rank") + part("dense_rank")
    names = F.concat_ws("+", F.when(F.col("bm25_rank").isNotNull(), "lexical"), F.when(F.col("dense_rank").isNotNull(), "semantic"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_s"), F.col("bm25_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last(), "unit")
    rows = both.withColumns({"_s": score, "found_by": F.when(names == "", "none").otherwise(names)}).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= k).withColumn("score", F.round("_s", 6)).drop("_s")


def keyword_overlap(units: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of a query's different terms that a unit has; pairs that share none are left out.

    Units of several corpora (with that column, which the queries then lack) keep their corpus.
    """
    own = ["corpus"] if "corpus" in units.columns and "corpus" not in queries.columns else []
    q = queries.select("query", F.array_distinct(tokens(F.col("text"))).alias("t")).where(F.size("t") > 0)
    asked = q.select("query", F.size("t").alias("n"), F.explode("t").alias("term"))
    have = units.select(*own, "unit", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return have.join(asked, "term").groupBy(*own, "query", "unit").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))


def similarity(units: DataFrame, queries: DataFrame, most: int = 1_000) -> DataFrame:
    """(corpus, query, unit, score) of a few queries, a rubric's, to the units of every corpus, by hashed vectors; above 0 only.

    The queries go out with the function, so more than `most` raise.
    """
    rows = queries.select("query", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries")
    names, matrix = [r[0] for r in rows], np.array([embed.vector(r[1]) for r in rows]).reshape(len(rows), -1)
    kinds = StructType([units.schema["corpus"], units.schema["unit"], queries.schema["query"]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, asked = embed.Features(), pa.array(names)
        for batch in batches:
            if batch.num_rows and names:
                scores = np.round(np.array([embed.vector(t.as_py(), features) for t in batch.column(2)]) @ matrix.T, 6)
                u, q = np.nonzero(scores > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(u)), batch.column(1).take(pa.array(u)), asked.take(pa.array(q)), pa.array(scores[u, q])], ["corpus", "unit", "query", "score"])

    return units.select("corpus", "unit", "text").mapInArrow(run, kinds)


def search(units: DataFrame, queries: DataFrame, k: int, second: Callable[[DataFrame, DataFrame], DataFrame] = similarity) -> DataFrame:
    """The k best units of each corpus for each query, by BM25 and a second ranker fused: (corpus, query, unit, place, score, ...).

    Each corpus is searched by itself, with its own statistics: a document's units, say, of which there are a few dozen.
    """
    one, two = (top(scores, POOL, "corpus", "query") for scores in (bm25(units, queries), second(units, queries)))
    return fuse(one, two, k, "corpus", "query")


#: What a rank adds to a fused score; NONE is that of a unit that a list doesn't have, after all others.
NONE = POOL + 1
PARTS = [0.0, *(1.0 / (RRF_K + rank) for rank in range(1, NONE)), 0.0]


class Within:
    """search() of corpora that are at hand, each by itself and whole: a document's units, beside the document.

    Of the queries (name, text) only the words are kept. Scores, ranks and ties are those of bm25(), of keyword_overlap() or
    similarity(), and of fuse().
    """

    def __init__(self, queries: list[tuple[str, str]], k: int, second: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.k, self.by_vectors = k, second is similarity
        self.asked = [Counter(self.kept(self.words(text))) for _, text in queries]
        self.names, self.terms = [name for name, _ in queries], {w for own in self.asked for w in own}
        self.met: dict[tuple[str, ...], np.ndarray] = {}
        self.features = embed.Features() if self.by_vectors else None
        self.matrix = embed.vectors([self.words(text) for _, text in queries], self.features).T if self.by_vectors else None

    @staticmethod
    def words(text: str | None) -> list[str]:
        return embed.TOKEN.findall((text or "").lower())

    @staticmethod
    def kept(words: list[str]) -> list[str]:
        """tokens() of a text's words."""
        return [w for w in words if len(w) > 1 and w not in STOP]

    def __call__(self, corpora: list[list[tuple[int, str]]]) -> list[list[tuple[str, int, int]]]:
        """(query, place, number in the corpus) of the k best units of each corpus of units (unit, text), best first."""
        words = [[self.words(text) for _, text in own] for own in corpora]
        ranks = self.by_cosine([[unit for unit, _ in own] for own in corpora], words) if self.by_vectors else [None] * len(corpora)
        return [self.search([unit for unit, _ in own], said, best) for own, said, best in zip(corpora, words, ranks, strict=True)]

    def cosines(self, words: list[list[str]]) -> np.ndarray:
        """Of texts to the queries; those of short texts that were met are kept, up to a bound. By einsum, which starts no threads: each
        core has a worker already."""
        keys = [*map(tuple, words)]
        new = [w for w in dict.fromkeys(keys) if w not in self.met]
        found = {}
        for at in range(0, len(new), UNITS // 5):
            part = new[at : at + UNITS // 5]
            found |= zip(part, np.round(np.einsum("ij,jk->ik", embed.vectors(part, self.features), self.matrix), 6), strict=True)
        out = np.array([self.met[w] if w in self.met else found[w] for w in keys]).reshape(len(keys), len(self.names))
        if len(self.met) < 100_000:
            self.met |= {w: c for w, c in found.items() if len(w) < 5}
        return out

    def by_cosine(self, units: list[list[int]], words: list[list[list[str]]]) -> list[list[dict[int, int]]]:
        """For each corpus and query the ranks of the POOL best units, by their numbers in the corpus."""
        scores = self.cosines([w for own in words for w in own])
        sizes = [*map(len, units)]
        row, q = np.nonzero(scores > 0)
        at = np.repeat(np.arange(len(sizes)), sizes)[row]
        names = np.array([u for own in units for u in own], np.int64)[row]
        order = np.lexsort((names, -scores[row, q], q, at))
        group = (at * len(self.names) + q)[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group) + 1
        best = rank <= POOL
        number = (row - np.append(0, np.cumsum(sizes))[at])[order]
        out: list[list[dict[int, int]]] = [[{} for _ in self.names] for _ in units]
        for g, i, r in zip(group[best].tolist(), number[best].tolist(), rank[best].tolist(), strict=True):
            out[g // len(self.names)][g % len(self.names)][i] = r
        return out

    def search(self, units: list[int], words: list[list[str]], near: list[dict[int, int]] | None) -> list[tuple[str, int, int]]:
        sizes = [len(self.kept(own)) for own in words]
        n, mean = len(units), sum(sizes) / max(1, len(units))
        terms, postings = self.terms, {w: {} for w in self.terms}
        for i, own in enumerate(words):
            for w in own:
                if w in terms:
                    tf = postings[w]
                    tf[i] = tf.get(i, 0) + 1
        parts = {}
        for w, own in postings.items():
            if own:
                idf = math.log(1 + (n - len(own) + 0.5) / (len(own) + 0.5))
                parts[w] = [(i, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (sizes[i] / mean)))) for i, tf in own.items()]
        best = lambda scores: {i: rank for rank, (_, _, i) in enumerate(sorted((-score, units[i], i) for i, score in scores)[:POOL], 1)}
        out = []
        for q, (name, asked) in enumerate(zip(self.names, self.asked, strict=True)):
            scores: dict[int, float] = {}
            shared: dict[int, int] = {}
            for w in sorted(asked.keys() & parts.keys()):
                for i, part in parts[w]:
                    scores[i] = scores.get(i, 0.0) + part * asked[w]
                    shared[i] = shared.get(i, 0) + 1
            one = best([(i, r) for i, score in scores.items() if (r := round(score, 6)) > 0])
            two = best(shared.items()) if near is None else near[q]  # by the number of words, which is in the order of their share
            fused = sorted([(-(PARTS[a] + PARTS[b]), a, b, units[i], i) for i in one.keys() | two.keys() for a, b in [(one.get(i, NONE), two.get(i, NONE))]])
            out += [(name, place, f[-1]) for place, f in enumerate(fused[: self.k], 1)]
        return out


#: Second rankers that Within has too.
AT_HAND = (keyword_overlap, similarity)
#: Rankers that a ranking is measured against: (units, queries) -> (query, unit, score).
BASELINES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "bm25": lambda units, queries: bm25(units.withColumn("corpus", F.lit(0)), queries.drop("corpus")).drop("corpus"),
    "keyword": lambda units, queries: keyword_overlap(units.drop("corpus"), queries.drop("corpus")),
    "similarity": lambda units, queries: similarity(units.withColumn("corpus", F.lit(0)), queries.drop("corpus")).drop("corpus"),
}
