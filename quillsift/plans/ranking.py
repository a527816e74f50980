"""Retrieval queries: benchmark texts as job descriptions against all documents; stated vectors against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.text import STOPWORDS, cosine
from quillsift.operators import cited, embed, retrieve
from quillsift.plans.registry import query, spread, table

K = 5
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9+#.]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units of one corpus."""
    return spread(table(spark, sf_dir, "documents")).select(F.lit(0).alias("corpus"), F.col("doc_id").alias("unit"), "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.lit(0).alias("corpus"), F.col("item_id").alias("query"), "text")


BM25_SQL = f"""
WITH d AS (SELECT doc_id AS unit, {sql_tokens("text")} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM d),
p AS (SELECT unit, len(t) AS length, unnest(t) AS term FROM d), tf AS (SELECT unit, length, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({sql_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query, unit, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / mean_length))) * times), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY query, unit),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, unit) AS rank FROM scores WHERE score > 0)
"""


@query("bm25_topk", BM25_SQL + f"SELECT query, unit, score, rank FROM lexical WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieve.bm25(units(spark, sf_dir), jobs(spark, sf_dir)).drop("corpus")
    return retrieve.top(scores, K, "query").select("query", "unit", "score", F.col("rank").cast("long"))


@query("term_stats", f"""
WITH p AS (SELECT lang AS corpus, doc_id, unnest({sql_tokens("text")}) AS term FROM documents), t AS (SELECT corpus, doc_id, term, count(*) AS tf FROM p GROUP BY ALL)
SELECT corpus, term, count(*) AS df, sum(tf)::BIGINT AS tf FROM t GROUP BY corpus, term""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("unit"), "text")
    return retrieve.term_stats(docs)


@query("keyword_overlap", f"""
WITH q AS (SELECT item_id AS query, list_distinct({sql_tokens("text")}) AS t FROM benchmark), a AS (SELECT query, len(t) AS n, unnest(t) AS term FROM q),
d AS (SELECT doc_id AS unit, unnest(list_distinct({sql_tokens("text")})) AS term FROM documents)
SELECT query, unit, round(count(*) / any_value(n), 6) AS score FROM a JOIN d USING (term) GROUP BY query, unit""")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.keyword_overlap(units(spark, sf_dir), jobs(spark, sf_dir))


VECTOR_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
u AS (SELECT vec_id AS unit, list_transform(e, lambda x: x / norm) AS v FROM n WHERE norm > 0),
s AS (SELECT q.unit AS query, u.unit, round(list_dot_product(q.v, u.v), 6) AS score FROM u q JOIN u ON q.unit % 100 = 0 AND q.unit <> u.unit),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, unit) AS rank FROM s)
"""


def similar(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest of all vectors for each whose id is divisible by 100, itself aside."""
    v = retrieve.unit_vectors(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "unit")).select("unit", "v")
    found = retrieve.dense(v, v.where("unit % 100 = 0").withColumnRenamed("unit", "query"), k + 1)
    return retrieve.top(found.where("query <> unit").drop("rank"), k, "query", positive=False)


@query("dense_topk", VECTOR_SQL + f"SELECT query, unit, score, rank FROM r WHERE rank <= {K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, sf_dir, K).select("query", "unit", "score", F.col("rank").cast("long"))


@query("cosine_guards", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)
SELECT vec_id, round(coalesce(CASE WHEN sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f)) > 0 THEN list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))) END, 0), 6) AS cosine FROM v""")
def cosine_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the next of its label; 0 for the last one."""
    v = table(spark, sf_dir, "embeddings")
    pairs = cited.following(v, "label", "vec_id")
    follow = pairs.join(v.select("vec_id", "embedding"), "vec_id").join(v.select(F.col("vec_id").alias("next"), F.col("embedding").alias("f")), "next", "left")
    return follow.select("vec_id", F.round(cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


RRF_SQL = BM25_SQL + f""",
kw AS (SELECT a.query, d.unit, round(count(*) / any_value(a.n), 6) AS score FROM (SELECT query, len(t) AS n, unnest(t) AS term FROM (SELECT item_id AS query, list_distinct({sql_tokens("text")}) AS t FROM benchmark)) a
  JOIN (SELECT doc_id AS unit, unnest(list_distinct({sql_tokens("text")})) AS term FROM documents) d USING (term) GROUP BY a.query, d.unit),
second AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, unit) AS rank FROM kw WHERE score > 0),
f AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.unit, b.unit) AS unit, a.rank AS bm25_rank, b.rank AS dense_rank, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s
  FROM (SELECT * FROM lexical WHERE rank <= 20) a FULL JOIN (SELECT * FROM second WHERE rank <= 20) b ON a.query = b.query AND a.unit = b.unit),
g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, unit) AS place FROM f)
SELECT query, unit, bm25_rank, dense_rank, round(s, 6) AS score, place, CASE WHEN bm25_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 'lexical+semantic' WHEN bm25_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS found_by FROM g WHERE place <= {K}
"""


@query("rrf_keyword", RRF_SQL)
def rrf_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with keyword overlap as the second ranker."""
    u, q = units(spark, sf_dir), jobs(spark, sf_dir)
    one = retrieve.top(retrieve.bm25(u, q).drop("corpus"), retrieve.POOL, "query")
    two = retrieve.top(retrieve.keyword_overlap(u, q), retrieve.POOL, "query")
    got = retrieve.fuse(one, two, K, "query")
    return got.select("query", "unit", F.col("bm25_rank").cast("long"), F.col("dense_rank").cast("long"), "score", F.col("place").cast("long"), "found_by")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by hashed words and n-grams; no SQL has the hash, tests compare with plain Python."""
    return embed.hashing(spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text"))


@query("hashing_embed")
def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir)


@query("rrf_fusion")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with the similarity of hashed vectors, for the benchmark texts against all documents."""
    u, q = units(spark, sf_dir), jobs(spark, sf_dir)
    one = retrieve.top(retrieve.bm25(u, q).drop("corpus"), retrieve.POOL, "query")
    asked = embed.hashing(q.select(F.col("query").alias("id"), "text"))
    some = F.exists("v", lambda x: x != 0)  # vectors have length 1, or no tokens
    vectors = embedded(spark, sf_dir).select(F.col("id").alias("unit"), F.col("embedding").alias("v")).where(some)
    two = retrieve.dense(vectors, asked.select(F.col("id").alias("query"), F.col("embedding").alias("v")).where(some), retrieve.POOL)
    got = retrieve.fuse(one, retrieve.top(two.drop("rank"), retrieve.POOL, "query"), K, "query")
    return got.select("query", "unit", F.col("bm25_rank").cast("long"), F.col("dense_rank").cast("long"), "score", F.col("place").cast("long"), "found_by")
