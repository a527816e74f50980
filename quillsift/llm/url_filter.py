"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A canonical URL is host and path prefix. Each url asks for every suffix of its host with each prefix of its path that
has the length of a listed path. Every key sets and asks BITS bits within one 64-bit word that its hash names, so a key
is one look-up. The filter is a table of (block, word), made by an aggregation with bit_or; it is broadcast, its number
of blocks being a parameter's bound. What passes is joined exactly with the list, which removes false positives; the
longest rule wins.

Definitions: null url, or one without ://, has empty host and path and meets no rule. A rule fits its host and all
subdomains if the path starts with the rule's. Equal rules that both allow and block: block wins. An url without a rule
gets the verdict `default`. Each row gets its row with its other columns, but for columns named host, path, rule or verdict, which are replaced. An
empty table or list is fine. Of rules that fit equally long, the last by code point wins. Very long urls ask for one key
per label of the host and listed path length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import sized, table

#: The listed rules as verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BITS, KEYS_PER_BLOCK, MOST_BLOCKS = 6, 4, 1 << 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a key and its bits there."""
    mask = F.lit(0).cast("long")
    second = F.xxhash64(key, F.lit("bits"))
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(second, 10 * k), F.lit(64)).cast("int")))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), mask


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; rules: (verdict, rule_host, rule_path)."""
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL").select(F.concat("rule_host", "rule_path").alias("rule"), F.struct("rule_host", "rule_path").alias("_key"), "verdict")
    rules = rules.groupBy("_key", "rule").agg(F.max("verdict").alias("verdict"))  # block > allow
    lengths = [r[0] for r in rules.select(F.length("_key.rule_path")).distinct().collect()]  # no more than an url is long
    blocks = max(1, min(MOST_BLOCKS, -(-rules.count() // KEYS_PER_BLOCK)))
    block, mask = _place(F.to_json("_key"), blocks)
    bloom = F.broadcast(rules.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word")))

    urls = pages.groupBy(F.col(url_col).alias("_url")).agg(F.count("*").alias("_n"))  # equal urls are judged once
    host, path = parts(F.col("_url"))
    urls = urls.select("_url", host.alias("_host"), path.alias("_path"))
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    asked = urls.where("_host <> '' OR _path <> ''").select("_url", F.explode(suffixes).alias("rule_host"), prefixes.alias("p")).select("_url", "rule_host", F.explode("p").alias("rule_path"))
    asked = asked.select("_url", F.struct("rule_host", "rule_path").alias("_key"))
    block, mask = _place(F.to_json("_key"), blocks)
    possible = asked.withColumns({"block": block, "mask": mask}).join(bloom, "block").where(F.col("mask").bitwiseAND(F.col("word")) == F.col("mask"))
    exact = possible.select("_url", "_key").join(sized(rules), "_key")
    best = exact.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("_best")).withColumnRenamed("_url", "_u")
    whole = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("page"))  # so that no column's name can clash
    judged = whole.join(best, F.col("page").getField(url_col).eqNullSafe(best["_u"]), "left")
    host, path = parts(F.col("page").getField(url_col))
    own = [F.col("page").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(*own, host.alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, rule_host string, rule_path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN j USING (page_id)
"""
