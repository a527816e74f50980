"""Stored tables, report files and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    """Hash of a request's parts, kept apart by a separator; null parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cache_keys(requests: DataFrame, *columns: str) -> DataFrame:
    return requests.withColumn("key", cache_key(*map(F.col, columns)))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their stored response and whether there was one: only misses need the model."""
    known = cache.groupBy(F.col("key").alias("_k")).agg(F.first("response").alias("response"))
    return requests.join(known, F.col("key") == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace a Parquet table."""
    (df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a declared schema; a row that can't be read raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    """Append to a relational table; the driver's jar must be on the class path."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()


def delete_cascade(parents: DataFrame, gone: DataFrame, children: dict[str, DataFrame], key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the keys in gone, and children without rows of those parents."""
    return parents.join(gone, key, "left_anti"), {n: c.join(gone, key, "left_anti") for n, c in children.items()}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report table as Markdown; more rows than `most` raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
