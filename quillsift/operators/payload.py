"""Assessments as stored: scalar columns beside a payload of type VARIANT, and their way back into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import let

CITATION = "struct<start:bigint,end:bigint,quote:string>"
REQUIREMENT = f"struct<requirement:string,verdict:string,points:double,citations:array<{CITATION}>>"
#: Fields of a payload, each with its type; a payload without one of them is damaged.
FIELDS = {"band": "string", "score": "double", "requirements": f"array<{REQUIREMENT}>"}


def persisted(assessments: DataFrame, *keys: str) -> DataFrame:
    """keys, score and payload: the columns of FIELDS as one variant."""
    return assessments.select(*keys, "score", F.to_variant_object(F.struct(*FIELDS)).alias("payload"))


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """rows with payload from a column of JSON text; null where that is none."""
    return rows.withColumn("payload", F.try_parse_json(json))


def restored(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(keys, FIELDS...) of the payloads that are whole, and (keys, reason) of the others."""
    def looked_up(payload: Column) -> Column:
        fields = [F.try_variant_get(payload, f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()]
        there = [F.try_variant_get(payload, f"$.{name}", "variant").isNotNull().alias(f"_has_{name}") for name in FIELDS]
        return F.struct(payload.isNotNull().alias("_is_json"), *fields, *there)

    # As a row of its own: a condition on its columns isn't pushed below, where the payload would be parsed again for each of them.
    typed = rows.select(*keys, F.inline(F.array(let(F.col("payload"), looked_up))))
    lost = F.when(~F.col("_is_json"), "not JSON")
    for name in FIELDS:
        lost = lost.when(~F.col(f"_has_{name}"), f"no {name}").when(F.col(name).isNull(), f"{name} of another type")
    judged = typed.withColumn("reason", lost)
    return judged.where("reason IS NULL").select(*keys, *FIELDS), judged.where("reason IS NOT NULL").select(*keys, "reason")
