"""Dates of roles as month numbers: year * 12 + month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESENT = 99999 * 12
# Words that mean "up to now", and months by their first three letters.
NOW_WORDS = ["present", "current", "now", "ongoing"]
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def month_index(value: Column) -> Column:
    """PRESENT for words such as "present"; mm/yyyy or mm-yyyy; a month name with a year; a year alone is June; else null."""
    t = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    month = F.regexp_extract(t, r"\b(\d{1,2})[/-](\d{4})\b", 1)
    numeric = F.when(month != "", month.cast("int"))
    year = F.regexp_extract(t, r"((19|20)\d{2})", 1)
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    found = F.transform(F.regexp_extract_all(t, F.lit("[a-z]{3,9}"), F.lit(0)), lambda w: F.element_at(names, F.substring(w, 1, 3)))
    named = F.get(F.filter(found, lambda m: m.isNotNull()), F.lit(0))
    return (
        F.when(t.rlike("|".join(NOW_WORDS)), F.lit(PRESENT))
        .when(numeric.between(1, 12), F.regexp_extract(t, r"\b(\d{1,2})[/-](\d{4})\b", 2).cast("int") * 12 + numeric)
        .when(year != "", year.cast("int") * 12 + F.coalesce(named, F.lit(6)))
    )
