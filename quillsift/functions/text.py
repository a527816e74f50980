"""Column functions over text: normalising, tokens, set similarity, match offsets, vectors. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a retrieval token must not be.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to",
    "was", "were", "will", "with", "using", "used", "able", "experience", "experienced", "strong", "good",
)
#: Numbers of an array that are added up together by running().
CHUNK = 256
#: Stands before and after each match while a text is cut up; a text that has one is cut up in another way.
MARK = "\ue0f5"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, op=lambda a, b: a + b, kind: str = "bigint") -> Column:
    """Running totals (or, by another op, maxima) of an array, the number itself included; in two levels, so the cost isn't quadratic."""
    none = F.array().cast(f"array<{kind}>")
    last = lambda a: F.get(a, F.size(a) - 1)

    def within(part: Column) -> Column:
        return F.aggregate(part, none, lambda out, x: F.concat(out, F.array(F.when(F.size(out) == 0, x.cast(kind)).otherwise(op(last(out), x).cast(kind)))))

    def joined(inner: Column) -> Column:
        return let(within(F.transform(inner, last)), lambda upto: F.flatten(F.transform(inner, lambda part, k: F.when(k == 0, part).otherwise(F.transform(part, lambda x: op(F.get(upto, k - 1), x))))))

    parts = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda k: F.slice(a, k * CHUNK + 1, CHUNK))
    return let(numbers, lambda a: F.when(F.size(a) == 0, none).otherwise(let(F.transform(parts(a), within), joined)))


def collapsed(t: Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", "")


def normalised(t: Column) -> Column:
    return F.lower(collapsed(t))


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def words(t: Column) -> Column:
    """Words of the normalised text; no words for a blank one."""
    return F.filter(F.split(normalised(t), " "), lambda w: w != "")


def plain_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(t: Column) -> Column:
    """Retrieval tokens: longer than one character and not a stop word; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9+#.]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _cut(t: Column, pattern: str) -> Column:
    """Pieces of a text: what is before a match and the match, in turn, and the rest; one pass of the pattern, and none if it has no match."""
    marked = F.split(F.regexp_replace(t, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    pairs = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m)))
    return F.when(F.contains(t, F.lit(MARK)), F.flatten(pairs)).otherwise(marked)


def matches(t: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches, in code points; the pattern has no match of no characters."""

    def spans(pieces: Column) -> Column:
        ends = running(F.transform(pieces, F.length), kind="int")
        both = F.arrays_zip(pieces.alias("text"), ends.alias("end"))
        found = F.filter(both, lambda z, k: k % 2 == 1)
        return F.transform(found, lambda z: F.struct((z["end"] - F.length(z["text"])).alias("start"), z["end"].alias("end"), z["text"].alias("text")))

    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return let(_cut(t, pattern), lambda pieces: F.when(F.size(pieces) > 1, spans(pieces)).otherwise(none))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector, a null or different dimensions."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def same_text(claimed: Column, actual: Column, least: float = 0.85) -> Column:
    """A quote stands for a passage: equal when normalised, or most words shared."""
    return (normalised(claimed) == normalised(actual)) | (jaccard(F.array_distinct(words(claimed)), F.array_distinct(words(actual))) >= least)
