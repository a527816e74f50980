"""Secret scan, in DataFrame functions only: key patterns, and sliding-window entropy over candidate strings.

Pattern spans: assignments, access keys and long hex strings, leftmost and without overlap for each kind; a match that
is too short is dropped after it was matched. Offsets are code points, from the lengths of the gaps and matches.

Entropy spans: pattern spans (assignments, then access keys, then hex strings) and UUIDs are blanked out, character by
character, so a secret beside one in the same run is still seen. Candidates are the runs of key characters that are left.
A window of WINDOW characters slides over each; the counts of its characters (one byte each) and the sum of c*log2(c) are
updated by the character that enters and the one that leaves. Windows whose Shannon entropy reaches the threshold of the
candidate's character class (BITS) make the spans: windows that overlap or touch are one. The allow-list suppresses a
candidate only if it matches the whole of it: words and short numbers joined by marks (paths, slugs, dates, versions),
and keys of documentation. Pattern spans are never suppressed.

Null text is empty and has no spans. Spans that start together are ordered by kind. Repeated rows each get their row;
only the id and text columns are read, under names of their own; an empty table gives an empty result. Matches of a row
are laid out as rows for the offsets, so long texts cost in proportion; a single candidate run of 10 000 and 20 000 characters took
1.5 and 6 s when measured, which is more than in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import table

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Least lengths: of an assignment's value, and of the other matches.
LEAST = {"assign": 8, "access": 16, "hex": 32}
WINDOW = 20
#: Least bits per character by class of the whole candidate, the first that fits; 4.32 is the most that a window of 20 can have.
BITS = [("[0-9]+", 3.2), ("[0-9a-f]+|[0-9A-F]+", 3.0), ("[a-z]+|[A-Z]+", 3.7), ("[A-Za-z]+", 4.0), (".*", 3.8)]
UUID = "(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"
#: Whole candidates that are no secrets: words and numbers joined by marks, and keys of documentation.
JOINED, WORD = "[/_+-]+", "[A-Z]?[a-z]{1,15}|[A-Z]{1,15}|[vV]?[0-9]{1,8}"
DOCUMENTED = "[A-Za-z0-9+/]{1,33}EXAMPLE(KEY)?"


def allowed(candidate: Column) -> Column:
    """Tested word by word: a pattern that repeats a group would recurse once per word."""
    words = F.split(candidate, JOINED, -1)  # marks may stand at the end, not at the beginning
    named = F.forall(words, lambda w: w.rlike(f"^({WORD})$") | (w == "")) & (F.get(words, F.lit(0)) != "")
    return named | candidate.rlike(f"^({DOCUMENTED})$")


def _matches(text: Column, kind: int, pattern: str, found_at: Column, ok) -> Column:
    """Array of (kind, number, gap before, length, valid, candidate) of one kind; the text is split only where it has a match."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else found
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), values.alias("v")),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("length"), ok(z["v"]).alias("valid"), F.when(F.lit(kind == 3), z["m"]).alias("candidate")),
    )
    return F.when(found_at, rows)


def _blanked(text: Column, kind: int, pattern: str, found_at: Column, least: int) -> Column:
    """text with blanks in place of the matches whose value has `least` characters."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else found
    hidden = F.zip_with(found, values, lambda m, v: F.when(F.length(v) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    return F.when(found_at, F.array_join(F.flatten(F.zip_with(gaps, hidden, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")).otherwise(text)


def _stretches(s: Column, least: Column) -> Column:
    """(start, end) in s of the runs of windows of WINDOW characters whose entropy is at least `least`."""
    return _let(F.transform(F.split(s, ""), F.ascii), lambda codes: _over(codes, F.length(s), least))


def _over(codes: Column, size: Column, least: Column) -> Column:
    """_stretches of character codes, each of which is met twice: as it enters the window and as it leaves."""
    counts = lambda state, c: F.ascii(F.substring(state["counts"], c + 1, F.lit(1)).cast("string"))
    code = lambda i: F.get(codes, i - 1)
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))

    def changed(state: Column, c: Column, by: int) -> Column:
        """The state after one character more or less of code c."""
        return _let(counts(state, c), lambda now: F.struct(
            F.overlay(state["counts"], byte(now + by), c + 1, F.lit(1)).alias("counts"), (state["total"] + term(now + by) - term(now)).alias("total"),
            state["start"].alias("start"), state["end"].alias("end"), state["done"].alias("done"),
        ))

    def judged(state: Column, i: Column) -> Column:
        """The state with the window that ends after i characters added to its stretch, if it reaches the threshold."""
        hot = (i >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - state["total"] / WINDOW >= least - 1e-9)
        new = hot & (state["end"] < i - WINDOW)
        return F.struct(
            state["counts"].alias("counts"), state["total"].alias("total"), F.when(new, i - WINDOW).otherwise(state["start"]).alias("start"), F.when(hot, i).otherwise(state["end"]).alias("end"),
            F.when(new & (state["end"] > 0), F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))).otherwise(state["done"]).alias("done"),
        )

    def step(state: Column, i: Column) -> Column:
        # Each let() holds a state that is read several times, so that it is worked out once.
        entered = changed(state, code(i), 1)
        left = _let(entered, lambda x: F.when(i > WINDOW, changed(x, code(i - WINDOW), -1)).otherwise(x))
        return _let(left, lambda x: judged(x, i))

    kind = "struct<counts:binary,total:double,start:int,end:int,done:array<struct<start:int,end:int>>>"
    start = F.struct(F.unhex(F.lit("00" * 128)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("start"), F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("done")).cast(kind)
    last = lambda x: F.when(x["end"] > 0, F.concat(x["done"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))).otherwise(x["done"])
    return F.aggregate(F.sequence(F.lit(1), size), start, lambda state, i: step(state, i).cast(kind), last)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans as an ordered array of (start, kind number, end)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    long = lambda n: lambda v: F.length(v) >= n
    hexes = "[0-9a-f]{%d,}" % LEAST["hex"]
    patterns = [(ASSIGN, LEAST["assign"], lambda t: t.rlike(ASSIGN)), (ACCESS, LEAST["access"], lambda t: t.contains("AKIA")), (hexes, LEAST["hex"], lambda t: t.rlike("[0-9a-f]{%d}" % LEAST["hex"]))]
    run = "[A-Za-z0-9+/_-]{20}"
    texts = texts.withColumn("rest", F.when(F.col("text").rlike(run), F.col("text")))  # most texts have no candidate, so nothing to blank out
    for k, (pattern, least, met) in enumerate([*patterns, (UUID, 1, lambda t: t.rlike(UUID))]):
        texts = texts.withColumn("rest", _blanked(F.col("rest"), k, pattern, met(F.col("rest")), least))
    each = [_matches(F.col("text"), k, pattern, met(F.col("text")), long(least)) for k, (pattern, least, met) in enumerate(patterns)]
    each.append(_matches(F.col("rest"), 3, CANDIDATE, F.col("rest").rlike(run), lambda v: F.lit(True)))
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,length:int,valid:boolean,candidate:string>>")
    rows = texts.select("row", "id", F.explode_outer(F.concat(*(F.coalesce(e, none) for e in each))).alias("m")).select("row", "id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).withColumn("start", F.col("end") - F.col("length"))

    whole = lambda p: F.col("candidate").rlike(f"^({p})$")
    least = F.lit(None).cast("double")
    for p, bits in reversed(BITS):
        least = F.when(whole(p), bits).otherwise(least)
    hot = F.when(~allowed(F.col("candidate")), _stretches(F.col("candidate"), least))
    own = F.when(F.col("valid") & (F.col("kind") < 3), F.array(F.struct("start", "kind", "end")))
    more = F.transform(hot, lambda h: F.struct((F.col("start") + h["start"]).alias("start"), F.lit(3).alias("kind"), (F.col("start") + h["end"]).alias("end")))
    rows = rows.withColumn("spans", F.when(F.col("kind") < 3, own).otherwise(F.when(F.col("kind") == 3, more)))
    return rows.groupBy("row", "id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans")
    )
