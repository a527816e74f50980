"""Queries that no SQL can check, against plain Python on small inputs."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import quillsift.operators.pii as pii
from quillsift.functions import text
from quillsift.operators import embed, locate, metrics, retrieve, screen, spans
from quillsift.plans import catalog
from quillsift.plans.resumes import REQUIREMENTS, resumes
from quillsift.plans.screening import rubric
from tests.oracle import SF

Q = catalog.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain(pattern):
    flags = re.match(r"\(\?(i?)U\)", pattern)
    return re.compile(pattern[flags.end() :], re.I if flags[1] else 0)


def spans_of(t):
    """Personal data by the rules, the categories in their order."""
    out = []
    for category, pattern in (("email", pii.EMAIL), ("url", pii.URL), ("institution", pii.INSTITUTION), ("location", pii.CITY), ("gender_term", pii.GENDER), ("phone", pii.PHONE)):
        for m in plain(pattern).finditer(t):
            bare = m[0].strip(" \t\n\x0b\f\r")
            digits = len(re.sub(r"\D", "", m[0]))
            if bare and (category != "phone" or 7 <= digits <= 15 and not re.fullmatch(pii.YEARS, m[0])):
                start = m.start() + m[0].index(bare)
                out.append((start, start + len(bare), category))
    at = 0
    for line in t[:400].split("\n"):
        s = line.strip(" \t\n\x0b\f\r")
        parts = re.split(r"[ \t\n\x0b\f\r]+", s)
        shaped = all(re.fullmatch(r"[A-Za-z][A-Za-z'.\-]*", w) and w.lower() not in pii.NOT_NAMES for w in parts)
        if s and 2 <= len(parts) <= 4 and len(s) <= 45 and shaped and (s.upper() == s or all(re.match("[A-Z]", w) for w in parts)):
            out.append((at + line.index(s), at + line.index(s) + len(s), "name"))
            break
        at += len(line) + 1
    kept = []
    for _, start, _, end, category in sorted((start - end, start, i, end, c) for i, (start, end, c) in enumerate(out)):
        if not any(a < end and start < b for a, b, _ in kept):
            kept.append((start, end, category))
    return sorted(kept)


def test_personal_data(spark, texts):
    odd = ["JANE DOE\nwrite jane.doe@x.org, +44 20 7946 0958 or www.x.org/a?b in Paris, LONDON; he/she 2019 - 2021 at University of Örebro Nord", "", "é@ü.de  IIT Delhi MIT Sloan (020) 1234 5678 \n Ms. ſhe ſydney", "a@b.c " * 400 + "Mumbai " * 400]
    rows = [*texts.items(), *((-1 - k, t) for k, t in enumerate(odd))]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = 0
    for r in got:
        t = dict(rows)[r.document_id]
        want = spans_of(t)
        assert [(s.start, s.end, s.category) for s in r.spans] == want, r.document_id
        assert len(r.redacted_text) == len(t)
        hidden = {i for a, b, c in want if c in pii.MASKED for i in range(a, b)}
        assert all(r.redacted_text[i] == x for i, x in enumerate(t) if i not in hidden)
        for a, b, c in want:
            if c in pii.MASKED:
                label = f"[{c.upper()}]"
                assert r.redacted_text[a:b] == (label.ljust(b - a, "#") if len(label) <= b - a else "#" * (b - a))
        found += len(want)
    assert found > 500


def loose(text, quote):
    words = quote.split()
    m = re.search(r"\s+".join(map(re.escape, words)), text, re.I) if words else None
    return m and m.start()


def test_locate_normalised(spark, texts):
    got = Q["locate_normalised"](spark, SF).collect()
    lines = {(i, n): line.strip(" \t\n\x0b\f\r") for i, t in texts.items() for n, line in enumerate(t.split("\n"))}
    assert {(r.document_id, r.quote_id) for r in got} == {k for k, v in lines.items() if re.search(r"[^ \t\n\x0b\f\r]", v)}
    for r in got:
        assert r.start == loose(texts[r.document_id], lines[r.document_id, r.quote_id].upper().replace(" ", "  "))


def test_locate_cascade(spark, texts):
    """Exact where the quote is as it stands, else but for blanks and case, else by shared words or not at all."""
    for r in Q["locate_cascade"](spark, SF).collect():
        t = texts[r.document_id]
        line = t.split("\n")[r.quote_id].strip(" \t\n\x0b\f\r")
        if len(line) < locate.LEAST_LENGTH:
            continue
        quote = line if r.quote_id % 2 == 0 else line.upper().replace(" ", "  ")
        at = t.find(quote)
        if at >= 0:
            assert (r.start, r.end, r.score, r.strategy) == (at, at + len(quote), 1.0, "exact")
        elif (place := loose(t, quote)) is not None:
            assert (r.start, r.score, r.strategy) == (place, 0.95, "normalised")
        else:
            assert r.strategy in (None, "fuzzy")


def vector_of(text):
    out = [0.0] * embed.DIMENSIONS
    for token in re.findall("[a-z0-9+#.]+", (text or "").lower()):
        edged = f"^{token}$"
        grams = [("c:" + edged[i : i + 4], 0.35) for i in range(len(edged) - 3)] if len(token) > 4 else []
        for name, weight in [("w:" + token, 1.0), *grams]:
            h = hashlib.blake2b(name.encode(), digest_size=8).digest()
            out[int.from_bytes(h[:4], "big") % embed.DIMENSIONS] += weight if h[4] & 1 else -weight
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def test_hashing_embed(spark, texts):
    got = {r.id: r.embedding for r in Q["hashing_embed"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[:60]:
        assert np.allclose(got[i], vector_of(texts[i]), atol=1e-9)


def test_rrf_fusion(spark, texts):
    """Ranks by vectors against all documents, then reciprocal ranks with those by BM25."""
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    names = sorted(texts)
    matrix = np.array([embed.vector(texts[i]) for i in names])
    lexical = {(r.query, r.unit): r["rank"] for r in Q["bm25_topk"](spark, SF).collect()}
    got = {}
    for r in Q["rrf_fusion"](spark, SF).collect():
        got.setdefault(r.query, []).append(r)
    for q, t in asked.items():
        v = embed.vector(t)
        scores = np.round(matrix @ v, 6)
        near = [names[k] for k in np.lexsort((names, -scores))[:20] if scores[k] > 0]
        for r in got.get(q, []):
            assert r.dense_rank == (near.index(r.unit) + 1 if r.unit in near else None)
            assert (q, r.unit) not in lexical or lexical[q, r.unit] == r.bm25_rank
            assert abs(r.score - sum(1 / (60 + x) for x in (r.bm25_rank, r.dense_rank) if x)) < 1e-6
        order = [(-r.score, r.bm25_rank or 1e9, r.dense_rank or 1e9, r.unit) for r in sorted(got.get(q, []), key=lambda r: r.place)]
        assert order == sorted(order)


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, float(x), float(x + rng.normal(0, 30) > 50)) for i, x in enumerate(rng.integers(0, 100, 80))] + [("b", 1, 1.0, 2.0), ("c", 1, 1.0, 2.0), ("c", 2, 1.0, 3.0), ("c", 3, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "job string, item long, score double, human double")
    got = {r.job: r for r in metrics.bootstrap(df, "job", 300).collect()}
    assert got == {r.job: r for r in metrics.bootstrap(df.repartition(3), "job", 300).collect()}
    assert (got["b"].low, got["b"].high, got["b"].n) == (-1.0, 1.0, 1) and (got["c"].low, got["c"].high) == (-1.0, 1.0)
    draws = df.where("job = 'a'").select("score", "human", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("replicate"), "item").withColumn("u", (F.xxhash64("item", "replicate", F.lit(metrics.SEED)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / 2.0**52).collect()
    by = {}
    for r in draws:
        by.setdefault(r.replicate, []).extend([(r.score, r.human)] * sum(r.u >= p for p in metrics.POISSON))

    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    rho = sorted(float(np.corrcoef(ranks([p[0] for p in v]), ranks([p[1] for p in v]))[0, 1]) for v in by.values())
    assert abs(got["a"].low - rho[int(0.025 * 300)]) < 1e-6 and abs(got["a"].high - rho[int(0.975 * 300)]) < 1e-6
    assert got["a"].low < got["a"].value < got["a"].high


def tokens_of(t):
    return [w for w in re.findall("[a-z0-9+#.]+", t.lower()) if len(w) > 1 and w not in text.STOPWORDS]


def searched(units, query, k=4, pool=20):
    """Places of a document's units (n, text) for a query: BM25 and hashed vectors, each within the document, fused."""
    docs = {n: tokens_of(t) for n, t in units}
    mean = sum(map(len, docs.values())) / len(docs)
    lexical = {}
    for n, own in docs.items():
        score = 0.0
        for w in tokens_of(query):
            if w in own:
                df, tf = sum(w in x for x in docs.values()), own.count(w)
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
        lexical[n] = round(score, 6)
    v = np.array(vector_of(query))
    dense = {n: round(float(np.dot(vector_of(t), v)), 6) for n, t in units}
    ranks = [{n: r for r, (n, _) in enumerate(sorted(((n, x) for n, x in scores.items() if x > 0), key=lambda x: (-x[1], x[0]))[:pool], 1)} for scores in (lexical, dense)]
    both = sorted(ranks[0].keys() | ranks[1].keys(), key=lambda n: (-sum(1 / (60 + r[n]) for r in ranks if n in r), ranks[0].get(n, 1e9), ranks[1].get(n, 1e9), n))
    return both[:k]


def test_search_within_each_document(spark):
    units = Q["evidence_units"](spark, SF).withColumn("n", F.regexp_extract("unit_id", "([0-9]+)$", 1).cast("int")).select(F.col("document_id").alias("corpus"), F.col("n").alias("unit"), "text").where("corpus % 9 = 1")
    asked = [(i, t) for i, t, _ in REQUIREMENTS]
    got = {}
    for r in retrieve.search(units, spark.createDataFrame(asked, "query string, text string"), 4).orderBy("place").collect():
        got.setdefault((r.corpus, r.query), []).append(r.unit)
    by = {}
    for r in units.collect():
        by.setdefault(r.corpus, []).append((r.unit, r.text))
    want = {(c, q): found for c, own in by.items() for q, t in asked if (found := searched(own, t))}
    assert len(want) > 20 and got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)  # sums of floats may differ in the last place of a score


def test_blind_screening_hides_names_and_keeps_scores(spark):
    docs = resumes(spark, SF).where("document_id % 5 = 1").cache()
    one, two = (screen.screen_batch(docs, rubric(spark), blind=b, second=retrieve.keyword_overlap)[0].collect() for b in (False, True))
    seen, blind = {r.document_id: r for r in one}, {r.document_id: r for r in two}
    assert seen.keys() == blind.keys() and sorted(r["rank"] for r in two) == [*range(1, len(two) + 1)]
    assert sum(r.score == seen[i].score for i, r in blind.items()) >= 0.8 * len(blind)  # masks have words of their own, so lengths and ranks differ a little
    whole = {r.document_id: r for r in Q["screen_blind"](spark, SF).collect()}
    assert whole.keys() >= blind.keys() and sorted(r["rank"] for r in whole.values()) == [*range(1, len(whole) + 1)]
    mails = pii.redact(docs, "document_id").where("exists(spans, s -> s.category = 'email')")
    assert mails.count() == docs.count() and mails.where("redacted_text LIKE '%@%'").count() == 0


def test_a_broken_document_stops_no_other(spark):
    good = resumes(spark, SF).limit(3)
    bad = spark.createDataFrame([(-1, None, None), (-2, " \n", None), (-3, "x", "unreadable"), (-4, "word " * 400_001, None), (-5, "nothing to see", None)], "document_id long, text string, error string")
    found, left = screen.screen_batch(good.withColumn("error", F.lit(None).cast("string")).unionByName(bad), rubric(spark), blind=False)
    assert {r.document_id: r.reason for r in left.collect()} == {-1: "no text", -2: "no text", -3: "unreadable", -4: "too long", -5: "no evidence"}
    assert found.count() == 3


def test_dense_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)] + [(400, [0.0] * 8), (401, [1.0] * 4), (402, [2.0] * 4)]
    df = retrieve.unit_vectors(spark.createDataFrame(vectors, "unit long, embedding array<double>")).select("unit", "v")
    asked = df.where("unit % 10 = 1").withColumnRenamed("unit", "query")
    got = {}
    for r in retrieve.dense(df.repartition(5), asked, 7, block=4, chunk=16, spread=3).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((r.unit, r.score))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if any(v)}
    for q in [i for i in unit if i % 10 == 1]:
        scores = sorted(((i, round(float(unit[q] @ u), 6) + 0.0) for i, u in unit.items() if len(u) == len(unit[q])), key=lambda x: (-x[1], x[0]))[:7]
        assert [x[1] for x in got[q]] == [x[1] for x in scores] and len({x[0] for x in got[q]}) == len(scores)


@pytest.mark.parametrize("slice_rows", [50_000, 40])
def test_pair_counts(spark, slice_rows):
    r = np.random.default_rng(1)
    rows = [("a", *map(float, p)) for p in r.normal(0, 1, (300, 2))] + [("b", float(x), float(y)) for x, y in zip(r.integers(0, 4, 200), r.integers(0, 90, 200), strict=True)] + [("c", 1.0, 2.0)] + [("d", 1.0, float(x)) for x in range(20)]
    got = {x.job: tuple(x)[1:] for x in metrics.pair_counts(spark.createDataFrame(rows, "job string, score double, human double"), "job", slice_rows=slice_rows).collect()}
    for job in "abcd":
        own = [p[1:] for p in rows if p[0] == job]
        counts = [0] * 5
        for i, p in enumerate(own):
            for q in own[:i]:
                x, y = p[0] - q[0], p[1] - q[1]
                counts[4 if x == y == 0 else 3 if x == 0 else 2 if y == 0 else 0 if x * y > 0 else 1] += 1
        assert got[job] == (*counts, len(own))


@pytest.mark.parametrize("statistic", ["pearson", "mae", "top_k"])
def test_bootstrap_of_other_statistics(spark, statistic):
    rng = np.random.default_rng(2)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.permutation(40), rng.permutation(40), strict=True))] + [("b", 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "job string, item long, score double, human double")
    got = {r.job: r for r in metrics.bootstrap(df, "job", 200, statistic=statistic).collect()}
    draws = df.where("job = 'a'").select("item", "score", "human", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("replicate")).withColumn("u", (F.xxhash64("item", "replicate", F.lit(metrics.SEED)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / 2.0**52).collect()
    by = {}
    for r in draws:
        by.setdefault(r.replicate, []).extend([(r.item, r.score, r.human)] * sum(r.u >= p for p in metrics.POISSON))

    def value(own):
        x, y = (np.array([p[k] for p in own]) for k in (1, 2))
        if statistic == "pearson":
            return float(np.corrcoef(x, y)[0, 1])
        if statistic == "mae":
            return float(np.abs(x - y).mean())
        ours, theirs = sorted(own, key=lambda p: (-p[1], p[0]))[:3], sorted(own, key=lambda p: (-p[2], p[0]))[:3]
        return sum(p[2] >= theirs[-1][2] for p in ours) / 3

    found = sorted(value(v) for v in by.values())
    assert abs(got["a"].low - found[5]) < 1e-6 and abs(got["a"].high - found[195]) < 1e-6 and abs(got["a"].value - value([r[1:] for r in rows if r[0] == "a"])) < 1e-6
    assert (got["b"].low, got["b"].high) == metrics.STATISTICS[statistic][1:]


def test_chance_ceiling(spark):
    rows = [("a", i, float(i % 5)) for i in range(60)] + [("b", i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "job string, item long, human double")
    got = {r.job: r.ceiling for r in metrics.chance_ceiling(df, 40, 7, "job").collect()}
    scores = {(r.job, r.trial): [] for r in df.select("job", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("trial")).distinct().collect()}
    for r in df.select("job", "item", "human", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("trial")).withColumn("s", F.xxhash64("item", "trial", F.lit(7)).cast("double")).collect():
        scores[r.job, r.trial].append((r.s, r.human))
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    for job in "ab":
        rho = sorted(round(float(np.corrcoef(rank([p[0] for p in v]), rank([p[1] for p in v]))[0, 1]), 6) for (j, _), v in scores.items() if j == job)
        assert abs(got[job] - rho[int(39 * 0.95)]) < 2e-6


def test_redacted_resumes_and_coverage(spark):
    docs = {r.document_id: r.text for r in resumes(spark, SF).collect()}
    want = {}
    for i, t in docs.items():
        for _, _, category in spans_of(t):
            want[i, category] = want.get((i, category), 0) + 1
    assert {(r.document_id, r.category): r.n for r in Q["redact_resumes"](spark, SF).collect()} == want
    got = {r.document_id: (r.covered, r.coverage) for r in Q["unit_coverage"](spark, SF).collect()}
    for i, t in docs.items():
        start = min(t.index(f"\n{h}\n") + 1 for h in ("EXPERIENCE", "PROJECTS", "EDUCATION", "SKILLS") if f"\n{h}\n" in t)
        assert abs(got[i][0] - (len(t) - start)) <= 1 and abs(got[i][1] - got[i][0] / len(t)) < 1e-6


@pytest.mark.parametrize("unit", ["word ", "a/", "a-", "a.", "a b ", "7", "A1_", "x", "a@", "www."])
def test_lines_of_a_million_characters(spark, unit):
    """No text ends the JVM or takes time that grows with its square."""
    from time import time

    t = unit * (1_000_000 // len(unit))
    docs = spark.createDataFrame([(1, t + "\nme@x.org University"), (2, "plain")], "document_id long, text string")
    began = time()
    found = locate.located(spark.createDataFrame([(1, 1, t.strip()), (1, 2, t.strip().upper().replace(" ", "  ")), (2, 3, "PLAIN")], "document_id long, quote_id int, quote string"), docs).collect()
    assert {r.quote_id: r.start for r in found} == {1: 0, 2: 0, 3: 0}
    checked = spans.verify(spark.createDataFrame([(1, 0, len(t), t)], "document_id long, start int, end int, quote string"), docs).first()
    assert checked.valid
    mails = docs.select(F.size(pii.emails(F.col("text"))).alias("m"), F.size(pii.urls(F.col("text"))).alias("u")).collect()
    assert mails[0].m >= 1 and time() - began < 60
