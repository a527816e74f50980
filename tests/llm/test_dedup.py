"""Exact and near dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsift.llm import exact_dedup, near_dedup
from quillsift.llm.common import components, flagged
from tests.oracle import SF, compare

SCHEMA = "doc_id long, text string, id string, hash int, key int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "i", 1, 2, None) for i, t in rows], SCHEMA)


def texts(n=400):
    return duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()


def test_directory():
    counts = {0b0000: 5, 0b0001: 5, 0b0010: 4, 0b1000: 30}
    slots = exact_dedup.directory(counts, 10, 4)
    assert len(slots) == 16 and all(d <= 4 for _, d in slots)
    sums = defaultdict(int)
    for k, n in counts.items():
        sums[slots[k][0]] += n
    assert all(v <= 10 or slots[8][0] == b for b, v in sums.items())
    for b in {b for b, _ in slots}:  # a bucket is one range of 2**(4 - depth) slots
        own = [i for i, s in enumerate(slots) if s[0] == b]
        assert len(own) == 1 << 4 - slots[own[0]][1] and own == list(range(own[0], own[-1] + 1))
    assert exact_dedup.directory({}, 10, 4) == [(0, 0)] and len(exact_dedup.directory({3: 11}, 10, 0)) == 1


EXACT = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "ab"), (5, "a\x0bb\x0c "), (6, "A b"), (7, "a b"), (None, "ab"), (8, "é😀"), (9, "😀é"), (10, "é 😀"), (4, "ab"), (11, "x" * 200_000), (12, "x " * 200_000), (13, "ab "), (14, "solo"), (14, "solo")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: hashlib.sha256(b).digest()[:1] + bytes(31)], ids=["sha256", "one byte"])
def test_exact(spark, digest):
    rows = EXACT + [(100 + i, t) for i, t in texts(60)] + [(300 + i, t) for i, t in texts(20)]
    got = exact_dedup.groups(frame(spark, rows), digest=digest, capacity=20).collect()
    by = defaultdict(list)
    for i, t in rows:
        by["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for t, members in by.items():
        best = min(members)
        for k, m in enumerate(sorted(members)):
            want.append((m[3], -m[0], best[3], len(members), k == 0))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.id, r.size, r.keep_id, r.group_size, r.kept) for r in got], key=key) == sorted(want, key=key)


def test_exact_keep(spark):
    rows = EXACT + [(100 + i, t) for i, t in texts(30)] + [(300 + i, t) for i, t in texts(30)]
    kept = exact_dedup.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "id", "hash", "key", "size"]
    found = exact_dedup.groups(frame(spark, rows)).where("kept").select("id").collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in found)


def test_exact_sql(spark):
    assert compare(spark, exact_dedup.query, exact_dedup.ORACLE) == ""


def test_exact_empty(spark):
    assert exact_dedup.groups(frame(spark, []).limit(0)).count() == 0 and exact_dedup.keep_one(frame(spark, []).limit(0)).count() == 0


def weighted(text):
    """Five-word shingles and their weights, in words of letters, digits and characters beyond ASCII."""
    words = re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    counts = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
    return {k: 1.0 if len({*counts.values()}) < 2 else 1 + math.log(n) for k, n in counts.items()}


def probability(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def brute(rows):
    sets = {i: weighted(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(set)
    for i, s in sets.items():
        for x in s or {()}:
            where[x].add(i)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        both = len(x.keys() & y.keys())
        plain = len({*x.values()}) < 2 and len({*y.values()}) < 2
        if both >= 0.8 * len(x.keys() | y.keys()) or not plain and sum(min(x[i] / sum(x.values()), y[i] / sum(y.values())) for i in x.keys() & y.keys()) > 0.6 and probability(x, y) >= 0.8 - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited(text, rng, share):
    return " ".join("zz%d" % rng.randrange(10**6) if rng.random() < share else w for w in text.split(" "))


def test_near(spark):
    rng = random.Random(5)
    base = texts(120)
    rows = list(base) + [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, "w " * 50_000), (1005, "w " * 49_000), (None, base[0][1]), (base[3][0], base[3][1])]
    for k in range(5):
        for j, share in enumerate((0, 0.005, 0.01, 0.02, 0.03, 0.05)):
            rows.append((2000 + 10 * k + j, edited(base[k * 3 + 1][1], rng, share)))
    hub = base[7][1] * 2
    rows += [(3000 + j, edited(hub, rng, 0.015)) for j in range(60)]  # a chain of near copies, many pairs below 0.8
    got = near_dedup.classes(frame(spark, rows)).collect()
    want = brute(rows)
    assert {r.id: r.class_id for r in got if r.id is not None} == want and len(got) == len(rows)
    assert all(r.class_id is None for r in got if r.id is None)
    kept = near_dedup.keep_one(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {None} | set(want.values()) and kept.columns[:2] == ["doc_id", "text"]


def bands(rows):
    """Text id -> (digest, bands), as the map tasks make them."""
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["id", "text"])
    return {r["id"]: (r["digest"], set(r["bands"])) for out in near_dedup._sign(iter([batch])) for r in out.to_pylist()}


def repeated(k, times):
    """Two texts that share 80 of 100 shingles; a passage of ten words of the second occurs `times` times."""
    run = lambda name, n: " ".join(f"{name}{k}x{j}" for j in range(n))
    return run("s", 84) + " " + run("a", 6), run("s", 84) + (" " + run("b", 10)) * times


@pytest.mark.parametrize("times", [20, 100])
def test_repetition_on_one_side_loses_no_candidates(times):
    rows, words = [], near_dedup.Words()
    for k in range(400):
        rows += [*zip((2 * k, 2 * k + 1), repeated(k, times), strict=True)]
    for k in range(3):
        one, two = (set(near_dedup.shingles(t, words)[0].tolist()) for _, t in rows[2 * k : 2 * k + 2])
        assert (len(one & two), len(one | two)) == (80, 100)
    found = bands(rows)
    assert all(found[2 * k][1] & found[2 * k + 1][1] for k in range(400))


def heavy(k, times):
    """Two texts whose sets are unlike, and that are alike by weight: both repeat one passage, beside words of their own."""
    run = lambda name, n: " ".join(f"{name}{k}x{j}" for j in range(n))
    return [run("s", 40) + (" " + run("b", 40)) * times + " " + run(own, 16) for own in "pq"]


@pytest.mark.parametrize("times", [20, 100])
def test_weight_finds_what_sets_do_not(spark, times):
    rows = [(2 * k + j, t) for k in range(300) for j, t in enumerate(heavy(k, times))]
    x, y = map(weighted, heavy(0, times))
    assert len(x.keys() & y.keys()) < 0.8 * len(x.keys() | y.keys()) and probability(x, y) >= 0.8
    found = bands(rows)
    assert sum(bool(found[2 * k][1] & found[2 * k + 1][1]) for k in range(300)) >= 299
    got = {r.id: r.class_id for r in near_dedup.classes(frame(spark, rows[:40])).collect()}
    assert got == brute(rows[:40]) == {i: i // 2 * 2 for i in range(40)}


def test_probability_jaccard():
    for seed in range(40):
        r = random.Random(seed)
        x, y = ({r.randrange(40): r.randint(1, 9) for _ in range(r.randint(1, 30))} for _ in "ab")
        arrays = [(np.array(sorted(v), np.uint64), np.array([v[i] for i in sorted(v)])) for v in (x, y)]
        assert abs(near_dedup.probability_jaccard(*arrays[0], *arrays[1]) - probability(x, y)) < 1e-9


def test_same_weights_are_one_representative():
    text = " ".join(f"w{j}" for j in range(9))
    found = bands([(1, text), (2, text.upper() + " "), (3, (text + " ") * 3), (4, text + ", " + text + " " + text)])
    assert found[1] == found[2] and found[3] == found[4] and found[3][0] != found[1][0]


def test_near_with_repeated_blocks(spark):
    rows = [(10 * times + k, t) for times in (20, 100) for k, t in enumerate(repeated(times, times))]
    got = {r.id: r.class_id for r in near_dedup.classes(frame(spark, rows)).collect()}
    assert got == brute(rows) == {200: 200, 201: 200, 1000: 1000, 1001: 1000}


def test_near_empty(spark):
    assert near_dedup.classes(frame(spark, []).limit(0)).count() == 0
    assert [(r.id, r.class_id, r.class_size) for r in near_dedup.classes(frame(spark, [(1, None), (2, " "), (3, "a")])).orderBy("id").collect()] == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 60).astype(np.uint64)
    b = np.concatenate([a[:240], b])
    wa, wb = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    x, y = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    agree = []
    for k in range(40):
        s = near_dedup.signatures(near_dedup.mix(np.concatenate([a, b]) + np.uint64(k)), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - exact) < 0.02


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 6), (None, 3)]
    got = {r.id: r.class_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 160)}


def test_flagged_misses_no_key(spark):
    keys, rows = spark.range(5000).selectExpr("id * 7919 AS k"), spark.range(-20_000, 0).selectExpr("xxhash64(id) AS q", "'x' AS _block", "1 AS `_words.a`")
    got = flagged(rows.unionByName(keys.selectExpr("k AS q", "null AS _block", "2 AS `_words.a`")), F.col("q"), keys, "hit")
    assert got.columns == [*rows.columns, "hit"] and got.where("`_words.a` = 2 AND NOT hit").count() == 0
    assert got.where("`_words.a` = 1 AND hit").count() < 400 and got.where("`_words.a` = 1").count() == 20_000
    assert flagged(keys, F.col("k"), keys.limit(0), "hit").where("hit").count() == 0
    full = flagged(rows.selectExpr("q").unionByName(keys.selectExpr("k AS q")), F.col("q"), keys, "hit", most_blocks=1)  # a filter too small flags others, loses none
    assert full.join(keys, F.col("q") == F.col("k")).where("NOT hit").count() == 0


@pytest.mark.parametrize("module", [exact_dedup, near_dedup])
def test_kept_rows_beyond_a_broadcast(spark, module, monkeypatch):
    base = texts(80)
    rows = base + [(1000 + i, t) for i, t in base[:30]] + [(2000, None), (2001, ""), (None, "ab"), (2002, base[0][1])]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], "doc_id long, text string, _hash int, __size int, _flag int, _gone int, _gone_id int, `a.b` int")
    few = module.keep_one(docs)
    monkeypatch.setattr(module, "MOST_GONE", 0)
    many = module.keep_one(docs)
    assert few.columns == many.columns == docs.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(few) == order(many) and len(order(few)) < len(rows)
