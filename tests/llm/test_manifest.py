"""Suffix arrays, suffix dedup, product codes and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import merkle, product_codes, suffix_dedup
from quillsift.llm.suffixes import common_prefixes, suffix_array
from tests.oracle import SF, compare

by_text = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("alphabet", [1, 2, 3, 20, 250])
def test_suffix_array(alphabet):
    for seed in range(60):
        r = random.Random(seed)
        x = []
        for _ in range(r.randint(0, 40)):
            x += [2 + r.randrange(alphabet) for _ in range(r.randint(0, 14))] + [1]
        x += [0]
        text = np.array(x, np.uint16)
        order = suffix_array(text, 258)
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert order.tolist() == want
        prefixes = common_prefixes(text, order, 1)
        for a, b in zip(want, want[1:], strict=False):
            d = 0
            while x[a + d] == x[b + d] > 1:
                d += 1
            assert prefixes[b] == d


def without_repeats(rows, size=suffix_dedup.LENGTH):
    first = {}
    place = lambda i: suffix_dedup.LAST if i is None else i
    for i, t in rows:
        body = (t or "").encode()
        for w in range(len(body) - size + 1):
            x = body[w : w + size]
            first[x] = min(first.get(x, place(i)), place(i))
    for i, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for w in range(len(body) - size + 1):
            if first[body[w : w + size]] < place(i):
                gone[w : w + size] = b"\1" * size
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        yield i, len(body), sum(gone), runs, bytes(x for x, g in zip(body, gone, strict=True) if not g)


ODD = [(5, "q" * 55), (None, "q" * 70), (None, "z" * 55), (None, None), (999, None), (998, "a" * 3000), (1000, "a" * 55), (1001, "b" + "ab" * 300), (1002, "é" * 30), (1003, "x" + "é" * 30), (7, "short")]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup(spark, crowd):
    r = random.Random(3)
    base = [(k, "".join(r.choice("abcdé \n") for _ in range(r.randint(0, 300)))) for k in range(30)]
    rows = base + ODD + ODD[:2] + [(3, base[9][1])]
    for k in range(120):
        a, b = r.choice(base)[1], r.choice(base)[1]
        at = r.randint(0, len(a))
        rows.append((100 + k, a[at : at + r.randint(0, 120)] + b[r.randint(0, len(b)) :]))
    docs = spark.createDataFrame([(i, t, 1, "k", 0, b"") for i, t in rows], "doc_id long, text string, doc int, key string, mark int, body binary")
    got = suffix_dedup.dedup(docs, crowd=crowd).select("id", "n_bytes", "n_removed", F.size("spans"), F.col("kept").cast("binary")).collect()
    assert sorted([(*x[:4], bytes(x[4])) for x in got], key=by_text) == sorted(without_repeats(rows), key=by_text)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_query(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = [(i, n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, n, gone, runs, kept in without_repeats(rows)]
    got = suffix_dedup.query(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=by_text) == sorted(want, key=by_text) and sum(w[2] for w in want) > 10_000


def test_long_text_is_read_in_steps(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(3 * suffix_dedup.STEP))
    at = suffix_dedup.STEP - 20
    docs = spark.createDataFrame([(1, long), (2, "new " + long[at : at + 60] + " end"), (0, "old " + long[-55:])], "doc_id long, text string")
    got = {x.id: x for x in suffix_dedup.dedup(docs).collect()}
    assert bytes(got[2].kept) == b"new  end" or got[2].n_removed >= 60
    assert got[1].n_removed >= 55 and got[1].spans[-1].end == len(long) and got[0].n_removed == 0


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(5)
    for scale in (3, 1000, product_codes.LARGEST - 1):
        for width in (1, 4, 10, 16):
            x, book = r.integers(-scale, scale, (60, width)), r.integers(-scale, scale, (20, width))
            book[3], x[5] = book[2], book[2]
            far = ((x[:, None] - book[None]) ** 2).sum(2)
            code, least, measured = product_codes.nearest(x, book)
            assert (code == far.argmin(1)).all() and (least == far.min(1)).all() and measured <= far.size
    x = np.repeat(r.integers(-500, 500, (8, 1)), 16, 1) + r.integers(-3, 3, (8, 16))
    assert product_codes.nearest(x, x)[2] < 20  # most entries are ruled out unmeasured


def coded(rows, rounds=product_codes.ROUNDS):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    width = len(kept[0][1]) // 4
    parts = [np.array([k[1][p * width : (p + 1) * width] for k in kept]) for p in range(4)]
    books = [p[:256].copy() for p in parts]
    near = lambda: [((x[:, None] - b[None]) ** 2).sum(2) for x, b in zip(parts, books, strict=True)]
    for _ in range(rounds):
        for x, b, far in zip(parts, books, near(), strict=True):
            code = far.argmin(1)
            for e in set(code.tolist()):
                b[e] = x[code == e].sum(0) // (code == e).sum()
    found = near()
    sums = defaultdict(int)
    error = sum(far.min(1) for far in found)
    for k, e in zip(kept, error.tolist(), strict=True):
        sums[k[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return [(k[0], "".join(f"{far[n].argmin():02x}" for far in found), int(error[n]), sums[k[2]], digest) for n, k in enumerate(kept)]


def test_product_codes(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 1, 8).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(400)]
    rows += [(400, None, 1), (401, [1.0] * 7 + [None], 1), (402, [float("nan")] + [0.0] * 7, 2), (403, [float("-inf")] + [0.0] * 7, 2), (None, [0.5] * 8, 1), rows[3], rows[9], rows[9]]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, x int")
    codes, books = product_codes.encode(df)
    want = coded(rows)
    assert sorted([(x.id, x.code, x.error) for x in codes.collect()], key=by_text) == sorted([w[:3] for w in want], key=by_text)
    assert product_codes.said(books) == want[0][4]
    few, _ = product_codes.encode(df.limit(3))
    assert few.count() == 3 and all(x.error == 0 for x in few.collect())
    none, books = product_codes.encode(df.where("vec_id = 400"))
    assert none.count() == 0 and books is None
    far = spark.createDataFrame([(1, [1e30] * 4, 0), (2, [1.0] * 4, 0), (3, [1.0] * 8, 0)], "vec_id long, embedding array<float>, label int")
    assert [x.id for x in product_codes.encode(far)[0].collect()] == [2]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def grown(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[k : k + 3]) for k in range(0, len(last), 3)])
    return levels


def path(levels, k):
    for level in levels[:-1]:
        low = k // 3 * 3
        yield level[low:k], level[k + 1 : low + 3]
        k //= 3


def manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        i, source, lang, n, text = row
        leaf = digest(*map(said, row))
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        groups[source].append((i is not None, i or 0, leaf, digest(*map(said, (i, source, lang, n, text.replace("\n", "") if even and text else text))), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(groups[s])]) for s in names}
    top = grown([trees[s][-1][0] for s in names])
    for j, s in enumerate(names):
        for k, (_, _, leaf, changed, i) in enumerate(sorted(groups[s])):
            h, siblings = changed, []
            for left, right in [*path(trees[s], k), *path(top, j)]:
                h = digest(*left, h, *right)
                siblings += left + right
            yield i, leaf, trees[s][-1][0], top[-1][0], digest(*siblings), h, h == top[-1][0]


@pytest.mark.parametrize("sizes", [[1], [2, 1], [250, 1, 82, 3, 4, 27], [1] * 90, [81, 243, 244]])
def test_merkle(spark, tmp_path, sizes):
    r = random.Random(len(sizes))
    rows = [(r.randrange(10**6), f"src{g}" if g else None, r.choice(["en", None, "é"]), r.choice([None, 5]), r.choice([None, "", "a\nb", "é\n😀", "plain"])) for g, n in enumerate(sizes) for _ in range(n)]
    rows += [(None, "src1", "en", 1, "x\ny"), (rows[0][0], rows[0][1], "zz", 3, "again\n"), rows[-1]] if len(sizes) > 1 else []
    df = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, idx int, path string, block int")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=by_text) == sorted(manifest(rows), key=by_text)


def test_merkle_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op12_product_codes", "op13_merkle"])
def test_same_as_sql(spark, name):
    from quillsift.llm import queries

    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name]) == ""
