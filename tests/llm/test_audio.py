"""Chroma fingerprints: filters against direct sums, alignment of shifted and noisy recordings, classes against brute force."""

import io
import wave

import numpy as np

from quillsift.llm import chroma


def tune(seed, seconds=6, rate=chroma.RATE):
    rng = np.random.default_rng(seed)
    t = np.arange(int(rate * 0.25)) / rate
    notes = [sum(np.sin(2 * np.pi * 110 * 2 ** (n / 12) * t) for n in rng.integers(0, 36, 3)) / 3 for _ in range(seconds * 4)]
    return np.concatenate(notes)


def pcm(x):
    return np.clip(np.round(x * 100 + 128), 0, 255).astype(np.uint8).tobytes()


def wav(x, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(chroma.RATE)
        f.writeframes(np.repeat((x * 20000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def test_items_are_sums_over_rectangles():
    rng = np.random.default_rng(3)
    c = rng.random((40, 12)) + 0.01
    got = chroma.items(c)
    assert len(got) == 40 - chroma.WIDTH + 1 and len(chroma.FILTERS) == 16
    for place in (0, 7, len(got) - 1):
        want = 0
        for k, f in enumerate(chroma.FILTERS):
            sides = [np.concatenate([c[place + x : place + x + w, y : y + h].ravel() for x, y, w, h in side]).mean() for side in chroma._rectangles(*f)]
            v = np.log(sides[0] / sides[1])
            level = int(v > -0.12) + int(v > 0) + int(v > 0.12)
            want |= (level ^ level >> 1) << 2 * k
        assert got[place] == want


def test_alignment():
    c, x = chroma.Chroma(), tune(1)
    a = chroma.fingerprint(pcm(x), c)
    noisy = x + np.random.default_rng(2).normal(0, 0.02, len(x))
    b = chroma.fingerprint(pcm(noisy[chroma.HOP * 40 :]), c)
    place, error, overlap = chroma.align(a, b)
    assert place == 40 and error < 0.1 and overlap == len(b)
    assert chroma.align(b, a)[0] == -40
    other = chroma.align(a, chroma.fingerprint(pcm(tune(9)), c))
    assert other is None or other[1] > chroma.MAX_ERROR
    assert (chroma.fingerprint(wav(x), c) == chroma.fingerprint(wav(x, 2), c)).all()


def test_recordings(spark):
    x, y, z = tune(1), tune(2, 8), tune(3)
    rng = np.random.default_rng(4)
    sounds = [(1, pcm(x)), (2, pcm(x)), (3, pcm(x[chroma.HOP * 25 :])), (4, wav(x + rng.normal(0, 0.01, len(x)))), (5, pcm(y)), (6, pcm(y[: len(y) * 2 // 3])), (7, pcm(z)), (8, None), (9, b""), (10, b"abc"), (11, b"RIFF1234WAVEjunk"), (12, pcm(np.zeros(30000))), (None, pcm(x)), (7, pcm(z))]
    media = spark.createDataFrame([(i, s, 1, "k", 2) for i, s in sounds], "rec long, sound binary, id int, digest string, n int")
    got = chroma.recordings(media, "rec", "sound").collect()
    c = chroma.Chroma()
    prints = {i: chroma.fingerprint(s, c) for i, s in sounds if i is not None}
    want = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and len(prints[i]) and len(prints[j]) and (best := chroma.align(prints[i], prints[j])) and best[1] <= chroma.MAX_ERROR:
                want[j] = min(want[j], want[i])
    assert {r.id: r.class_id for r in got if r.id is not None} == want and len(got) == len(sounds)
    assert want[2] == want[3] == want[4] == 1 and want[6] == 5 and want[7] == 7
    by = {r.id: r for r in got}
    assert by[8].n_items == by[9].n_items == by[11].n_items == 0 and by[10].n_items == 1 and by[None].class_id is None
    assert (by[2].aligned_to, by[2].place, by[2].error) == (1, 0, 0.0) and abs(by[3].place) == 25
    assert chroma.recordings(media.limit(0), "rec", "sound").count() == 0


def classes(prints):
    """Classes of every pair that align() links, without any candidate search."""
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i > j and (best := chroma.align(prints[i], prints[j])) and best[1] <= chroma.MAX_ERROR:
                one, two = sorted((root[i], root[j]))
                root = {k: one if r == two else r for k, r in root.items()}
    return root


def test_recall_of_clips_and_bit_errors(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 32, 6000, dtype=np.uint32)
    prints = {0: base}
    for share in (0.01, 0.02, 0.05, 0.1, 0.3):
        for start in rng.integers(0, int(6000 * (1 - share)), 4).tolist():
            prints[len(prints)] = base[start : start + int(6000 * share)]
    for errors in (0.02, 0.05, 0.1, 0.15, 0.19):
        for _ in range(3):
            flips = (rng.random((6000, 32)) < errors) @ (1 << np.arange(32, dtype=np.uint64))
            prints[len(prints)] = base ^ flips.astype(np.uint32)
    for _ in range(5):
        prints[len(prints)] = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    want = classes(prints)
    assert sum(r == 0 for r in want.values()) == len(prints) - 5
    media = spark.createDataFrame([(i, x.tobytes()) for i, x in prints.items()], "rec long, sound binary")
    got = chroma.recordings(media, "rec", "sound", read=lambda sound, _: np.frombuffer(sound, "<u4")).collect()
    assert {r.id: r.class_id for r in got} == want


def test_overlap_is_tested_before_offsets_are_ranked():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 32, (2, 400), dtype=np.uint32)
    b[100:] = a[100:] ^ np.uint32(1)  # one bit in 32 differs at offset 0 ...
    b[300] = a[300]  # ... where one item is equal
    for k in range(6):  # six offsets of small overlap have two equal items each
        b[2 * k : 2 * k + 2] = a[360 + 4 * k : 362 + 4 * k]
    place, error, overlap = chroma.align(a, b)
    assert place == 0 and overlap == 400 and error < chroma.MAX_ERROR


def test_query(spark):
    from tests.oracle import SF

    rows = chroma.query(spark, SF).collect()
    assert len(rows) == 200 and all(r.n_items >= 1 for r in rows if r.doc_id >= 0) and any(r.class_id != r.doc_id for r in rows)


def test_runs_need_overlap_too(spark):
    """Two runs of equal items go on only if some offset between them lets the recordings overlap enough."""
    fact = lambda n, first, last: (n, first, last, *[None] * len(chroma.AROUND))
    kind = f"struct<n:int,first:int,last:int,{','.join(f'at{x}:int' for x in range(len(chroma.AROUND)))}>"
    cases = [(100, 90, 99, 100, 0, 9), (100, 40, 99, 100, 0, 9), (60, 0, 5, 200, 150, 199), (60, 0, 5, 200, 195, 199), (60, 55, 59, 200, 0, 3), (100, 3, 3, 100, 2, 2)]
    rows = spark.createDataFrame([(2 * k + 1, fact(*c[:3]), 2 * k, fact(*c[3:])) for k, c in enumerate(cases)], f"id long, fact {kind}, hub long, hub_fact {kind}")

    def enough(n, first, last, m, start, end):
        overlaps = [min(n - max(d, 0), m + min(d, 0)) for d in range(first - end, last - start + 1)]
        return any(x >= chroma.LEAST_ITEMS and 2 * x >= min(n, m) for x in overlaps)

    got = {r.b // 2 for r in chroma.met(rows).collect()}
    assert got == {k for k, c in enumerate(cases) if enough(*c)} and 0 < len(got) < len(cases)


def test_short_runs_are_compared_with_the_items_around(spark):
    """Two equal items in a row rule a chance pair out as one does; before, runs went on whatever stood around them."""
    from pyspark.sql import functions as F

    a, b = np.random.default_rng(8).integers(0, 1 << 32, (2, 200), dtype=np.uint32)
    c = a ^ np.uint32(1 << 7)
    for x in (a, b, c):
        x[100:102] = 12345
    own = spark.createDataFrame([(i, x.view(np.int32).tolist()) for i, x in enumerate((a, b, c))], "id long, items array<int>")
    rows = chroma.placed(own)
    hubs = rows.select("bucket", F.col("id").alias("hub"), F.col("fact").alias("hub_fact"))
    got = {(r.a, r.b) for r in chroma.met(rows.join(hubs, "bucket").where("id > hub")).collect()}
    assert got == {(2, 0)}


def test_frequent_items_go_by_stars(spark, monkeypatch):
    """Classes are brute force's whether a bucket's members are all compared or meet hubs, known classes or not."""
    rng = np.random.default_rng(9)
    base, other = rng.integers(0, 1 << 32, (2, 300), dtype=np.uint32)
    prints = {k: base[5 * k : 5 * k + 200].copy() for k in range(8)}
    prints |= {10 + k: np.where(rng.random(300) < 0.9, other, rng.integers(0, 1 << 32, 300, dtype=np.uint32)).astype(np.uint32) for k in range(8)}
    prints |= {20 + k: rng.integers(0, 1 << 32, 90, dtype=np.uint32) for k in range(8)}
    for x in prints.values():
        x[40], x[60:62] = 7, 9  # items that all have
    media = spark.createDataFrame([(i, x.tobytes()) for i, x in prints.items()], "rec long, sound binary")
    want = classes(prints)
    assert len(set(want.values())) == 10
    for few in (0, 4, 64):
        monkeypatch.setattr(chroma, "FEW", few)
        got = chroma.recordings(media, "rec", "sound", read=lambda sound, _: np.frombuffer(sound, "<u4")).collect()
        assert {r.id: r.class_id for r in got} == want
