"""Quality classifier, SentencePiece, mixing, WARC and the pipeline against plain Python."""

import gzip
import hashlib
import math
import struct
import zlib

import duckdb
import numpy as np
import pytest

from quillsift.llm import mixing, quality, sentencepieces, warc
from tests.oracle import SF, compare

ODD = [None, "", " ", "a", "  two  blanks ", "▁x▁ y", "a\x00b", "日本語😀\n\n\t x", "<s>hi</s> <0x41>", "²..½", "x" * 3000, " " * 50 + "a", "İstanbul K ſ", "éa", "The word, the word. THE WORD!!", "tail "]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "k", [1]) for i, t, s in rows], "doc_id long, text string, source string, n_chars long, score string, size array<int>")


def table_texts():
    return duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


# --- SentencePiece


def test_agenda_equals_library(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, "a", "s")] + [(100 + i, t, "s") for i, t in table_texts()]
    sp = sentencepieces.agenda(sentencepieces.model_path()).library
    got = sentencepieces.encode_decode(docs_of(spark, rows), sentencepieces.model_path(), extra=("token_ids", "decoded_text")).collect()
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        text = sp.decode(ids)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert [tuple(r) for r in got] == want
    assert sentencepieces.encode_decode(docs_of(spark, rows).limit(0), sentencepieces.model_path()).count() == 0


def test_agenda_without_cuts():
    own = sentencepieces.Agenda(sentencepieces.model_path())
    whole = sentencepieces.Agenda(sentencepieces.model_path())
    whole.whole, whole.chunks = True, __import__("re").compile("(?s).+").findall
    for _, t in table_texts()[:25]:
        assert own.encode(t[:1500]) == whole.encode(t[:1500])


def test_difference_raises():
    own = sentencepieces.Agenda(sentencepieces.model_path())
    with pytest.raises(ValueError):
        own.compare("some text", b"", b"")


# --- Quality


def test_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2, 5)]
    y = np.array([0, 1, 1, 0])
    a, b = quality.fit(bags, y), quality.fit(bags, y)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert ((quality.score(a, bags) > 0.5) == y).all()


def test_attention_weighs_passages():
    rng = np.random.default_rng(2)
    bags, y = [], []
    for k in range(300):
        bag = rng.normal(size=(rng.integers(2, 8), quality.FEATURES))
        bag[:, 0] = 0
        if k % 2:
            bag[rng.integers(len(bag)), 0] = 6  # one passage decides
        bags.append(bag)
        y.append(k % 2)
    model = quality.fit(bags[:200], np.array(y[:200]))
    assert ((quality.score(model, bags[200:]) > 0.5) == np.array(y[200:])).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    labels = duckdb.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[i].predicted, q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    assert np.mean([p == q for p, q in held]) > 0.9


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, f"word{i} " * (i % 9 + 1) + ("!!" if i % 2 else "."), "s") for i in range(200)]
    docs = docs_of(spark, rows)
    labels = [(i, i % 2) for i in range(200)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    models = [quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (labels, flipped + [(None, 1), (5, None)])]
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 4, 2])
    starts, x, y = np.array([0, 1, 5]), rng.normal(size=(7, 6)), np.array([1.0, 0.0, 1.0])
    p = {"e": rng.normal(size=(6, 5)), "f": rng.normal(size=5), "v": rng.normal(size=(5, 3)), "u": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "b": np.array(0.2)}

    def loss(q):
        s = quality._forward(q, x, starts, lengths)["y"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    found = quality.gradient(p, x, y, starts, lengths)
    for k, v in p.items():
        for at in np.ndindex(v.shape):
            step = np.zeros(v.shape)
            step[at] = 1e-6
            want = (loss(p | {k: v + step}) - loss(p | {k: v - step})) / 2e-6
            assert abs(found[k][at] - want) < 1e-7


def test_scores_by_brute_force(spark):
    """Scores of whole texts against the formula, passage by passage in plain Python."""
    rng = np.random.default_rng(8)
    n, h, g = quality.FEATURES, 4, 3
    model = {"e": rng.normal(size=(n, h)), "f": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "w": rng.normal(size=g), "c": rng.normal(size=h), "b": 0.3, "mean": rng.normal(size=n), "scale": rng.random(n) + 0.5}
    texts = ["", None, "one", "a b c. " * 300, "Wörter 12 !! " * 64, "x" * 100_000, "long text, " * 30_000]
    got = {r.doc_id: r for r in quality.scores(spark.createDataFrame([(i, t, 0.5, "m") for i, t in enumerate(texts)], "doc_id long, text string, score double, _m string"), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        bag = [words[k : k + quality.PASSAGE] for k in range(0, len(words), quality.PASSAGE)] or [[]]
        states, logits = [], []
        for x in quality.encode(bag, quality.Buckets()):
            state = [math.tanh(sum((x[r] - model["mean"][r]) / model["scale"][r] * model["e"][r][c] for r in range(n)) + model["f"][c]) for c in range(h)]
            gate = [math.tanh(sum(state[c] * model["v"][c][k] for c in range(h))) / (1 + math.exp(-sum(state[c] * model["u"][c][k] for c in range(h)))) for k in range(g)]
            states.append(state)
            logits.append(math.exp(sum(gate[k] * model["w"][k] for k in range(g))))
        z = [sum(logits[p] * states[p][c] for p in range(len(bag))) / sum(logits) for c in range(h)]
        want = 1 / (1 + math.exp(-(sum(z[c] * model["c"][c] for c in range(h)) + 0.3)))
        assert abs(got[i]["__score"] - want) < 1e-9 and got[i].score == 0.5


def test_training_reads_every_passage_and_is_ordered(spark):
    """The last passage of a long text counts, repeated rows count once, the sample is bounded by documents and passages."""
    seen = []
    text = "good words here. " * 2000
    rows = [(i, text + ("zzz 999 " * 64 if i % 2 else "fine words. " * 64)) for i in (1, 3, 4, 6, 7, 8, 9, 11, 12, 13)]
    docs = spark.createDataFrame(rows + rows[:4] + [(4, "another text")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    fit = quality.fit
    try:
        quality.fit = lambda bags, y: seen.append(([len(b) for b in bags], list(y))) or fit(bags, y)
        for limits in ({}, {"max_train": 3}, {"max_passages": 250}):
            a, b = (quality.train(docs, labels, **limits) for _ in range(2))
            assert all((a[k] == b[k]).all() for k in a) if "constant" not in a else a == b
    finally:
        quality.fit = fit
    known = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    whole = {len(t.split()) // 64 + (len(t.split()) % 64 > 0) for _, t in rows}
    assert len(seen[0][0]) == len(known) + (4 in known) and set(seen[0][0]) <= whole | {1}
    assert len(seen[2][0]) <= 3 and sum(seen[4][0]) <= 250


def test_quality_edges(spark):
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "x", "s"), (3, "a", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) == {"constant": 0.5}
    assert quality.train(docs, spark.createDataFrame([(0, 1), (1, 1), (3, 1)], "doc_id long, quality int")) == {"constant": 1.0}
    got = quality.scores(docs, {"constant": 0.5})
    assert got.count() == len(ODD) + 2 and quality.scores(docs.limit(0), {"constant": 0.5}).count() == 0
    kept = quality.keep_good(spark, docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


# --- Mixing


def want_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (i % 13 + 1)), ["a", "b", "é", None, "Z"][i * i % 5]) for i in range(400)] + [(1000, None, "a"), (1001, "", None), (1002, "x \t y\x0bz", "solo"), (5, "w w", "b"), (None, "one two", "b"), (7, "again and", "a"), (7, "again and", "a")]
    docs = docs_of(spark, rows)
    got = mixing.take(mixing.sizes(docs)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = want_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 14
    assert sum(r.taken for r in got) == round(sum(target.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.take(mixing.sizes(docs)).collect()))
    mixed = mixing.mixed(docs).collect()
    assert sum(len(r.text.split()) for r in mixed) >= sum(r.taken for r in got) - 1 and mixing.mixed(docs).columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in mixed)


def test_mixing_edges(spark):
    assert mixing.take(mixing.sizes(docs_of(spark, []))).count() == 0 and mixing.mixed(docs_of(spark, [])).count() == 0
    got = mixing.take(mixing.sizes(docs_of(spark, [(1, None, "a"), (2, "", None)]))).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_mix_of_equal_rows_loses_no_word(spark):
    rows = [(1, "a", "w1 w2 w3")] * 3 + [(2, "b", "x y z u v"), (3, None, "q"), (3, None, "q"), (None, "b", None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, _mark int, _turn int, `a.b` int")
    taken = mixing.take(mixing.sizes(docs)).agg({"taken": "sum"}).first()[0]
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == taken


def test_quality_names(spark):
    docs = spark.createDataFrame([(1, "some words", "s", 1, 2), (2, None, "s", 1, 2)], "doc_id long, text string, __score string, `a.b` int, c0 int")
    model, labels = {"constant": 0.9}, spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.scores(docs, model)
    assert got.columns == ["doc_id", "text", "a.b", "c0", "__score"] and {r["__score"] for r in got.collect()} == {0.9}
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and {r["__score"] for r in kept.collect()} == {"s"}


def test_mixing_sql(spark):
    assert compare(spark, mixing.query, mixing.ORACLE) == ""


# --- WARC


def test_warc(spark, tmp_path):
    big, other = "é<p>\r\n\r\nWARC/1.1\r\n" * 20, "y" * 100
    pages = [(5, "http://a/5", big), (2, "http://a/2\r\nEvil: 1", big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (10, "u", other), (8, "u", other), (None, "u", other), (11, "u", "y" * 99), (12, "u", "y" * 99)]
    df = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in pages], "page_id long, url string, html string, digest int, again string")
    warc.write(warc.resolve(df), f"{tmp_path}/w", "2024-01-01T00:00:00Z")
    read = warc.read(spark, f"{tmp_path}/w", with_payload=True)
    got = warc.rejoin(read).collect()
    first = {big: 2, other: 8}
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h in first and first[h] != i else "response", first[h] if h in first and first[h] != i else None) for i, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload == (dict((i, h) for i, _, h in pages)[r.page_id] or "") for r in got if r.record_type == "response")
    assert {r.page_id: r.url for r in got}[2] == "http://a/2%20%20Evil:%201" and {r.page_id: r.url for r in got}[9] is None
    archive = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-"))
    for headers, block in warc.records(archive.read_bytes()):
        assert len(block) == int(headers["content-length"]) and headers["warc-date"] == "2024-01-01T00:00:00Z"


def test_warc_archives(spark, tmp_path, monkeypatch):
    """Each record is a gzip member of its own, archives are bounded by bytes and opened by warcinfo, record ids differ."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rng = np.random.default_rng(3)
    pages = [(i % 50, f"u{i}", rng.bytes(600).hex() if i % 3 else "z" * 300) for i in range(120)] + [(7, None, "x" * 3_000_000)]
    warc.write(warc.resolve(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)), f"{tmp_path}/w")
    kinds, ids, files = [], [], [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    for path in files:
        content = path.read_bytes()
        found = [h for h, _ in warc.records(content)]
        assert content.endswith(gzip.compress(b"", mtime=0)) and found[0]["warc-type"] == "warcinfo" and gzip.decompress(content).count(b"WARC/1.1") == len(found)
        kinds += [h["warc-type"] for h in found]
        ids += [h["warc-record-id"] for h in found]
    assert len(files) > 3 and len(set(ids)) == len(ids) and kinds.count("warcinfo") == len(files) and len(kinds) == len(files) + len(pages)
    got = warc.read(spark, f"{tmp_path}/w", with_payload=True)
    assert got.where("payload_bytes = 3000000 AND length(payload) = 3000000").count() == 1 and got.where("record_type = 'revisit'").count() == 39


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.resolve(df), f"{tmp_path}/w")
    assert warc.rejoin(warc.read(spark, f"{tmp_path}/w")).count() == 0


def test_warc_sql(spark):
    assert compare(spark, warc.query, warc.ORACLE) == ""


# --- Pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps what its brute-force version keeps of the stage's own input."""
    import corpus_pipeline
    from tests.llm.test_dedup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            scored = {r.doc_id: r.score for r in quality.query(spark, SF).collect()}
            assert {r.doc_id for r in after} == {i for i, s in scored.items() if s >= 0.7}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best.setdefault("".join((r.text or "").split(" ")).translate({k: None for k in range(9, 14)}), []).append((-len(r.text), r.doc_id))
            assert {r.doc_id for r in after} == {min(v)[1] for v in best.values()}
        elif name == "near_dedup":
            assert {r.doc_id for r in after} == set(brute([(r.doc_id, r.text) for r in before]).values())
        elif name == "mixing":
            words = sum(len((r.text or "").split()) for r in before)
            assert abs(sum(len(r.text.split()) for r in after) - 1.5 * words) < 0.01 * words
        else:
            sp = sentencepieces.agenda(sentencepieces.model_path()).library
            assert sorted((r.doc_id, r.token_ids) for r in after) == sorted((r.doc_id, sp.encode(r.text, add_bos=True, add_eos=True)) for r in before)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, None if i % 3 else "s") for i, t in enumerate(ODD)] + [(3, "a", "s"), (None, None, None)]
    docs = docs_of(spark, rows).withColumnsRenamed({"score": "key", "size": "n"})
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
        assert (now.count() > 0) == (given is docs)
