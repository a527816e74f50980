"""Operators on hand-checked values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions import dates, text
from quillsift.operators import audit, embed, ingest, labels, locate, metrics, pii, resume, risks, scoring, sections, spans
from quillsift.sources import readers, store


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 9.0)], "job string, item int, v double")
    assert [r.r for r in metrics.average_ranks(df, "v", "r", "job").orderBy("item").collect()] == [1.5, 1.5, 3.0]


def pairs(x, y):
    c = d = tx = ty = 0
    inv = comparable = 0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            p = (x[i] - x[j]) * (y[i] - y[j])
            c, d = c + (p > 0), d + (p < 0)
            if p == 0:
                tx, ty = tx + (x[i] == x[j]), ty + (y[i] == y[j])
            if y[i] != y[j]:
                comparable, inv = comparable + 1, inv + (p < 0)
    below = ((c + d + tx) * (c + d + ty)) ** 0.5
    return (c - d) / below if below else 0.0, inv / comparable if comparable else 0.0


def test_kendall_counts(spark):
    rng = random.Random(1)
    groups = {f"g{k}": ([float(rng.randrange(k + 1)) for _ in range(12)], [float(rng.randrange(4)) for _ in range(12)]) for k in range(6)} | {"tied": ([1.0, 1.0, 2.0], [1.0, 1.0, 2.0]), "one": ([1.0], [2.0])}
    rows = [(g, i, a, b) for g, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {r.job: (r.kendall, r.inversion_rate) for r in metrics.kendall(spark.createDataFrame(rows, "job string, item int, score double, human double"), "job").collect()}
    for g, (x, y) in groups.items():
        want = pairs(x, y)
        assert got[g] == pytest.approx(want, abs=1e-6)
    assert got["tied"][0] == pytest.approx(2 / (2 + 1), abs=0.2)


def test_top_k(spark):
    for ours, theirs, want in (([3, 2, 1, 0], [3, 2, 1, 0], 1.0), ([0, 1, 2, 9, 8, 7], [3, 3, 3, 0, 0, 0], 0.0), ([9, 1, 2, 8, 7, 0], [3, 3, 3, 0, 0, 0], 1 / 3)):
        rows = [("j", i, float(a), float(b)) for i, (a, b) in enumerate(zip(ours, theirs, strict=True))]
        got = metrics.top_k_precision(spark.createDataFrame(rows, "job string, item int, score double, human double"), 3, "item", "job").first()
        assert got.precision == pytest.approx(want, abs=1e-6)


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 3.0), ("a", 2, 2.0, 4.0), ("b", 1, 1.0, 1.0)], "job string, item int, score double, human double")
    assert {r.job: r.pearson for r in metrics.pearson(df, "job").collect()} == {"a": 0.0, "b": 0.0}


def test_bootstrap_is_reproducible(spark):
    rows = [("a", i, float(i), float(i % 5)) for i in range(20)] + [("b", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "job string, item int, score double, human double")
    a, b = (metrics.bootstrap(df, "job", 200).orderBy("job").collect() for _ in range(2))
    assert a == b and a[0].low <= a[0].value <= a[0].high and (a[1].low, a[1].high) == (-1.0, 1.0)


@pytest.mark.parametrize("said, month", [("Jan 2020", 2020 * 12 + 1), ("2019", 2019 * 12 + 6), ("03/2018", 2018 * 12 + 3), ("13/2018", 2018 * 12 + 6), ("Present", dates.PRESENT), ("known", dates.PRESENT), ("", None), ("soon", None), ("Sept. 2021", 2021 * 12 + 9), ("12-1999", 1999 * 12 + 12)])
def test_month_index(spark, said, month):
    assert one(spark, dates.month_index(F.col("s")), s=said) == month


def test_gaps(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 22, 30), ("a", 25, 60), ("a", 71, 80), ("b", 0, dates.PRESENT), ("b", 100, 110), ("c", 5, 6)], "document_id string, start int, end int")
    assert [tuple(r) for r in risks.employment_gaps(df).collect()] == [("a", 22, 12)]


def test_ambiguity_is_by_doubles(spark):
    df = spark.createDataFrame([(1, "clear"), (1, "partial"), (2, "partial"), (2, "weak"), (3, "none"), (3, "strong"), (3, "strong")], "k int, verdict string")
    got = {r.k: (r.verdict, r.ambiguous, r.agreement) for r in scoring.consensus(df, "k").collect()}
    assert got == {1: ("partial", True, 0.5), 2: ("weak", False, 0.5), 3: ("strong", True, 0.666667)}


def test_rubric(spark):
    df = spark.createDataFrame([("j", 1, "Python", "must_have"), ("j", 2, " python ", "bonus"), ("j", 3, "SQL", "nice_to_have"), ("j", 4, "", "bonus"), ("j", 5, "Go", "bonus")], "job string, seq int, text string, kind string")
    got = scoring.rubric(df).orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 3, 5] and sum(r.weight for r in got) == pytest.approx(100) and got[0].weight == pytest.approx(66.67)


TEXT = "JANE DOE\njane.doe@mail.example.com | +1 (415) 555-0100\nShe studied at University of Oxford, London 2012 - 2016.\nsee https://jane.dev/x and call 2012-2016"


def test_redaction(spark):
    got = pii.redact(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")).orderBy("document_id").collect()
    kinds = {s.category: s.text for s in got[0].spans}
    assert kinds["name"] == "JANE DOE" and kinds["email"] == "jane.doe@mail.example.com" and kinds["gender_term"] == "She" and kinds["url"] == "https://jane.dev/x" and kinds["location"] == "London"
    assert all(TEXT[s.start : s.end] == s.text for s in got[0].spans) and len(got[0].redacted_text) == len(TEXT)
    assert "jane.doe" not in got[0].redacted_text and "https://jane.dev/x" in got[0].redacted_text and "[EMAIL]###" in got[0].redacted_text
    assert all(a.end <= b.start for a, b in zip(got[0].spans, got[0].spans[1:], strict=False)) and got[1].spans == [] and got[2].redacted_text == ""


def test_matches_have_code_point_offsets(spark):
    t = "😀a1 é22 333😀4"
    got = one(spark, text.matches(F.col("t"), "[0-9]+"), t=t)
    assert [(m.start, m.end) for m in got] == [(2, 3), (5, 7), (8, 11), (12, 13)]


def test_sections(spark):
    t = "Ann\nExperience\nx\nSkills:\ny\nExperience\nz"
    docs = spark.createDataFrame([(1, t), (2, "nothing here")], "document_id long, text string")
    found = sections.segment(sections.boundaries(ingest.lines(docs, "document_id")), docs.select("document_id", F.length("text").alias("length")))
    got = [(r.document_id, r.kind, t[r.start : r.end]) for r in found.orderBy("document_id", "start").collect()]
    assert got[:4] == [(1, "basics", "Ann\n"), (1, "work", "Experience\nx\n"), (1, "skills", "Skills:\ny\n"), (1, "work", "Experience\nz")] and got[4][1] == "other"
    hull = {r.kind: (r.start, r.end) for r in sections.hull(found.where("document_id = 1")).collect()}
    assert hull["work"] == (4, len(t))


def test_locate(spark):
    t = "Built a  Payment\nservice in Go.\nLed a team of five engineers in Berlin\nC++ and R"
    docs = spark.createDataFrame([(1, t)], "document_id long, text string")
    quotes = [(1, "service in Go"), (2, "built a payment SERVICE"), (3, "led team of five engineers berlin"), (4, "R"), (5, "C"), (6, "absent words here"), (7, "a"), (8, " ")]
    got = {r.quote_id: r for r in locate.located(spark.createDataFrame([(1, i, q) for i, q in quotes], "document_id long, quote_id int, quote string"), docs).collect()}
    assert (got[1].strategy, t[got[1].start : got[1].end]) == ("exact", "service in Go")
    assert (got[2].strategy, t[got[2].start : got[2].end]) == ("normalised", "Built a  Payment\nservice")
    assert got[3].strategy == "fuzzy" and t[got[3].start : got[3].end].startswith("Led a team")
    assert (got[4].strategy, got[4].start) == ("unique-short", len(t) - 1)
    assert got[5].strategy is None and got[6].strategy is None and got[7].strategy is None and got[8].strategy is None


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(d, k, a, a + rng.randrange(1, 9)) for d in range(30) for k in range(8) for a in [rng.randrange(20)]]
    df = spark.createDataFrame(rows, "document_id int, seq int, start int, end int")
    kept, covered = set(), {}
    for d in range(30):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], -r[3], r[1]))
        last = -1
        for r in own:
            if r[3] > last:
                kept.add(r)
                last = r[3]
        covered[d] = len({x for r in own for x in range(r[2], r[3])})
    assert {tuple(r) for r in spans.outermost(df).collect()} == kept
    lengths = spark.createDataFrame([(d, 40) for d in range(30)], "document_id int, length int")
    assert {r.document_id: r.covered for r in spans.coverage(df, lengths).collect()} == covered


def test_citations(spark):
    docs = spark.createDataFrame([(1, "Led a team of five people in London")], "document_id int, text string")
    c = spark.createDataFrame([(1, 0, 10, "led  A team"), (1, 0, 10, "something else"), (1, 30, 99, "London"), (9, 0, 1, "x")], "document_id int, start int, end int, quote string")
    assert [r.valid for r in spans.verify(c, docs).orderBy("document_id", "start", "quote").collect()] == [True, False, False, False]


def test_audit(spark):
    rows = [("gender", "a", "c1", True, 50.0), ("gender", "b", "c1", True, 60.0), ("gender", "a", "c2", True, 40.0), ("gender", "b", "c2", True, 42.0), ("null", "x", "c1", True, 50.0), ("null", "x", "c1", True, 51.0)]
    obs = audit.ranked(spark.createDataFrame([(*r, 1) for r in rows], "axis string, group string, candidate string, blind boolean, score double, meets int"), "axis", "group", "blind")
    got = {r.axis: r for r in audit.axis_results(obs).collect()}
    assert (got["gender"].max_drift, got["gender"].mean_drift) == (10.0, 6.0)
    gaps = {r.axis: (r.gap, r.favoured) for r in audit.group_gaps(obs).collect()}
    assert gaps["gender"] == (6.0, "b")
    gate = audit.gate(audit.axis_results(obs)).first()
    assert gate.failures == "gender:drift" and not gate.passed


def test_labels(spark):
    rows = [("a", i, "strong", "", i) for i in range(5)] + [("b", 0, "weak", "x", 0)] + [("c", i, ["weak", "solid"][i % 2], "x", i) for i in range(6)]
    df = spark.createDataFrame(rows, "job string, candidate int, tier string, rationale string, seq int")
    got = sorted(tuple(r) for r in labels.quality_warnings(df).collect())
    assert got == [("a", "missing_rationales"), ("a", "no_variance"), ("b", "too_few_labels"), ("c", "low_variance")]
    assert {(r.tier, r.n) for r in labels.tier_distribution(df).where("job = 'b'").collect()} == {(t, int(t == "weak")) for t in labels.TIERS}


def test_hashing_embedder(spark):
    v = embed.vector("Python engineer")
    assert np.isclose((v**2).sum(), 1) and not embed.vector("").any() and len(v) == embed.DIMENSIONS
    assert v @ embed.vector("python engineers") > v @ embed.vector("gardening tools")


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes(b"HELLO\nworld \xff")
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.md").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{readers.W[1:-1]}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {r.path.rpartition("/")[2]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "HELLO\nworld �" and got["b.exe"].error == "unsupported" and "c.md" not in got and got["d.docx"].text == "One\nx | y" and got["e.docx"].error.startswith("BadZipFile")


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    store.write_json(df, f"{tmp_path}/j")
    assert sorted(store.read_json(spark, f"{tmp_path}/j", "id int, text string").collect()) == sorted(df.collect(), key=lambda r: r.id)
    store.write_table(df, f"{tmp_path}/t")
    keys = store.cache_keys(spark.read.parquet(f"{tmp_path}/t"), "id", "text")
    assert store.cached(keys, keys.where("id = 1").select("key", F.lit("r").alias("response"))).where("hit").count() == 1
    assert store.markdown(df).splitlines()[2] == "| 1 | a |"


def test_units(spark):
    t = "ANN LEE\nann@example.com\n\nEXPERIENCE\nEngineer, Acme (01/2018 - 03/2020)\nBuilt things\nLead, Beta (04/2021 - present)\n\nPROJECTS\nTool: sorts files - github.com/a/t\n\nEDUCATION\nBSc, Oxford (2010)\n\nSKILLS\nGo, SQL"
    docs = spark.createDataFrame([(1, t)], "document_id long, text string")
    found = sections.segment(sections.boundaries(ingest.lines(docs, "document_id")), docs.select("document_id", F.length("text").alias("length")))
    lines = resume.section_lines(found, docs)
    units = resume.units(resume.roles(lines), resume.highlights(lines), resume.projects(lines), resume.education(lines), resume.skills(lines)).orderBy("n").collect()
    assert [u.text for u in units] == ["Engineer Acme", "Engineer at Acme Built things", "Lead Beta", "Tool", "Project Tool sorts files", "BSc Oxford", "Go", "SQL", "Skills: Go, SQL"]
    assert units[0].unit_id == "1-work-001" and units[-1].unit_id == "1-skills-009"
