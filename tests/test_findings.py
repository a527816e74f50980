"""What a review found wrong: each of these failed before."""

import random
import re

from pyspark.sql import functions as F

from quillsift.operators import cited, ingest, locate, metrics, payload, pii, resume, retrieve, screen, sections
from quillsift.streaming import channel
from tests.oracle import SF


def test_kendall_of_many_pairs(spark):
    rows = spark.range(100_000).select(F.lit("j").alias("job"), F.col("id").alias("item"), F.floor(F.col("id") / 1000).cast("double").alias("score"), F.floor(F.col("id") / 1000).cast("double").alias("human"))
    got = metrics.kendall(rows, "job").first()
    assert got.concordant == 1000 * 1000 * 100 * 99 // 2 and got.tau_b == 1.0


def test_share_of_grounded_fields_at_a_half(spark):
    df = spark.createDataFrame([(40, 23, 40, 23), (200, 1, 0, 0)], "total int, grounded int, citations int, valid int")
    said = [r[0] for r in df.select(cited.said_grounding(*map(F.col, df.columns))).collect()]
    assert said == ["23/40 fields grounded (58%), 23/40 citations valid (58%)", "1/200 fields grounded (1%), 0/0 citations valid (100%)"]


def test_latin_headings(spark):
    lines = {"SKILLS": True, " ÉCOLE\t": True, "STRAßE": True, "ОПЫТ": False, "A ÷ B": False, "X" * 40: False, "ŒUVRE ſ": True, "Ab": False, "12": False, "A\x0b": True}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r[0]: r[1] for r in df.select("line", ingest.is_latin_heading(F.col("line"))).collect()} == lines


def test_channel_has_no_column_of_the_folders(spark, tmp_path):
    from quillsift.plans.streams import readers

    got = channel.run(spark, f"{SF}/events.parquet*", spark.read.parquet(f"{SF}/events.parquet").schema, f"file://{tmp_path}/channel", readers)
    assert got.columns == [c.split()[0] for c in channel.FRAME.split(", ")]


def test_evidence_in_one_pass(spark):
    """As many units as units() finds in roles, highlights and the rest one by one, on odd lines too, and a document's lines aren't shuffled for each."""
    text = "ANN\nx@y.z\n\nExperience\nbefore any role\nDev, Acme (01/2010 - 02/2011)\nBuilt 3, fast\n  \nLead, B, C (03/2011 - present)\nHelped\n\nPROJECTS\nA: b - github.com/c/1\n: c\nD:\nno colon\n\nEducation:\nBSc, U of X (2010)\nnothing\n\nSkills\na, b,, c\nd\n\nMY SKILLS\ne"
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, "SKILLS\none"), (4, ""), (5, "no heading"), (6, "Skills\n" + ",".join(f"s{k}" for k in range(1100)))], "document_id long, text string")
    found = sections.segment(screen.heading_boundaries(docs), docs.select("document_id", F.length("text").alias("length")))
    lines = resume.section_lines(found, docs).cache()
    want = resume.units(resume.roles(lines), resume.highlights(lines), resume.projects(lines), resume.education(lines), resume.skills(lines))
    got = resume.evidence(lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("unit_id = '6-skills-1101'").count() == 1
    assert got._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 2
    assert {tuple(r) for r in found.where("document_id > 2").collect()} == {(3, "skills", 0, 10, "SKILLS"), (5, "other", 0, 10, ""), (6, "skills", 0, docs.where("document_id = 6").first().text.__len__(), "Skills")}


def test_sections_by_one_look_at_the_lines(spark):
    docs = spark.createDataFrame([(1, "a\nSKILLS\nb")], "document_id long, text string")
    found = sections.segment(screen.heading_boundaries(docs), docs.select("document_id", F.length("text").alias("length")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1


def test_some_lines(spark):
    texts = ["", "a\nbb\n\nskills", "é\n" * 2500 + "skills\nx", "skills", None, "\n\nskills\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    got = ingest.some_lines(docs, lambda line: line != "é", "document_id")
    want = ingest.lines(docs, "document_id").where("line <> 'é'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_citing_reads_a_document_once(spark):
    """The cascade as one look-up beside the text: windows, loose quotes, similar lines, values, what isn't there."""
    text = "ab cd\nRole One, Works 1\nthe quick brown fox jumps\nRole One, Works 1\nzz"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    rows = [(1, 1, None, "Role One, Works 1", 30, 68), (1, 2, None, "ROLE  one, works 1", None, None), (1, 3, "ab cd", " \t", 10, 20), (1, 4, None, "quick brown fox jumps", None, None), (1, 5, "nowhere at all", "no such line", 0, 9), (1, 6, "Works 1", "the quick red fox jumps", 0, 5), (1, 7, None, "zz", 0, None), (2, 8, "a", "b", 0, 1)]
    fields = spark.createDataFrame(rows, "document_id long, field_id long, value string, quote string, low int, high int")
    found = screen.cite(fields, docs)
    got = {r.field_id: (r.start, r.end, r.confidence, r.grounded) for r in found.collect()}
    second = text.rindex("Role")
    assert got[1] == (second, second + 17, 1.0, True) and got[2] == (6, 23, 0.95, True) and got[3] == (0, 5, 1.0, True) and got[4] == (28, 49, 1.0, True)
    assert got[5] == got[8] == (None, None, 0.3, False) and got[6][:2] == (24, 49) and got[6][3] and got[7] == (68 + 1 - 1 + (len(text) - 70), len(text), 0.9, True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_quarantine_by_itself(spark):
    """As screen_batch() has it, but neither cited, searched nor judged."""
    text = "ANN\n\nEXPERIENCE\nDev, Acme (01/2010 - 02/2011)\nBuilt 3\n\nSKILLS\na, b"
    texts = [text, " ", None, "no heading", "x " * 300, text + " y" * 300, "z" * (screen.LONGEST + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    rubric = spark.createDataFrame([("r1", "Built thousand units", "must_have", 100.0)], "requirement string, asked string, kind string, weight double")
    want = {(1, "no text"), (2, "no text"), (3, "no evidence"), (4, "failed extraction"), (6, "too long")}
    for blind in (True, False):
        assert {tuple(r) for r in screen.quarantine(docs, blind).collect()} == {tuple(r) for r in screen.screen_batch(docs, rubric, blind)[1].collect()} == want


def test_spans_resolved(spark):
    """Against one span after the other; a text of 20 000 spans too, of which each was once copied for each."""
    rng = random.Random(5)
    lists = [[(s := rng.randrange(60), s + rng.choice((0, 1, 2, 3, 9)), rng.choice("ab"), str(k)) for k in range(rng.randrange(12))] for _ in range(300)]
    lists += [None, [], [(3 * k, 3 * k + 2 + k % 2 * 2, "a", "") for k in range(20_000)]]

    def plain(spans):
        kept = []
        for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if not any(k[0] < s[1] and s[0] < k[1] for k in kept):
                kept.append(s)
        return sorted(kept) if len(spans) > 1 else kept

    df = spark.createDataFrame(list(enumerate(lists)), f"document_id long, spans {pii.SPAN}")
    got = {r.document_id: r.spans and [tuple(s) for s in r.spans] for r in pii.resolved(df, "spans").collect()}
    for k, spans in enumerate(lists[:-1]):
        assert got[k] == (spans and plain(spans))
    assert [s[:2] for s in got[len(lists) - 1]] == [(0, 2), *((3 * k, 3 * k + 4) for k in range(1, 20_000, 2))]


def test_payloads_are_parsed_once(spark):
    texts = ['{"band": "a", "score": 1, "requirements": []}', "{", '{"score": 1, "requirements": []}', '{"band": "a", "score": 1, "requirements": "x"}', None, '{"band": null, "score": 1, "requirements": []}']
    rows = payload.parsed(spark.createDataFrame(list(enumerate(texts)), "k long, json string"), "json")
    whole, lost = payload.restored(rows, "k")
    assert {tuple(r) for r in lost.collect()} >= {(1, "not JSON"), (2, "no band"), (3, "requirements of another type"), (4, "not JSON")} and 0 in {r.k for r in whole.collect()}
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_draws_are_summed_up_where_they_are_made(spark):
    rows = spark.range(400).select(F.lit("j").alias("job"), F.col("id").alias("item"), (F.col("id") % 7).cast("double").alias("score"), (F.col("id") % 3).cast("double").alias("human"))
    got = metrics.bootstrap(rows, "job", samples=150)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("RepartitionByExpression") > plan.index("Generate explode(sequence")
    assert got.first().low <= got.first().value <= got.first().high
    same = rows.withColumn("human", F.lit(1.0))
    assert tuple(metrics.bootstrap(same, "job", samples=20, statistic="mae").first())[1] == round(sum(abs(k % 7 - 1) for k in range(400)) / 400, 6)


def test_bm25_moves_no_pairs(spark):
    """A unit's words stay together: no shuffle by query and unit; the same scores as by terms."""
    units = spark.createDataFrame([(0, k, " ".join(f"w{j % (k % 5 + 2)}" for j in range(k % 9))) for k in range(60)] + [(1, 1, "w1 w2"), (0, 99, None)], "corpus int, unit long, text string")
    queries = spark.createDataFrame([(0, q, f"w{q} w1 w{q} nowhere") for q in range(4)], "corpus int, query long, text string")
    got = retrieve.bm25(units, queries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*query#", plan)
    want = retrieve.bm25(units, queries.drop("corpus")).where("corpus = 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() > 0


def test_cascade_in_one_look(spark):
    """As placed() and then fuzzy() find the quotes, in one pass beside the text."""
    docs = spark.createDataFrame([(1, "ab cd\nRole One, Works 1\nthe quick brown fox jumps\nzz"), (3, "")], "document_id long, text string")
    said = ["Role One, Works 1", "ROLE  one, works 1", "quick brown fox jumps high", "zz", "xy", "   ", None, "nothing like it at all", "quick brown fox"]
    quotes = spark.createDataFrame([(d, k, q) for d in (1, 2, 3) for k, q in enumerate(said)], "document_id long, quote_id long, quote string")
    got = locate.located(quotes, docs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    first = {(r.document_id, r.quote_id): r.hit and tuple(r.hit) for r in locate.placed(quotes, docs).collect()}
    near = {(r.document_id, r.quote_id): (r.start, r.end, r.score, "fuzzy") for r in locate.fuzzy(quotes.where("length(trim(quote)) >= 4"), docs).collect()}
    assert {(r.document_id, r.quote_id): r.strategy and tuple(r)[2:] for r in got.collect()} == {k: hit or near.get(k) for k, hit in first.items()}
    assert {r.strategy for r in got.collect()} == {"exact", "normalised", "unique-short", "fuzzy", None}
    low = quotes.withColumns({"low": F.lit(6).cast("int"), "high": F.lit(None).cast("int")})
    assert {r.quote_id for r in locate.located(low, docs).collect() if r.strategy} == {0, 1, 2, 3, 8}


def test_units_are_counted_without_being_made(spark):
    """as many as extracted() makes, on odd lines too, and no line is shuffled or written for it."""
    long = "ANN\n\nExperience\nbefore any role\nDev, Acme (01/2010 - 02/2011)\nBuilt 3, fast\n  \nLead, B, C (03/2011 - present)\n\nPROJECTS\nA: b - github.com/c/1\n: c\nD:\nno colon\n: \n\nEDUCATION\nBSc, U\n,\nnothing\n\nSKILLS\na, b,, c\n ,\n\n MY SKILLS \r\ne\nEXPERIENCE\nHelped"
    texts = [long, "skills\na", "no heading\nskills, many", "Skills\na,b\nPROJECTS\nx: y", "", None, "PROJECTS", "\n\nEDUCATION\n\nBSc, é " + "x" * 900, "Work\n" * 3 + "Dev, A (1 - 2)", "SKILLS\n" + "é, " * 60 + "z\n" * 2500, long.lower()]
    docs = spark.createDataFrame([*enumerate(texts)], "document_id long, text string")
    made = {r[0]: r[1] for r in screen.extracted(docs)[1].groupBy("document_id").count().collect()}
    counts = screen.unit_counts(docs)
    assert {r.document_id: (r.chars, r.n_units) for r in counts.collect()} == {k: (None if t is None else len(t), made.get(k, 0)) for k, t in enumerate(texts)} and min(made[0], made[10]) > 8
    assert "Exchange" not in resume.degenerate(counts)._jdf.queryExecution().executedPlan().toString()


def test_lines_that_may_be_headings(spark):
    """words at a line's end are sought from the end; the same lines are found as by a search anywhere."""
    first, last = ("|".join(sorted({k.split()[n] for k, _ in sections.ORDERED})) for n in (0, -1))
    rng, parts = random.Random(12), ["skills", "Side", "xeducation", "stack9", "é", " ", "-", "ach", "portfolio", "work", "K", ":", "qualificationsx"]
    lines = ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(500)]
    want = {t: t.strip(sections.BLANKS) != "" and len(t.strip(sections.BLANKS)) <= 40 and re.search(rf"^[^a-z0-9]*(?:{first})|(?:{last})[^a-z0-9]*\Z", t.strip(sections.BLANKS).lower()) is not None for t in lines}
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    assert {r[0]: r[1] for r in df.select("line", sections.maybe(F.col("line"))).collect()} == want and 50 < sum(want.values()) < 450


def test_asked_runs_are_found_without_sorting_all_runs(monkeypatch):
    """of a text's runs of words only those that are asked for are put in order; places stay as they were."""
    rng = random.Random(25)
    words = rng.choices([f"w{k}" for k in range(300)], k=5_000)
    asked = [tuple(words[k : k + n]) for n in (3, 4, 9) for k in rng.sample(range(4_900), 40)] + [("w1", "nowhere", "w2"), ("w1",) * 6_000]
    sizes, sort = [], locate.np.argsort
    monkeypatch.setattr(locate.np, "argsort", lambda a, **more: sizes.append(len(a)) or sort(a, **more))
    got = locate.Words(" ".join(words)).places(asked)
    monkeypatch.undo()
    for w in asked[:-1]:
        assert got[w].tolist() == [k for k in range(len(words) - len(w) + 3) if tuple(words[k : k + len(w) - 2]) == w[1:-1]]
    assert asked[-1] not in got and len(sizes) == 3 and max(sizes) < 2_500


def test_similar_lines_by_rank():
    """words are ranked once for a text, sets are of ranks; the first best line or pair of lines is found, as by trying all."""
    rng, words = random.Random(27), "a b c d e f g h i j k l zz é k1 ,".split()
    for _ in range(300):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(rng.randint(0, 9)))
        lines, rows, at = locate.Lines(text), [], 0
        for line in text.split("\n"):
            if line.strip():
                rows.append((at, at + len(line), {*re.findall("[a-z0-9]+", line)}))
            at += len(line) + 1
        rows += [(a[0], b[1], a[2] | b[2]) for a, b in zip(rows, rows[1:])]  # noqa: B905
        quote, low, high = " ".join(rng.choices([*words, "new"], k=rng.randint(0, 8))), rng.randint(0, 3), len(text) - rng.randint(0, 3)
        said = {*re.findall("[a-z0-9]+", quote)}
        tries = [(-len(said & w) / len(said | w), s, e) for s, e, w in rows if said and s >= low and e <= high]
        best = min((t for t in tries if -t[0] >= locate.FUZZY), default=None)
        assert lines.best(quote, low, high) == (best and (best[1], best[2], -best[0]))
        assert all(isinstance(w, int) for s in lines.places for w in s)


def test_channel_drops_nothing(spark, tmp_path):
    """Readers of a run of 1 300 states get them all, and `done` last."""
    import os

    from pyspark.sql import types as T

    from quillsift.plans import registry, streams  # noqa: F401
    from tests import oracle

    for t in oracle.TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    kinds = spark.read.parquet(f"{SF}/events.parquet").schema
    k = F.col("id")
    rows = {"event_id": k, "ts": F.timestamp_seconds(k), "user_id": F.lit(7), "event_type": F.when(k == 1312, "purchase").when(k < 60, "view").otherwise("click"), "value": F.lit(151.0)}
    made = spark.range(1, 1320).select([(rows[f.name] if f.name in rows else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType(kinds)])
    made.coalesce(1).toPandas().to_parquet(tmp_path / "events.parquet", index=False, coerce_timestamps="us")
    assert oracle.compare(spark, registry.QUERIES["progress_channel"], registry.SQL["progress_channel"], str(tmp_path)) == ""
    got = registry.QUERIES["progress_channel"](spark, str(tmp_path)).where("reader = 5").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(got))) and [r.event_id for r in got if r.event_id] == [4, *(e for e in range(6, 1313) if e >= 60 or e % 5)] and got[-1].kind == "done"


def test_redacted_resumes_say_what_the_masks_leave(spark):
    import hashlib

    from quillsift.plans import registry
    from quillsift.plans.resumes import resumes
    from tests.test_bruteforce import spans_of

    def masked(t):
        for start, end, category in spans_of(t):
            if category != "url":
                label = f"[{category.upper()}]"
                t = t[:start] + (label if len(label) <= end - start else "").ljust(end - start, "#") + t[end:]
        return len(t), hashlib.sha256(t.encode()).hexdigest()

    want = {r.document_id: masked(r.text) for r in resumes(spark, SF).collect()}
    got = registry.QUERIES["redact_resumes"](spark, SF).collect()
    assert {r.document_id: (r.n_chars, r.text_sha256) for r in got} == want
    assert all(h != hashlib.sha256(r.text.encode()).hexdigest() for r in resumes(spark, SF).collect() for h in [want[r.document_id][1]])
    docs = [(1, "nothing here to find"), (2, None), (3, "a@b.co a@b.co")]
    got = sorted(map(tuple, pii.report(pii.redact(spark.createDataFrame(docs, "doc_id long, text string"))).collect()))
    assert [r[:4] for r in got] == [(1, None, 0, 20), (2, None, 0, 0), (3, "email", 2, 13)] and got[2][4] == masked(docs[2][1])[1]


def test_searched_within_a_document(spark):
    """As search() finds it, by both second rankers, ties too; a document's units, which stand at hand, aren't joined by word."""
    rng = random.Random(5)
    words = "python spark data engineer built large tables sql go rust x a the . c++ 12".split()
    rows = [(c, n, rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 9))), "Python Spark", "", "the a"])) for c in range(12) for n in rng.sample(range(1, 200), rng.choice([1, 3, 60]))]
    rows += [(90, 1, None), (91, 1, "Straße PYTHONK python python"), (92, 5, "nothing")]
    asked = [("q1", "Python and Spark for large tables"), ("q2", "sql sql rust"), ("q3", "the a"), ("q4", ""), ("q5", "nobody says this")]
    df, queries = spark.createDataFrame(rows, "corpus long, unit long, text string"), spark.createDataFrame(asked, "query string, text string")
    for second in retrieve.AT_HAND:
        want = {(r.corpus, r["query"], r.place): r.unit for r in retrieve.search(df, queries, 4, second).collect()}
        by = {}
        for corpus, unit, text in rows:
            by.setdefault(corpus, []).append((unit, text))
        found = retrieve.Within(asked, 4, second)([*by.values()])
        assert {(c, q, place): own[i][0] for (c, own), best in zip(by.items(), found, strict=True) for q, place, i in best} == want and len(want) > 40
    assert retrieve.Within(asked, 4, retrieve.similarity)([[], [(1, "rust")], []])[1] == [(q, 1, 0) for q, _ in asked if q == "q2"]


def test_screening_with_any_second_ranker(spark):
    """Cited, verified and searched beside the text, or by joins where the second ranker is another: the same rows."""
    from quillsift.plans.resumes import resumes
    from quillsift.plans.screening import rubric

    docs = resumes(spark, SF).where("document_id % 9 = 1").unionByName(spark.createDataFrame([(-1, "x\nSKILLS\nnone"), (-2, "y " * 300), (-3, "E\nPROJECTS\nA: B C\nA: b c")], "document_id long, text string"))
    for blind, second in ((False, retrieve.keyword_overlap), (True, retrieve.similarity)):
        here, there = (screen.screen_batch(docs, rubric(spark), blind, second=s) for s in (second, lambda units, queries, f=second: f(units, queries)))
        assert [sorted(map(str, df.collect())) for df in here] == [sorted(map(str, df.collect())) for df in there]
        assert here[0].where("document_id < 0").count() == 2


def test_masks_of_a_batch(spark):
    """As masked() makes them of columns, with other categories too."""
    texts = ["Jane Doe\nj@x.org, +49 123 456 7890 he lives in Paris, ETH Zurich", "\U0001f600 \U0001f600 a@b.co", "", None, "no spans", "her", "see www.x.org/a (she)"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for categories in (pii.MASKED, pii.CATEGORIES, ["url"], []):
        got = {r.document_id: r.redacted_text for r in pii.redact(df, categories=categories).collect()}
        t = F.coalesce("text", F.lit(""))
        want = pii.resolved(df.select("doc_id", t.alias("t"), pii.detected(t).alias("s")), "s").select("doc_id", pii.masked(F.col("t"), F.col("s"), categories).alias("m"))
        assert got == {r.doc_id: r.m for r in want.collect()}
