"""Screening from end to end over rendered resumes, and the small rules around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import ingest, resume, retrieve, screen, sections, values
from quillsift.plans import documents
from quillsift.plans.ranking import sql_tokens
from quillsift.plans.registry import query, table
from quillsift.plans.resumes import REQUIREMENTS, RESUME_SQL, UNIT_SQL, resumes
from quillsift.sources.shared import kept

WEIGHTS = {"r1": 40.0, "r2": 40.0, "r3": 13.33, "r4": 6.67}
RUBRIC_SQL = "(VALUES " + ", ".join(f"('{i}', '{t}', '{k}', {WEIGHTS[i]}::DOUBLE)" for i, t, k in REQUIREMENTS) + ")"
#: Verdicts and citations of each candidate and requirement: the candidate's own units searched, the four best judged.
ASSESS_SQL = UNIT_SQL + f""",
q AS (SELECT * FROM {RUBRIC_SQL} t(requirement, asked, kind, weight)),
tok AS (SELECT document_id, n, {sql_tokens("text")} AS t FROM v_units), stat AS (SELECT document_id, count(*) AS units, avg(len(t)) AS mean_length FROM tok GROUP BY 1),
tf AS (SELECT document_id, n, length, term, count(*) AS tf FROM (SELECT document_id, n, len(t) AS length, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL),
asks AS (SELECT requirement, term, count(*) AS times FROM (SELECT requirement, unnest({sql_tokens("asked")}) AS term FROM q) GROUP BY ALL),
lex AS (SELECT document_id, requirement, n, round(sum(ln(1 + (units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / mean_length))) * times), 6) AS score FROM tf JOIN df USING (document_id, term) JOIN asks USING (term) JOIN stat USING (document_id) GROUP BY ALL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, requirement ORDER BY score DESC, n) AS rank FROM lex WHERE score > 0) WHERE rank <= 20),
kw AS (SELECT document_id, requirement, n, round(count(*) / any_value(terms), 6) AS score FROM (SELECT DISTINCT document_id, n, term FROM tf) JOIN asks USING (term) JOIN (SELECT requirement, count(*) AS terms FROM asks GROUP BY 1) USING (requirement) GROUP BY ALL),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, requirement ORDER BY score DESC, n) AS rank FROM kw) WHERE rank <= 20),
fused AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.requirement, b.requirement) AS requirement, coalesce(a.n, b.n) AS n, a.rank AS ra, b.rank AS rb, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s
  FROM one a FULL JOIN two b ON a.document_id = b.document_id AND a.requirement = b.requirement AND a.n = b.n),
v_hits AS (SELECT f.*, text, section FROM (SELECT *, row_number() OVER (PARTITION BY document_id, requirement ORDER BY s DESC, ra NULLS LAST, rb NULLS LAST, n) AS place FROM fused) f JOIN v_units u ON f.document_id = u.document_id AND f.n = u.n WHERE place <= 4),
w AS (SELECT requirement, unnest(list_filter(string_split(lower(asked), ' '), lambda w: length(w) > 4)) AS w FROM q), words AS (SELECT requirement, count(*) AS words FROM w GROUP BY 1),
share AS (SELECT document_id, requirement, place, section, n, count_if(contains(lower(text), regexp_replace(w, 's+$', ''))) / any_value(words) AS share FROM v_hits JOIN w USING (requirement) JOIN words USING (requirement) GROUP BY ALL),
samples AS (SELECT *, unnest([-0.1, 0.0, 0.1]::DOUBLE[]) AS more FROM share),
marks AS (SELECT *, CASE WHEN share + more >= 0.55::DOUBLE THEN 4 WHEN share + more >= 0.38::DOUBLE THEN 3 WHEN share + more >= 0.22::DOUBLE THEN 2 WHEN share + more > 0.08::DOUBLE THEN 1 ELSE 0 END AS o FROM samples),
best AS (SELECT document_id, requirement, more, max(o) AS o FROM marks GROUP BY ALL),
agreed AS (SELECT document_id, requirement, list_sort(list(o))[2] AS o, count_if(o = m) AS same, min(o) AS low, max(o) AS high FROM (SELECT *, list_sort(list(o) OVER (PARTITION BY document_id, requirement))[2] AS m FROM best) GROUP BY ALL),
names AS (SELECT document_id, requirement, list(document_id || '-' || section || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') ORDER BY place) AS named FROM (SELECT *, max(o) OVER (PARTITION BY document_id, requirement) AS top FROM marks WHERE more = 0) WHERE o = top GROUP BY ALL),
v_assessed AS (SELECT d.document_id, q.requirement, kind, weight, coalesce(o, 0) AS o, round(coalesce(same, 3) / 3, 6) AS agreement, coalesce(low, 0) AS low, coalesce(high, 0) AS high, CASE WHEN coalesce(o, 0) = 0 THEN [] ELSE named END AS cited
  FROM (SELECT DISTINCT document_id FROM v_units) d CROSS JOIN q LEFT JOIN agreed a ON a.document_id = d.document_id AND a.requirement = q.requirement LEFT JOIN names m ON m.document_id = d.document_id AND m.requirement = q.requirement)
"""


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, k, WEIGHTS[i]) for i, t, k in REQUIREMENTS], "requirement string, asked string, kind string, weight double")


WORTH = "[0, 0.2, 0.5, 0.8, 1.0]::DOUBLE[]"
SCREEN_SQL = ASSESS_SQL + f""",
p AS (SELECT *, weight * ({WORTH})[o + 1] AS points, weight * ({WORTH})[low + 1] AS low_points, weight * ({WORTH})[high + 1] AS high_points, ({WORTH})[high + 1] - ({WORTH})[low + 1] > 0.3::DOUBLE AS ambiguous,
  CASE WHEN kind = 'must_have' AND o < 2 THEN 0 WHEN o = 2 THEN 1 WHEN ({WORTH})[high + 1] - ({WORTH})[low + 1] > 0.3::DOUBLE THEN 2 END AS reason FROM v_assessed),
c AS (SELECT document_id, round(sum(points), 1) AS score, round(sum(low_points), 1) AS score_low, round(sum(high_points), 1) AS score_high, round(avg(agreement), 3) AS mean_agreement, count_if(ambiguous) AS n_ambiguous, count_if(kind = 'must_have' AND o < 2) AS unmet_must_haves, sum(len(cited))::BIGINT AS n_cited,
  string_agg(requirement || '=' || array_to_string(cited, '+'), ';' ORDER BY requirement) AS citations, coalesce(string_agg(requirement, ',' ORDER BY reason, requirement) FILTER (reason IS NOT NULL), '') AS questions FROM p GROUP BY 1),
vague AS (SELECT o_custkey AS document_id FROM orders GROUP BY 1 HAVING count(*) >= 3 AND count_if(o_orderkey % 3 <> 1) >= 2), bare AS (SELECT o_custkey AS document_id FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1 HAVING count(*) >= 2),
spells AS (SELECT o_custkey AS document_id, m AS start, CASE WHEN o_orderstatus = 'O' THEN 99999 * 12 ELSE m + 3 + o_orderkey % 9 END AS e FROM (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders)),
gap AS (SELECT DISTINCT document_id FROM (SELECT document_id, start, max(e) OVER (PARTITION BY document_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM spells) WHERE start - latest >= 12 AND latest <> 99999 * 12),
bb AS (SELECT *, unmet_must_haves = 0 AS meets_all, CASE WHEN unmet_must_haves > 0 THEN 'missing_must_have' WHEN score >= 75 THEN 'strong' WHEN score >= 55 THEN 'solid' WHEN score >= 35 THEN 'mixed' ELSE 'weak' END AS band,
  concat_ws(',', CASE WHEN unmet_must_haves > 0 THEN 'unmet_must_have' END, CASE WHEN n_ambiguous > 0 THEN 'ambiguous_judgement' END, CASE WHEN document_id IN (SELECT document_id FROM gap) THEN 'employment_gap' END, CASE WHEN document_id IN (SELECT document_id FROM bare) THEN 'unlinked_projects' END, CASE WHEN document_id IN (SELECT document_id FROM vague) THEN 'vague_claims' END) AS flags FROM c)
SELECT document_id, score, score_low, score_high, band, meets_all, unmet_must_haves, mean_agreement, n_ambiguous, 1.0::DOUBLE AS grounding_rate, 1.0::DOUBLE AS validity_rate, n_cited, citations, flags, questions, row_number() OVER (ORDER BY meets_all DESC, score DESC, document_id) AS rank FROM bb"""


@query("screen_resumes", SCREEN_SQL)
def screen_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates against one rubric, texts as they are; BM25 is fused with keyword overlap, which SQL can say."""
    return _said(screen.screen(resumes(spark, sf_dir), rubric(spark), blind=False, second=retrieve.keyword_overlap))


@query("screen_blind")
def screen_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on masked texts, with hashed vectors as second ranker; tested against plain Python and for what the masks leave."""
    return _said(screen.screen(resumes(spark, sf_dir), rubric(spark)))


@query("screen_quarantine", RESUME_SQL + """,
a AS (SELECT document_id, text, 1000 AS n FROM v_resume UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END, 0 FROM documents)
SELECT document_id, CASE WHEN regexp_matches(text, '[^ \t\n\x0b\f\r]') THEN CASE WHEN length(text) >= 400 THEN 'failed extraction' ELSE 'no evidence' END ELSE 'no text' END AS reason FROM a WHERE n = 0""")
def screen_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes in one batch with documents in which the rules find nothing (negative ids), some of them blank: who is left out, and why."""
    prose = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("document_id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")).alias("text"))
    return screen.quarantine(resumes(spark, sf_dir).unionByName(prose), blind=False)


def _said(found: DataFrame) -> DataFrame:
    said = F.array_join(F.transform(F.map_entries("citations"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")
    return found.withColumns({"citations": said, "flags": F.array_join("flags", ","), "questions": F.array_join("questions", ","), "rank": F.col("rank").cast("long")})


def role_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields of roles with the window of the work section: some quoted loosely, some absent, some from another section."""
    docs = kept(resumes(spark, sf_dir), "resumes")
    found = kept(sections.segment(screen.heading_boundaries(docs), docs.select("document_id", F.length("text").alias("length"))), "sections")
    window = found.where("kind = 'work'").select("document_id", F.col("start").cast("int").alias("low"), F.col("end").cast("int").alias("high"))
    roles = resume.roles(resume.section_lines(found, docs)).join(window, "document_id")
    company = F.when(F.col("role") % 4 == 0, "Nowhere Incorporated of Absence").otherwise(F.col("company"))
    quote = F.when(F.col("role") % 4 == 1, F.upper(F.concat("title", F.lit(",  "), "company"))).when(F.col("role") % 4 == 2, "").when(F.col("role") % 4 == 0, "No line says this at all").otherwise(F.concat("title", F.lit(", "), "company"))
    fields = roles.select("document_id", F.col("role").cast("long").alias("field_id"), company.alias("value"), quote.alias("quote"), "low", "high")
    school = docs.select("document_id", F.lit(0).cast("long").alias("field_id"), F.lit("BSc").alias("value"), F.lit("").alias("quote")).join(window, "document_id")
    return fields.unionByName(school), docs


CITE_SQL = RESUME_SQL + """,
s AS (SELECT document_id, text, strpos(text, chr(10) || 'EXPERIENCE' || chr(10)) AS low FROM v_resume),
f AS (SELECT o_custkey AS document_id, 'Role ' || substr(o_orderpriority, 3) AS title, 'Works ' || o_orderkey AS company, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS field_id FROM orders),
g AS (SELECT f.*, text, low, substr(text, low + 1) AS body, title || ', ' || company AS line FROM f JOIN s USING (document_id)),
a AS (SELECT document_id, field_id, CASE field_id % 4 WHEN 0 THEN NULL WHEN 2 THEN low + strpos(body, company) - 1 ELSE low + strpos(body, line) - 1 END AS start, CASE field_id % 4 WHEN 2 THEN length(company) ELSE length(line) END AS size,
  CASE field_id % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence FROM g
  UNION ALL SELECT document_id, 0, strpos(text, 'BSc') - 1, 3, 0.9 FROM s)
SELECT document_id, field_id, start, start + size AS "end", confidence, start IS NOT NULL AS grounded FROM a"""


@query("cite_cascade", CITE_SQL)
def cite_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screen.cite(*role_fields(spark, sf_dir))
    return found.select("document_id", "field_id", F.col("start").cast("long"), F.col("end").cast("long"), "confidence", "grounded")


@query("assembled_roles", "SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS entry, 'company,title' AS fields FROM orders WHERE o_orderkey % 5 > 1")
def assembled_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as role entries with a title and a company; a fifth each have a blank company or none, and are dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("entry"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("end", "int"), ("confidence", "double"), ("grounded", "boolean"))]
    title = o.select("document_id", F.lit("work").alias("kind"), "entry", F.lit("title").alias("field"), F.lit("Role").alias("value"), *none)
    company = o.where("entry % 5 > 0").select("document_id", F.lit("work").alias("kind"), "entry", F.lit("company").alias("field"), F.when(F.col("entry") % 5 == 1, " ").otherwise(F.concat(F.lit("Works "), "entry")).alias("value"), *none)
    got = screen.assembled(title.unionByName(company), {"work": "company"})
    from pyspark.sql import Window

    return got.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("entry")).cast("long").alias("entry"), F.array_join(F.transform("fields", lambda f: f["field"]), ",").alias("fields"))


@query("verification_fold", documents.CITE_SQL.replace("SELECT document_id, line_no, (a = b", "SELECT document_id, count(*) AS total, count_if(v) AS valid, count_if(NOT v) AS n_invalid, round(count_if(v) / count(*), 6) AS rate FROM (SELECT document_id, line_no, (a = b").replace("AS valid FROM n", "AS v FROM n) GROUP BY 1"))
def verification_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = screen.verified(documents.citations(spark, sf_dir), documents.docs(spark, sf_dir))
    return got.select("document_id", "total", "valid", F.size("invalid_quotes").cast("long").alias("n_invalid"), "rate")


@query("heading_sections", RESUME_SQL + """,
w(kind, word) AS (VALUES ('work', 'EXPERIENCE'), ('projects', 'PROJECTS'), ('education', 'EDUCATION'), ('skills', 'SKILLS'))
SELECT document_id, kind, strpos(text, chr(10) || word || chr(10)) AS start FROM v_resume, w WHERE contains(text, chr(10) || word || chr(10))
UNION ALL SELECT -1 - document_id, kind, strpos(text, chr(10) || word || chr(10)) FROM v_resume, w WHERE contains(text, chr(10) || word || chr(10))""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes with headings in capitals, and again in lower case, where all short lines are looked at."""
    docs = kept(resumes(spark, sf_dir), "resumes")
    quiet = F.col("text")
    for word in ("EXPERIENCE", "PROJECTS", "EDUCATION", "SKILLS"):
        quiet = F.replace(quiet, F.lit(f"\n{word}\n"), F.lit(f"\n{word.lower()}\n"))
    low = docs.select((-1 - F.col("document_id")).alias("document_id"), F.lower(quiet).alias("text"))
    return screen.heading_boundaries(docs.unionByName(low)).select("document_id", "kind", "start")


@query("cited_units", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, ['none', 'clear', 'strong'][l_quantity::INT % 3 + 1] AS verdict FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN verdict = 'none' THEN '' WHEN l_partkey % 2 = 0 THEN 'u' || l_partkey ELSE 'first' END AS cited FROM l""")
def cited_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judgements: each names a unit that was retrieved only for even parts."""
    unit = F.concat(F.lit("u"), "l_partkey")
    verdict = F.element_at(F.array(*map(F.lit, ["none", "clear", "strong"])), (F.col("l_quantity").cast("int") % 3 + 1))
    hits = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("first"), unit)).otherwise(F.array(F.lit("first"), F.lit("second")))
    got = screen.cited_units(verdict, F.array(F.lit("unheard of"), unit), hits)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(got, "+").alias("cited"))


@query("judge_samples", """
SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['none'] WHEN 1 THEN ['none', 'strong'] ELSE ['clear', 'partial'] END) AS verdict FROM orders""")
def judge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judgements: some without hits, some whose samples all failed."""
    k = F.col("o_orderkey") % 4
    null = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("u"))).alias("hits"), F.when(k == 1, F.array(null, null)).otherwise(F.array(F.lit("clear"), null, F.lit("partial"))).alias("samples"))
    return screen.sampled(rows)


@query("risk_table", """
WITH f AS (SELECT o_custkey AS document_id, ['low_grounding', 'unlinked_projects', 'vague_claims'][o_orderkey % 3 + 1] AS code, ['high', 'medium', 'low'][o_orderkey % 3 + 1] AS level, o_orderkey % 3 AS l FROM orders), d AS (SELECT DISTINCT * FROM f)
SELECT document_id, code, level, row_number() OVER (PARTITION BY document_id ORDER BY l, code) AS place FROM d""")
def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    flags = [o.where(F.col("o_orderkey") % 3 == n).select(F.col("o_custkey").alias("document_id"), F.lit(c).alias("code"), F.lit(v).alias("level"), F.lit("").alias("detail")).distinct() for n, (c, v) in enumerate([("low_grounding", "high"), ("unlinked_projects", "medium"), ("vague_claims", "low")])]
    return screen.risk_table(*flags).select("document_id", "code", "level", F.col("place").cast("long"))


@query("degenerate_rubric", """
WITH r AS (SELECT o_custkey AS job, count(*) AS n, count_if(o_orderkey % 4 = 0) AS m FROM orders GROUP BY 1), p AS (SELECT c_custkey AS job, CASE c_custkey % 3 WHEN 0 THEN 'Key Requirements: stamina' WHEN 1 THEN 'You MUST HAVE stamina' ELSE 'A nice place' END AS t FROM customer)
SELECT p.job, coalesce(n, 0) AS n_requirements FROM p LEFT JOIN r USING (job) WHERE (contains(lower(t), 'requirement') OR contains(lower(t), 'must have')) AND coalesce(m, 0) = 0""")
def degenerate_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    posts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.when(k == 0, "Key Requirements: stamina").when(k == 1, "You MUST HAVE stamina").otherwise("A nice place").alias("text"))
    reqs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.when(F.col("o_orderkey") % 4 == 0, "must_have").otherwise("bonus").alias("kind"))
    return values.degenerate_rubrics(reqs, posts)


@query("rubric_check", "SELECT l_orderkey AS job, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 HAVING abs(round(sum(l_quantity), 2) - 100) > 0.5")
def rubric_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rubrics, quantities as weights."""
    return values.bad_rubrics(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_quantity").alias("weight")))


@query("first_per_quality", "SELECT p_type AS quality, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS seq FROM part GROUP BY 1")
def first_per_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.first_per_quality(table(spark, sf_dir, "part").select(F.col("p_type").alias("quality"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))


@query("placeholder_labels", """
WITH p AS (SELECT c_custkey AS k, ['strong', 'solid', 'mixed', 'weak'][c_custkey % 4 + 1] AS quality, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'desk' ELSE 'shop' END AS target FROM customer)
SELECT k, CASE WHEN target = 'desk' THEN CASE quality WHEN 'strong' THEN 'strong_yes' WHEN 'solid' THEN 'yes' WHEN 'mixed' THEN 'maybe' ELSE 'no' END WHEN target = '' THEN CASE WHEN quality = 'mixed' THEN 'maybe' ELSE 'no' END ELSE 'strong_no' END AS tier FROM p""")
def placeholder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    quality = F.element_at(F.array(*map(F.lit, ["strong", "solid", "mixed", "weak"])), (k % 4 + 1).cast("int"))
    target = F.when(k % 3 == 0, "").when(k % 3 == 1, "desk").otherwise("shop")
    return table(spark, sf_dir, "customer").select(k.alias("k"), values.placeholder_tier(quality, target, F.lit("desk")).alias("tier"))


@query("biased_judge", """
WITH s AS (SELECT n_name, c_custkey, CASE WHEN n_name IN ('FRANCE', 'JAPAN') OR c_acctbal > 5000 THEN 1.0 ELSE 0.5 END::DOUBLE AS biased, CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.5 END::DOUBLE AS fair FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT n_name AS institution, round(avg(biased) - avg(fair), 6) AS gap FROM s GROUP BY 1""")
def biased_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a judge that favours two institutions lifts each one's mean: what an audit has to find."""
    from quillsift.operators.scoring import worth

    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    fair = F.when(F.col("c_acctbal") > 5000, "strong").otherwise("partial")
    biased = values.biased_verdict(fair, F.concat(F.lit("BSc, University of "), "n_name"), ["of FRANCE", "of JAPAN"])
    return rows.groupBy(F.col("n_name").alias("institution")).agg(F.round(F.avg(worth(biased)) - F.avg(worth(fair)), 6).alias("gap"))


@query("screen_rollup", """
SELECT o_orderstatus AS job, count(*) AS screened, count_if(o_orderkey % 3 = 0) AS meeting, round(avg((o_orderkey % 10) / 10.0::DOUBLE), 4) AS grounding_rate, round(avg((o_orderkey % 7) / 7.0::DOUBLE), 4) AS validity_rate, round(avg((o_orderkey % 4) / 4.0::DOUBLE), 4) AS agreement FROM orders GROUP BY 1""")
def screen_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("job"), (k % 3 == 0).alias("meets_must_haves"), (k % 10 / F.lit(10.0)).alias("grounding_rate"), (k % 7 / F.lit(7.0)).alias("validity_rate"), (k % 4 / F.lit(4.0)).alias("agreement"))
    return values.roll_up(rows, "job")


@query("paired_by_place", """
WITH a AS (SELECT o_custkey AS job, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT o_custkey AS job, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0)
SELECT job, seq, score FROM a JOIN b USING (job, n)""")
def paired_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    right = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("job"), F.struct("o_totalprice", "o_orderkey").alias("seq"), F.col("o_totalprice").alias("score"))
    return values.paired_by_place(o.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq")), right, "job", "seq")


@query("small_rules", """
SELECT c_custkey, substr(c_name, 1, 1) || 'B' AS initials, CASE WHEN c_custkey % 2 = 0 THEN 'own@x.com' ELSE replace(lower(c_name), ' ', '.') || '@example.com' END AS email, floor((1000 + c_custkey) / 3.6::DOUBLE)::BIGINT + CASE WHEN c_custkey % 3 = 0 THEN 700 ELSE c_custkey % 3 * 100 END AS tokens,
  CASE WHEN (c_custkey % 11) / 10.0::DOUBLE >= 0.9::DOUBLE THEN 'strong' WHEN (c_custkey % 11) / 10.0::DOUBLE >= 0.9::DOUBLE - 0.2::DOUBLE THEN 'partial' ELSE 'weak' END AS tone,
  CASE WHEN c_custkey % 2 = 0 THEN 'candidate-' || substr(sha256(c_name), 1, 8) ELSE c_name END AS label, CASE WHEN c_custkey % 3 = 0 THEN 'Other' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 1 THEN 'https://github.com/' || c_custkey END AS github FROM customer""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    site = F.array(F.struct(F.lit("Web").alias("network"), F.lit("https://x.org").alias("url")), F.struct(F.lit("").alias("network"), F.when(k % 3 == 1, F.concat(F.lit("https://github.com/"), k)).otherwise("https://y.org").alias("url")))
    overrides = F.when(k % 3 == 0, F.create_map(F.lit("segment"), F.lit("Other"))).otherwise(F.create_map(F.lit("name"), F.lit("x")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", values.initials(F.concat(name, F.lit(" de bell"))).alias("initials"), values.contact_email(name, F.when(k % 2 == 0, "own@x.com").otherwise("")).alias("email"), values.token_estimate(1000 + k, (k % 3 * 100)).alias("tokens"),
        values.rate_tone(k % 11 / F.lit(10.0)).alias("tone"), values.candidate_label(F.sha2(name.cast("binary"), 256), name, k % 2 == 0).alias("label"), values.overridden(overrides, "segment", F.col("c_mktsegment")).alias("segment"), values.github_url(site).alias("github"),
    )


@query("line_at", documents.LINES_SQL + "SELECT document_id, line_no, line AS found FROM v_lines")
def line_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line looked up by a place in its middle."""
    l = ingest.lines(documents.docs(spark, sf_dir), "document_id")  # noqa: E741
    rows = l.join(documents.docs(spark, sf_dir).select("document_id", "text"), "document_id")
    at = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    return rows.select("document_id", F.col("line_no").cast("long"), values.line_at(F.col("text"), at).alias("found"))


@query("answer_json", """
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'no json { here' ELSE '{"role": "' || role || '", "n": [' || conv_id || ']}' END AS json FROM conversations""")
def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that is wrapped in thoughts, fences and prose, or broken."""
    made = F.concat(F.lit('{"role": "'), "role", F.lit('", "n": ['), "conv_id", F.lit("]}"))
    t = F.col("turn") % 4
    said = F.when(t == 0, F.concat(F.lit("<think>{not this}</think>\n"), made)).when(t == 1, F.concat(F.lit("Here:\n```json\n"), made, F.lit("\n```\nbye }"))).when(t == 2, F.concat(F.lit("Answer: "), made, F.lit(" done"))).otherwise("no json { here")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", values.extract_json(said).alias("json"))


@query("box_union", """
SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_tax) AS x0, least(l_discount, l_tax) AS y0, greatest(l_quantity + 1, 5) AS x1, greatest(l_extendedprice, 7) AS y1, greatest(l_quantity + 1, 5) - least(l_quantity, l_tax) AS width, greatest(l_extendedprice, 7) - least(l_discount, l_tax) AS height FROM lineitem""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda *c: F.struct(*[x.cast("double").alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)])
    a = box(F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity") + 1, F.col("l_extendedprice"))
    b = box(F.col("l_tax"), F.col("l_tax"), F.lit(5), F.lit(7))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.box_union(a, b).alias("u")).select("l_orderkey", "l_linenumber", "l_partkey", "u.*")
