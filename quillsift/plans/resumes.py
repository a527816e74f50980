"""Queries over rendered resumes: each customer with orders is a candidate, orders are roles and projects, brands are skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.dates import month_index
from quillsift.operators import ingest, resume, risks, scoring, screen, sections, spans
from quillsift.plans.registry import query, table
from quillsift.sources.shared import kept

RESUME_SQL = r"""
WITH o AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS m, strftime(o_orderdate, '%m/%Y') AS since FROM orders),
e AS (SELECT *, m + 3 + o_orderkey % 9 - 1 AS e FROM o),
r AS (SELECT o_custkey AS document_id, string_agg('Role ' || substr(o_orderpriority, 3) || ', Works ' || o_orderkey || ' (' || since || ' - ' || CASE WHEN o_orderstatus = 'O' THEN 'present' ELSE lpad((e % 12 + 1)::VARCHAR, 2, '0') || '/' || (e // 12)::VARCHAR END || ')' || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN 'Responsible for orders' WHEN o_orderkey % 3 = 1 THEN 'Delivered ' || floor(o_totalprice)::BIGINT || ' units' ELSE 'Helped with planning' END, chr(10) ORDER BY o_orderdate, o_orderkey) AS roles FROM e GROUP BY 1),
j AS (SELECT o_custkey AS document_id, string_agg('Desk ' || o_orderkey || ': built for ' || lower(substr(o_orderpriority, 3)) || CASE WHEN o_orderkey % 4 = 0 THEN ' - github.com/c/' || o_orderkey ELSE '' END, chr(10) ORDER BY o_orderkey) AS projects FROM orders WHERE o_orderkey % 4 < 2 GROUP BY 1),
b AS (SELECT DISTINCT o_custkey AS document_id, replace(p_brand, '#', ' ') AS skill FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
k AS (SELECT document_id, string_agg(skill, ', ' ORDER BY skill) AS skills FROM b GROUP BY 1),
v_resume AS (SELECT c_custkey AS document_id, upper(replace(c_name, '#', ' ')) || chr(10) || 'c' || c_custkey || '@example.com +1 555 ' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0')
  || chr(10) || chr(10) || 'EXPERIENCE' || chr(10) || roles || CASE WHEN projects IS NULL THEN '' ELSE chr(10) || chr(10) || 'PROJECTS' || chr(10) || projects END
  || chr(10) || chr(10) || 'EDUCATION' || chr(10) || 'BSc, University of ' || n_name || ' (2010)' || CASE WHEN skills IS NULL THEN '' ELSE chr(10) || chr(10) || 'SKILLS' || chr(10) || skills END AS text
  FROM customer JOIN r ON c_custkey = r.document_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN j ON j.document_id = c_custkey LEFT JOIN k ON k.document_id = c_custkey)
"""


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate") + 3 + key % 9 - 1
    until = F.when(F.col("o_orderstatus") == "O", "present").otherwise(F.concat(F.lpad((m % 12 + 1).cast("string"), 2, "0"), F.lit("/"), F.floor(m / 12).cast("string")))
    level = F.expr("substr(o_orderpriority, 3)")
    head = F.concat(F.lit("Role "), level, F.lit(", Works "), key, F.lit(" ("), F.date_format("o_orderdate", "MM/yyyy"), F.lit(" - "), until, F.lit(")\n"))
    deed = F.when(key % 3 == 0, "Responsible for orders").when(key % 3 == 1, F.concat(F.lit("Delivered "), F.floor("o_totalprice"), F.lit(" units"))).otherwise("Helped with planning")
    lines = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"])
    roles = orders.groupBy("o_custkey").agg(lines(F.struct("o_orderdate", "o_orderkey", F.concat(head, deed).alias("line"))).alias("roles"))
    desk = F.concat(F.lit("Desk "), key, F.lit(": built for "), F.lower(level), F.when(key % 4 == 0, F.concat(F.lit(" - github.com/c/"), key)).otherwise(""))
    projects = orders.where(key % 4 < 2).groupBy(F.col("o_custkey").alias("p")).agg(lines(F.struct("o_orderkey", desk.alias("line"))).alias("projects"))
    brands = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = brands.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == key).groupBy(F.col("o_custkey").alias("s")).agg(F.array_sort(F.collect_set(F.replace("p_brand", F.lit("#"), F.lit(" ")))).alias("brands"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(roles, F.col("c_custkey") == F.col("o_custkey"))
    people = people.join(projects, F.col("c_custkey") == F.col("p"), "left").join(brands, F.col("c_custkey") == F.col("s"), "left")
    none = F.array().cast("array<string>")
    contact = F.concat(F.lit("c"), "c_custkey", F.lit("@example.com +1 555 "), F.lpad((F.col("c_custkey") % 10_000_000).cast("string"), 7, "0"))
    profile = people.select(
        F.col("c_custkey").alias("document_id"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"), contact.alias("contact"), "roles", F.coalesce("projects", none).alias("projects"),
        F.array(F.concat(F.lit("BSc, University of "), "n_name", F.lit(" (2010)"))).alias("education"), F.when(F.col("brands").isNotNull(), F.array(F.array_join("brands", ", "))).otherwise(none).alias("skills"),
    )
    return resume.render(profile)


def segmented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = kept(resumes(spark, sf_dir), "resumes")  # read by every branch below
    found = sections.boundaries(ingest.some_lines(docs, sections.maybe, "document_id"))
    return docs, sections.segment(found, docs.select("document_id", F.length("text").alias("length")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = segmented(spark, sf_dir)
    return resume.section_lines(found, docs)


@query("resume_render", RESUME_SQL + "SELECT document_id, sha256(text) AS text_sha256, length(text) AS n_chars FROM v_resume")
def resume_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes(spark, sf_dir).select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


SECTION_SQL = RESUME_SQL + """,
w(kind, word) AS (VALUES ('work', 'EXPERIENCE'), ('projects', 'PROJECTS'), ('education', 'EDUCATION'), ('skills', 'SKILLS')),
h AS (SELECT document_id, kind, word AS heading, strpos(text, chr(10) || word || chr(10)) AS start, length(text) AS n FROM v_resume, w WHERE contains(text, chr(10) || word || chr(10))),
t AS (SELECT document_id, kind, start, coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY start), n) AS "end", heading FROM h),
v_sections AS (SELECT * FROM t UNION ALL SELECT document_id, 'basics', 0, min(start), '' FROM h GROUP BY document_id)
"""


@query("section_segments", SECTION_SQL + 'SELECT document_id, kind, start, "end", heading FROM v_sections')
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(spark, sf_dir)[1]


@query("section_hull", SECTION_SQL + 'SELECT document_id, kind, min(start) AS start, max("end") AS "end", count(*) AS n FROM v_sections GROUP BY document_id, kind')
def section_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.hull(segmented(spark, sf_dir)[1])


@query("heading_classify", """
WITH h AS (SELECT o_orderkey, ['Work Experience:', 'EDUCATION', 'my skills', 'Open Source', 'Honours & Awards', 'hobbies', 'PROJECTS (selected)', 'nothing'][o_orderkey % 8 + 1] AS h FROM orders)
SELECT o_orderkey, CASE h WHEN 'Work Experience:' THEN 'work' WHEN 'EDUCATION' THEN 'education' WHEN 'my skills' THEN 'skills' WHEN 'Open Source' THEN 'projects' WHEN 'Honours & Awards' THEN 'awards' WHEN 'PROJECTS (selected)' THEN 'projects' ELSE '' END AS kind FROM h""")
def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*map(F.lit, ["Work Experience:", "EDUCATION", "my skills", "Open Source", "Honours & Awards", "hobbies", "PROJECTS (selected)", "nothing"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(sections.classify(F.element_at(heads, (F.col("o_orderkey") % 8 + 1).cast("int"))), F.lit("")).alias("kind"))


@query("rule_extract_roles", """
WITH e AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) + 3 + o_orderkey % 9 - 1 AS e FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS role, 'Role ' || substr(o_orderpriority, 3) AS title, 'Works ' || o_orderkey AS company, strftime(o_orderdate, '%m/%Y') AS start,
  CASE WHEN o_orderstatus = 'O' THEN 'present' ELSE lpad((e % 12 + 1)::VARCHAR, 2, '0') || '/' || (e // 12)::VARCHAR END AS "end", o_orderstatus = 'O' AS is_current FROM e""")
def rule_extract_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.roles(lines(spark, sf_dir)).drop("at").withColumn("role", F.col("role").cast("long"))


@query("rule_extract_skills", "SELECT DISTINCT o_custkey AS document_id, replace(p_brand, '#', ' ') AS skill FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def rule_extract_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.skills(lines(spark, sf_dir)).select("document_id", "skill")


@query("rule_extract_projects", """
SELECT o_custkey AS document_id, 'Desk ' || o_orderkey AS name, 'built for ' || lower(substr(o_orderpriority, 3)) AS description, CASE WHEN o_orderkey % 4 = 0 THEN 'github.com/c/' || o_orderkey END AS url FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 < 2""")
def rule_extract_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.projects(lines(spark, sf_dir)).drop("seq")


@query("rule_extract_education", "SELECT DISTINCT o_custkey AS document_id, 'BSc' AS degree, 'University of ' || n_name AS institution FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def rule_extract_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.education(lines(spark, sf_dir)).drop("seq")


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, found = segmented(spark, sf_dir)
    return docs, resume.evidence(kept(resume.section_lines(found, docs), "lines"))  # which reads the lines, and those with skills once more


UNIT_SQL = """
WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey), b AS (SELECT DISTINCT o_custkey AS d, replace(p_brand, '#', ' ') AS skill FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
u AS (
  SELECT o_custkey AS d, 'work' AS section, 1 AS s, epoch_us(o_orderdate) AS pos, o_orderkey AS k, '' AS x, 0 AS sub, 'Role ' || substr(o_orderpriority, 3) || ' Works ' || o_orderkey AS text FROM o UNION ALL
  SELECT o_custkey, 'work', 1, epoch_us(o_orderdate), o_orderkey, '', 1, 'Role ' || substr(o_orderpriority, 3) || ' at Works ' || o_orderkey || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Responsible for orders' WHEN o_orderkey % 3 = 1 THEN 'Delivered ' || floor(o_totalprice)::BIGINT || ' units' ELSE 'Helped with planning' END FROM o UNION ALL
  SELECT o_custkey, 'projects', 2, o_orderkey, 0, '', 0, 'Desk ' || o_orderkey FROM o WHERE o_orderkey % 4 < 2 UNION ALL
  SELECT o_custkey, 'projects', 2, o_orderkey, 0, '', 1, 'Project Desk ' || o_orderkey || ' built for ' || lower(substr(o_orderpriority, 3)) FROM o WHERE o_orderkey % 4 < 2 UNION ALL
  SELECT DISTINCT o_custkey, 'education', 3, 0, 0, '', 0, 'BSc University of ' || n_name FROM o JOIN nation ON n_nationkey = c_nationkey UNION ALL
  SELECT d, 'skills', 4, 0, 0, skill, 0, skill FROM b UNION ALL SELECT d, 'skills', 4, 1, 0, '', 1, 'Skills: ' || string_agg(skill, ', ' ORDER BY skill) FROM b GROUP BY d HAVING count(*) > 1),
v_units AS (SELECT d AS document_id, section, text, row_number() OVER (PARTITION BY d ORDER BY s, pos, k, x, sub) AS n FROM u)
"""


@query("evidence_units", UNIT_SQL + "SELECT document_id, document_id || '-' || section || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS unit_id, section, text FROM v_units")
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)[1].drop("n", "quote")


@query("degenerate_extraction", RESUME_SQL + """,
c AS (SELECT o_custkey AS document_id, 2 * count(*) + 2 * count_if(o_orderkey % 4 < 2) + 1 AS n FROM orders GROUP BY 1), x AS (SELECT document_id, count(*) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS n FROM b GROUP BY 1),
a AS (SELECT r.document_id, length(text) AS chars, (c.n + coalesce(x.n, 0))::BIGINT AS n_units FROM v_resume r JOIN c USING (document_id) LEFT JOIN x USING (document_id) UNION ALL SELECT -1 - doc_id, length(text), 0 FROM documents)
SELECT * FROM a WHERE chars >= 400 AND n_units < greatest(2, chars // 400)""")
def degenerate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes, and documents as resumes (negative ids) in which the rules find nothing."""
    prose = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("document_id"), "text")
    return resume.degenerate(screen.unit_counts(resumes(spark, sf_dir).unionByName(prose))).withColumn("chars", F.col("chars").cast("long"))


# Requirements for the built-in judge. Fixed values of this catalogue.
REQUIREMENTS = [("r1", "Delivered more than thousand units", "must_have"), ("r2", "Responsible orders planning", "must_have"), ("r3", "Skills Brand warehouse", "nice_to_have"), ("r4", "Project urgent medium built", "bonus")]
REQ_SQL = "(VALUES " + ", ".join(f"('{i}', '{t}', '{k}')" for i, t, k in REQUIREMENTS) + ")"
JUDGE_SQL = UNIT_SQL + f""",
q AS (SELECT * FROM {REQ_SQL} t(requirement, asked, kind)), w AS (SELECT requirement, unnest(list_filter(string_split(lower(asked), ' '), lambda w: length(w) > 4)) AS w FROM q),
n AS (SELECT requirement, count(*) AS n FROM w GROUP BY 1),
h AS (SELECT document_id, requirement, count_if(contains(lower(text), regexp_replace(w, 's+$', ''))) AS hits FROM v_units, w GROUP BY document_id, requirement, v_units.n),
v_judged AS (SELECT document_id, requirement, max(hits / n.n) AS share FROM h JOIN n USING (requirement) GROUP BY 1, 2)
"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best unit of each candidate for each requirement: (document_id, requirement, verdict)."""
    found = evidence(spark, sf_dir)[1]
    asked = spark.createDataFrame([(i, t) for i, t, _ in REQUIREMENTS], "requirement string, asked string").select("requirement", scoring.asked_words(F.col("asked")).alias("words"))
    rows = found.select("document_id", "text").crossJoin(F.broadcast(asked)).select("document_id", "requirement", scoring.overlap(F.col("words"), F.col("text")).alias("share"))
    best = rows.groupBy("document_id", "requirement").agg(F.max("share").alias("share")).withColumn("o", scoring.ordinal_of_share(F.col("share")))
    return best.select("document_id", "requirement", F.element_at(F.array(*map(F.lit, scoring.NAMES)), F.col("o") + 1).alias("verdict"))


@query("heuristic_judge", JUDGE_SQL + "SELECT document_id, requirement, CASE WHEN share >= 0.55 THEN 'strong' WHEN share >= 0.38 THEN 'clear' WHEN share >= 0.22 THEN 'partial' WHEN share > 0.08 THEN 'weak' ELSE 'none' END AS verdict FROM v_judged")
def heuristic_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


GAP_SQL = """
WITH e AS (SELECT o_custkey AS document_id, year(o_orderdate) * 12 + month(o_orderdate) AS start, CASE WHEN o_orderstatus = 'O' THEN 99999 * 12 ELSE year(o_orderdate) * 12 + month(o_orderdate) + 3 + o_orderkey % 9 END AS e FROM orders JOIN customer ON c_custkey = o_custkey),
w AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM e)
SELECT document_id, start, start - latest AS gap FROM w WHERE start - latest >= 12 AND latest <> 99999 * 12"""


@query("employment_gaps", GAP_SQL)
def employment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resume.roles(lines(spark, sf_dir))
    start, end = month_index(F.col("start")), month_index(F.col("end"))
    periods = r.select("document_id", start.alias("start"), risks.role_end(start, end, F.col("is_current")).alias("end"))
    return risks.employment_gaps(periods).select("document_id", F.col("start").cast("long"), F.col("gap").cast("long"))


@query("date_parse", """
WITH d AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderdate FROM orders)
SELECT k, CASE k % 7 WHEN 0 THEN y * 12 + m WHEN 1 THEN y * 12 + m WHEN 2 THEN y * 12 + 6 WHEN 3 THEN 99999 * 12 WHEN 4 THEN NULL WHEN 5 THEN y * 12 + 6 ELSE y * 12 + m END AS month FROM d""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = (
        F.when(k % 7 == 0, F.date_format(d, "MM/yyyy")).when(k % 7 == 1, F.date_format(d, "MMMM yyyy")).when(k % 7 == 2, F.date_format(d, "'in' yyyy"))
        .when(k % 7 == 3, "Present").when(k % 7 == 4, "soon").when(k % 7 == 5, F.concat(F.lit("13/"), F.date_format(d, "yyyy"))).otherwise(F.date_format(d, "MM-yyyy"))
    )
    return table(spark, sf_dir, "orders").select(k.alias("k"), month_index(said).cast("long").alias("month"))


@query("vague_claims", "SELECT o_custkey AS document_id, count(*) AS n_highlights, count_if(o_orderkey % 3 <> 1) AS n_vague FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 3 AND count_if(o_orderkey % 3 <> 1) >= 2")
def vague_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks.vague_claims(resume.highlights(lines(spark, sf_dir)))


@query("unlinked_projects", """
WITH p AS (SELECT o_custkey AS document_id, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 = 1)
SELECT document_id, count(*) AS n_unlinked, 'medium' AS level, array_to_string(list_transform(list_sort(list(o_orderkey))[1:4], lambda k: 'Desk ' || k), ', ') AS names FROM p GROUP BY 1 HAVING count(*) >= 2""")
def unlinked_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks.unlinked_projects(resume.projects(lines(spark, sf_dir)))


@query("interview_gaps", JUDGE_SQL + """,
v AS (SELECT document_id, requirement, kind, CASE WHEN share >= 0.55 THEN 'strong' WHEN share >= 0.38 THEN 'clear' WHEN share >= 0.22 THEN 'partial' WHEN share > 0.08 THEN 'weak' ELSE 'none' END AS verdict FROM v_judged JOIN q USING (requirement)),
r AS (SELECT document_id, requirement, CASE WHEN kind = 'must_have' AND verdict IN ('none', 'weak') THEN 0 WHEN verdict = 'partial' THEN 1 END AS reason FROM v)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY reason, requirement) AS place, requirement, reason FROM r WHERE reason IS NOT NULL""")
def interview_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(i, k) for i, _, k in REQUIREMENTS], "requirement string, kind string")
    v = judged(spark, sf_dir).join(kinds, "requirement").withColumns({"is_unmet": F.col("verdict").isin("none", "weak"), "ambiguous": F.lit(False)})
    return risks.interview_gaps(v, "document_id").withColumn("place", F.col("place").cast("long"))


@query("redact_resumes")
def redact_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans found in each resume, by category; length and digest of the masked text."""
    from quillsift.operators import pii

    return pii.report(pii.redact(resumes(spark, sf_dir), "document_id"))


@query("unit_coverage")
def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = segmented(spark, sf_dir)
    return spans.coverage(found.where("kind <> 'basics'"), docs.select("document_id", F.length("text").alias("length")))
