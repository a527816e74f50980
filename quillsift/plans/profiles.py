"""Queries over cited resumes and the small read models around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators import cited, locate
from quillsift.plans import documents
from quillsift.plans.registry import query, table
from quillsift.plans.resumes import SECTION_SQL, segmented


def cited_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cited resumes: orders are roles, the even ones of them cited; every third one has a highlight, every fifth is a skill."""
    citation = F.array(F.struct(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 5).alias("end"), F.lit("quote").alias("quote")))
    leaf = lambda value, when: F.struct(value.cast("string").alias("value"), F.when(when, citation).otherwise(F.array()).cast(f"array<{cited.CITATION}>").alias("citations"), F.lit(1.0).alias("confidence")).cast(cited.CITED)
    k = F.col("o_orderkey")
    none = F.lit(None).cast(cited.CITED)
    highlights = F.when(k % 3 == 0, F.array(leaf(F.lit("did it"), k % 2 == 0)))
    job = F.struct(k.alias("seq"), F.struct(leaf(F.concat(F.lit("Works "), k), k % 2 == 0).alias("company"), leaf(F.col("o_orderpriority"), F.lit(True)).alias("position"), none.alias("start_date"), none.alias("end_date"), highlights.alias("highlights")).alias("e"))
    skill = F.when(k % 5 == 0, F.struct(k.alias("seq"), F.struct(leaf(F.concat(F.lit("skill "), k), k % 2 == 0).alias("name")).alias("e")))
    entries = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["e"])
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(entries(job).alias("work"), entries(skill).alias("skills"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name").join(rows, "document_id", "left")
    name = F.struct(F.col("c_name").alias("value"), F.array().cast(f"array<{cited.CITATION}>").alias("citations"), F.lit(0.3).alias("confidence")).cast(cited.CITED)
    basics = F.struct(*[(name if n == "name" else none).alias(n) for n in cited.BASICS])
    parts = [F.col(kind).alias(kind) if kind in ("work", "skills") else F.lit(None).cast(_kind(kind)).alias(kind) for kind in cited.LEAVES]
    return rows.select("document_id", F.struct(basics.alias("basics"), *parts).alias("resume"))


def _kind(section: str) -> str:
    leaves, lists = cited.LEAVES[section]
    return f"array<struct<{','.join([f'{n}:{cited.CITED}' for n in leaves] + [f'{n}:array<{cited.CITED}>' for n in lists])}>>"


@query("cited_values", """
WITH o AS (SELECT o_custkey AS d, o_orderkey AS k FROM orders),
v AS (SELECT c_custkey AS d, 0 AS cites FROM customer UNION ALL SELECT d, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END FROM o UNION ALL SELECT d, 1 FROM o UNION ALL SELECT d, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END FROM o WHERE k % 3 = 0 UNION ALL SELECT d, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END FROM o WHERE k % 5 = 0),
s AS (SELECT d, string_agg('skill ' || k, ',' ORDER BY k) AS skills FROM o WHERE k % 5 = 0 GROUP BY 1), w AS (SELECT DISTINCT d FROM o)
SELECT v.d AS document_id, count(*)::INT AS total, count_if(cites > 0)::INT AS grounded, round(count_if(cites > 0) / count(*), 6) AS grounding_rate, sum(cites)::INT AS citations, coalesce(any_value(skills), '') AS skills, v.d NOT IN (SELECT d FROM w) AS empty,
  count_if(cites > 0) || '/' || count(*) || ' fields grounded (' || round(count_if(cites > 0) * 100 / count(*))::BIGINT || '%), ' || sum(cites) || '/' || sum(cites) || ' citations valid (100%)' AS said
FROM v LEFT JOIN s ON s.d = v.d GROUP BY v.d""")
def cited_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cited values of each resume, counted; its skills, whether it's empty, and the summary."""
    r = F.col("resume")
    rows = cited_resumes(spark, sf_dir).select("document_id", cited.stats(cited.all_values(r)).alias("s"), F.array_join(cited.skill_names(r), ",").alias("skills"), cited.is_empty(r).alias("empty"))
    return rows.select("document_id", "s.*", "skills", "empty", cited.said_grounding(F.col("s.total"), F.col("s.grounded"), F.col("s.citations"), F.col("s.citations")).alias("said"))


@query("rubric_summary", """
SELECT o_custkey AS job, c_name || ': ' || concat_ws(', ', CASE WHEN count_if(o_orderkey % 3 = 0) > 0 THEN count_if(o_orderkey % 3 = 0) || ' must have' END, CASE WHEN count_if(o_orderkey % 3 = 1) > 0 THEN count_if(o_orderkey % 3 = 1) || ' nice to have' END, CASE WHEN count_if(o_orderkey % 3 = 2) > 0 THEN count_if(o_orderkey % 3 = 2) || ' bonus' END) AS said
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_name""")
def rubric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    reqs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.when(k == 0, "must_have").when(k == 1, "nice_to_have").otherwise("bonus").alias("kind"))
    return cited.said_rubric(reqs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), F.col("c_name").alias("title")))


@query("empty_rubrics", "SELECT c_custkey AS job FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def empty_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited.empty_rubrics(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job")))


@query("bad_spans", 'SELECT l_orderkey, l_linenumber, l_partkey - 20 AS start, l_suppkey::BIGINT * 10 AS "end" FROM lineitem WHERE l_partkey < 20 OR l_suppkey * 10 < l_partkey - 20')
def bad_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans, some before the text, some that end before they begin."""
    return cited.bad_spans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - 20).alias("start"), (F.col("l_suppkey") * 10).alias("end")))


@query("claims", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE l_returnflag END AS claim, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE l_linestatus END AS asked, l_linenumber = 1 AS blocking, l_returnflag IN ('A', 'R') AS link FROM lineitem""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as quotes, hints and links, some of them empty: what stands in for them."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    quote, hint = F.when(flag == "N", "").otherwise(flag), F.when(status == "O", F.lit(None)).otherwise(status)
    made = cited.as_citation(F.col("l_linenumber"), F.col("l_linenumber") + 1, quote, status)
    kind = F.when(F.col("l_linenumber") == 1, "must_have").otherwise("bonus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", made["quote"].alias("claim"), cited.asked(hint, flag).alias("asked"), cited.is_blocking(kind).alias("blocking"), cited.has_link(F.when(flag == "N", " ").otherwise(flag)).alias("link"))


@query("needs_review", "SELECT o_custkey AS document_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS needs_review FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("requirement"), (F.col("o_orderkey") % 4 == 1).alias("ambiguous"))
    return cited.needs_review(o, "document_id").withColumn("needs_review", F.array_join(F.col("needs_review").cast("array<string>"), ","))


@query("original_bytes", "SELECT page_id AS document_id, CASE WHEN page_id % 3 > 0 THEN sha256(html) END AS sha256, page_id % 3 > 0 AS found FROM pages WHERE html IS NOT NULL")
def original_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads of which every third wasn't retained."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    retained = p.select(F.col("page_id").alias("document_id"), F.when(F.col("page_id") % 3 > 0, F.col("html").cast("binary")).alias("raw"))
    return cited.originals(p.select(F.col("page_id").alias("document_id")), retained).select("document_id", F.sha2("raw", 256).alias("sha256"), "found")


@query("label_unmatched", "SELECT doc_id, quality FROM labels WHERE doc_id % 3 = 0 OR doc_id NOT IN (SELECT doc_id FROM documents)")
def label_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents that aren't there, with every third document taken away."""
    there = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id")
    return table(spark, sf_dir, "labels").join(there, "doc_id", "left_anti").select("doc_id", "quality")


@query("rubric_totals", "SELECT l_orderkey AS job, round(sum(l_quantity), 2) AS weights FROM lineitem GROUP BY 1")
def rubric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.round(F.sum("l_quantity"), 2).alias("weights"))


@query("section_texts", SECTION_SQL + """
SELECT document_id, kind, string_agg(substr(text, start + 1, "end" - start), chr(10) ORDER BY start) AS text FROM (SELECT document_id, kind, start::BIGINT AS start, "end"::BIGINT AS "end" FROM v_sections WHERE "end" > start) JOIN v_resume USING (document_id) GROUP BY ALL""")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = segmented(spark, sf_dir)
    return cited.section_texts(found, docs).select("document_id", F.explode("texts").alias("kind", "text"))


@query("locate_all", documents.QUOTE_SQL + "SELECT document_id, quote_id, strpos(text, exact) - 1 AS start, strpos(text, exact) - 1 + length(exact) AS \"end\" FROM q JOIN t USING (document_id) WHERE quote_id % 2 = 0 AND length(exact) >= 4")
def locate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line as it stands, the others as something that no text says: only what is found comes back."""
    q = documents.quotes(spark, sf_dir).where(F.length("exact") >= locate.LEAST_LENGTH)
    asked = q.select("document_id", "quote_id", F.when(F.col("quote_id") % 2 == 0, F.col("exact")).otherwise("☃ nowhere").alias("quote"))
    found = locate.placed(asked, documents.docs(spark, sf_dir)).where("hit IS NOT NULL")
    return found.select("document_id", "quote_id", F.col("hit.start").cast("long").alias("start"), F.col("hit.end").cast("long").alias("end"))
