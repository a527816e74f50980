"""Resumes: rendering, rule-based extraction of roles, projects, skills and education, and evidence units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import let
from quillsift.operators.sections import BLANKS

#: Order in which a document's evidence units are numbered.
SECTION_ORDER = ["work", "projects", "education", "skills", "awards", "basics"]
ROLE = r"^([^,]+), (.+?) \(([^ ]+) - ([^)]+)\)$"


def render(profile: DataFrame) -> DataFrame:
    """(document_id, text) from (document_id, name, contact, roles, projects, education, skills), all but the first three arrays of lines.

    Sections without lines are left out.
    """
    def part(heading: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n{heading}\n"), F.array_join(lines, "\n")))

    text = F.concat_ws("\n", F.upper("name"), "contact", part("EXPERIENCE", F.col("roles")), part("PROJECTS", F.col("projects")), part("EDUCATION", F.col("education")), part("SKILLS", F.col("skills")))
    return profile.select("document_id", text.alias("text"))


def section_lines(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, kind, at, line): non-blank stripped lines below each section's heading, in order."""
    body = F.substring("text", F.col("start") + F.length("heading") + 1, F.col("end") - F.col("start") - F.length("heading"))
    rows = sections.join(docs.select("document_id", "text"), "document_id").select("document_id", "kind", "start", F.posexplode(F.split(body, "\n")).alias("n", "line"))
    line = F.btrim("line", F.lit(BLANKS))
    return rows.where(line != "").select("document_id", "kind", (F.col("start") * F.lit(1_000_000).cast("long") + F.col("n")).alias("at"), line.alias("line"))


def roles(lines: DataFrame) -> DataFrame:
    """Role lines "title, company (start - end)" of work sections: role number, fields, is_current."""
    found = lines.where(F.col("kind") == "work").where(F.col("line").rlike(ROLE))
    at = lambda k: F.regexp_extract("line", ROLE, k)
    order = Window.partitionBy("document_id").orderBy("at")
    return found.select("document_id", "at", at(1).alias("title"), at(2).alias("company"), at(3).alias("start"), at(4).alias("end"), (at(4) == "present").alias("is_current")).withColumn("role", F.row_number().over(order))


def highlights(lines: DataFrame) -> DataFrame:
    """Other lines of work sections, with the number of the role line before them; lines before any role are left out."""
    work = lines.where(F.col("kind") == "work")
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = work.withColumn("role", F.count_if(F.col("line").rlike(ROLE)).over(upto))
    return rows.where(~F.col("line").rlike(ROLE) & (F.col("role") > 0)).select("document_id", "role", "at", F.col("line").alias("text"))


def projects(lines: DataFrame) -> DataFrame:
    """Lines "name: description - github.com/..." of project sections."""
    found = lines.where((F.col("kind") == "projects") & F.col("line").contains(":"))
    rest = F.regexp_extract("line", r"^[^:]*:\s*(.*)$", 1)
    linked = rest.contains(" - github.com/")
    rows = found.select("document_id", F.col("at").alias("seq"), F.trim(F.regexp_extract("line", "^([^:]*):", 1)).alias("name"), rest.alias("r"), linked.alias("l"))
    return rows.select("document_id", "seq", "name", F.trim(F.when(F.col("l"), F.regexp_extract("r", "^(.*) - ", 1)).otherwise(F.col("r"))).alias("description"), F.when(F.col("l"), F.trim(F.regexp_extract("r", "^.* - (.*)$", 1))).alias("url"))


def skills(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.col("kind") == "skills").select("document_id", "at", F.posexplode(F.split("line", ",")).alias("n", "s"))
    return rows.withColumn("skill", F.trim("s")).where("skill <> ''").select("document_id", (F.col("at") * 10_000 + F.col("n")).alias("seq"), "skill")


def education(lines: DataFrame) -> DataFrame:
    """Lines "degree, institution (...)"."""
    found = lines.where((F.col("kind") == "education") & F.col("line").contains(","))
    return found.select("document_id", F.col("at").alias("seq"), F.trim(F.regexp_extract("line", "^([^,]*),", 1)).alias("degree"), F.trim(F.regexp_extract("line", r"^[^,]*,([^(]*)", 1)).alias("institution"))


def units(role_rows: DataFrame, highlight_rows: DataFrame, project_rows: DataFrame, education_rows: DataFrame, skill_rows: DataFrame) -> DataFrame:
    """Evidence units (document_id, unit_id, n, section, text, quote): work, projects, education, skills, numbered as they come.

    A role's company comes with its title, each highlight with "title at company", a project's description with its
    name; skills come one by one and once together. quote is what the unit rests on, as the document says it.
    """
    def rows(df: DataFrame, section: str, text: Column, at: Column, sub: int, quote: Column) -> DataFrame:
        return df.select("document_id", F.lit(section).alias("section"), at.cast("long").alias("at"), F.lit(sub).alias("sub"), text.alias("text"), quote.alias("quote"))

    named = highlight_rows.join(role_rows.select("document_id", "role", "title", "company"), ["document_id", "role"])
    together = skill_rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "skill"))).alias("s")).where(F.size("s") > 1)
    parts = [
        rows(role_rows, "work", F.concat_ws(" ", "title", "company"), F.col("at"), 0, F.concat_ws(", ", "title", "company")),
        rows(named, "work", F.concat("title", F.lit(" at "), "company", F.lit(" "), "text"), F.col("at"), 1, F.col("text")),
        rows(project_rows, "projects", F.col("name"), F.col("seq"), 0, F.col("name")),
        rows(project_rows.where("description <> ''"), "projects", F.concat(F.lit("Project "), "name", F.lit(" "), "description"), F.col("seq"), 1, F.col("description")),
        rows(education_rows, "education", F.concat_ws(" ", "degree", "institution"), F.col("seq"), 0, F.concat_ws(", ", "degree", "institution")),
        rows(skill_rows, "skills", F.col("skill"), F.col("seq"), 0, F.col("skill")),
        rows(together, "skills", F.concat(F.lit("Skills: "), F.array_join(F.transform("s", lambda x: x["skill"]), ", ")), F.lit(1 << 62), 1, F.col("s")[0]["skill"]),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(place, "at", "sub"))
    return _named(every.where("text <> ''").withColumn("n", n))


def _project_name(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, "^([^:]*):", 1))


def _project_said(line: Column) -> Column:
    said = F.regexp_extract(line, r"^[^:]*:\s*(.*)$", 1)
    return let(said, lambda s: F.trim(F.when(s.contains(" - github.com/"), F.regexp_extract(s, "^(.*) - ", 1)).otherwise(s)))


def _named(numbered: DataFrame) -> DataFrame:
    n = F.when(F.col("n") < 100, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))
    return numbered.select("document_id", F.concat_ws("-", F.col("document_id").cast("string"), "section", n).alias("unit_id"), "n", "section", "text", "quote")


def evidence(lines: DataFrame) -> DataFrame:
    """The units() of section lines. A document's lines come together and are sorted once; each line makes its own units.

    The lines are read twice, so they should be kept: the skills of a document that has several come as a line more, the last one.
    """
    line, none = F.col("line"), F.lit(None).cast("string")
    skill = lines.where(F.col("kind") == "skills").select("document_id", F.struct("at", F.filter(F.transform(F.split("line", ","), lambda s: F.trim(s)), lambda s: s != "").alias("s")).alias("x"))
    skill = skill.groupBy("document_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"])).alias("s")).where(F.size("s") > 1)
    together = skill.select("document_id", F.lit("together").alias("kind"), F.lit(1 << 62).alias("at"), F.concat(F.lit("Skills: "), F.array_join("s", ", ")).alias("line"), F.col("s")[0].alias("first"))
    rows = lines.select("document_id", "kind", "at", "line", none.alias("first")).unionByName(together)

    is_role = (F.col("kind") == "work") & line.rlike(ROLE)
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(is_role, F.regexp_extract("line", ROLE, k)), ignorenulls=True).over(upto)
    rows = rows.withColumns({"title": last(1), "company": last(2)})

    unit = lambda section, text, sub, quote, at=F.col("at"): F.struct(F.lit(section).alias("section"), at.alias("at"), F.lit(sub).alias("sub"), text.alias("text"), quote.alias("quote"))
    title, company = F.col("title"), F.col("company")
    named, said = _project_name(line), _project_said(line)
    degree, institution = F.trim(F.regexp_extract("line", "^([^,]*),", 1)), F.trim(F.regexp_extract("line", r"^[^,]*,([^(]*)", 1))
    kind = lambda name: F.col("kind") == name
    made = (
        F.when(is_role, F.array(unit("work", F.concat_ws(" ", title, company), 0, F.concat_ws(", ", title, company))))
        .when(kind("work") & title.isNotNull(), F.array(unit("work", F.concat(title, F.lit(" at "), company, F.lit(" "), line), 1, line)))
        .when(kind("projects") & line.contains(":"), F.array(unit("projects", named, 0, named), unit("projects", F.when(said != "", F.concat(F.lit("Project "), named, F.lit(" "), said)), 1, said)))
        .when(kind("education") & line.contains(","), F.array(unit("education", F.concat_ws(" ", degree, institution), 0, F.concat_ws(", ", degree, institution))))
        .when(kind("skills"), F.transform(F.split("line", ","), lambda s, k: unit("skills", F.trim(s), 0, F.trim(s), F.col("at") * 10_000 + k)))
        .when(kind("together"), F.array(unit("skills", line, 1, F.col("first"))))
    )
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section"))
    every = rows.select("document_id", F.inline(made)).where("text <> ''")
    return _named(every.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(place, "at", "sub"))))


def is_degenerate(chars: Column, n_units: Column) -> Column:
    return (chars >= 400) & (n_units < F.greatest(F.lit(2), F.floor(chars / 400)))


def unit_count(lines: Callable[[str], Column]) -> Column:
    """How many units evidence() makes of a document's section lines, none of which is made: lines(kind) are those of a kind, in order."""
    total = lambda rows, n: F.aggregate(rows, F.lit(0), lambda sum_, x: sum_ + n(x))
    said = lambda line: (_project_name(line) != "").cast("int") + (_project_said(line) != "").cast("int")
    work = F.aggregate(lines("work"), F.lit(0), lambda n, x: n + F.when((n > 0) | x.rlike(ROLE), 1).otherwise(0))  # all from the first role on
    projects_ = total(lines("projects"), lambda x: F.when(x.contains(":"), said(x)).otherwise(0))
    education_ = F.size(F.filter(lines("education"), lambda x: x.contains(",")))
    skills_ = let(total(lines("skills"), lambda x: F.size(F.filter(F.split(x, ","), lambda s: F.trim(s) != ""))), lambda n: n + (n > 1).cast("int"))
    return (work + projects_ + education_ + skills_).cast("bigint")


def degenerate(counts: DataFrame) -> DataFrame:
    """Of documents (document_id, chars, n_units) those of 400 characters and more with fewer units than max(2, characters / 400): their extraction failed."""
    return counts.where(is_degenerate(F.col("chars"), F.col("n_units")))
