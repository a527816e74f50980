"""Merkle manifest of a dataset: a tree of digests per group, a tree of the groups' roots, and a proof for each row.

A row's leaf is the digest of its fields, each `-` if null, else byte count, `:` and value. A group's leaves ascend by id;
every FANOUT consecutive nodes (the last run may be shorter) have the digest of their joined digests as parent, until one
is left, the group's subroot. The subroots, ordered by group (null first, bytewise), are the leaves of the last tree.

Levels are windows: partitioned by group and parent index, an ordered full-frame collect_list gives each node the run
it stands in, which is its parent's preimage and holds its siblings; only the first row of a parent goes on to the next
level. HEIGHT levels share a shuffle and a sort: a block of FANOUT**HEIGHT nodes is dealt out together, the windows nest in
it, and within a block a node counts once by its first row. So no group needs a task of its own: places in the order
of a group come from one sort by ranges and the running count of each range's rows.

Proofs go down again: a block's rows get the siblings above the block by a join, one row per block on that side.

Definitions: rows with the same group and id are ordered by leaf; null ids come first in their group; a null group is one
group. Rows repeated are leaves each. verify(): `changed` holds the leaf of what a row is found to be; it's folded with the
siblings of the manifest. Only the named columns are read and results have names of their own, so further columns may clash
with nothing. Texts of any length are hashed within one expression. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import release, same, sized, stored, table

FANOUT, HEIGHT = 3, 4
BLOCK = FANOUT**HEIGHT
#: Places within a partition, as monotonically_increasing_id() gives them.
PLACE_BITS = 33


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields."""
    said = [c.cast("string") for c in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)))


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """rows with idx, the place in the order of `by` within a row's group, and n, the group's rows; rows are released."""
    order = [F.col(c).asc_nulls_first() for c in ("group", *by)]
    ordered = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    release(rows)
    part = F.shiftright("at", PLACE_BITS)
    ranges = ordered.groupBy(F.col("group").alias("g"), part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = stored(ranges.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n")), "ranges")
    met = ordered["group"].eqNullSafe(ranges["g"]) & (F.shiftright(ordered["at"], PLACE_BITS) == ranges["part"])
    out = ordered.join(sized(ranges, 100_000), met).withColumn("idx", F.col("at") + F.col("shift")).drop("g", "part", "shift", "at")
    out._written = (ordered, ranges)
    return out


def climbed(nodes: DataFrame) -> DataFrame:
    """nodes (group, idx, n, node, ...) with block, path (left, right: siblings on up to HEIGHT levels) and top, the block's node."""
    parent = lambda j: f"p{j}" if j < HEIGHT else "block"
    out = nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).repartition("group", "block")
    out = out.withColumns({parent(j): F.expr(f"idx div {FANOUT**j}") for j in range(1, HEIGHT)}).withColumn("top", F.col("node"))
    steps = []
    for j in range(1, HEIGHT + 1):
        each = FANOUT ** (j - 1)  # rows of a node of this level
        inner = [parent(k) for k in range(j - 1, 0, -1)]
        run = Window.partitionBy("group", *(parent(k) for k in range(HEIGHT, j - 1, -1))).orderBy(*inner, "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumn(f"run{j}", F.collect_list(F.when(F.col("idx") % each == 0, F.col("top"))).over(run))
        place = F.expr(f"cast(idx div {each} % {FANOUT} as int)")
        beside = F.struct(F.array_join(F.slice(f"run{j}", F.lit(1), place), "").alias("left"), F.array_join(F.slice(f"run{j}", place + 2, F.lit(FANOUT)), "").alias("right"))
        several = F.col("n") > each  # else this node is the only one of its group
        steps.append(F.when(several, beside))
        out = out.withColumn("top", F.when(several, digest(F.array_join(f"run{j}", ""))).otherwise(F.col("top")))
    path = F.array_compact(F.array(*steps))
    return out.select(*nodes.columns, "block", path.alias("path"), "top")


def trees(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """climbed() of the leaves, of their blocks' tops, and so on, all stored; and (group, node) of each group's root."""
    levels = [stored(climbed(leaves), "level")]
    release(*getattr(leaves, "_written", ()))
    while True:
        last = levels[-1]
        tops = last.where(F.col("idx") % BLOCK == 0).select("group", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("node"))
        if (tops.agg(F.max("n")).first()[0] or 1) == 1:
            return levels, tops.select("group", "node")
        levels.append(stored(climbed(tops), "level"))


def over(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The lowest level's rows with all siblings up to the root in path; above: (group, path, ...) of what lies over the roots."""
    extra = [] if above is None else [c for c in above.columns if c not in ("group", "path")]
    upper = None
    for level in reversed(levels):
        if upper is None and above is None:
            upper = level
            continue
        if upper is None:
            short = above.select(F.col("group").alias("g"), F.col("path").alias("more"), *extra)
            met = level["group"].eqNullSafe(short["g"])
        else:
            short = upper.select(F.col("group").alias("g"), F.col("idx").alias("b"), F.col("path").alias("more"), *extra)
            met = level["group"].eqNullSafe(short["g"]) & (level["block"] == short["b"])
        upper = level.join(short, met).select(*(c for c in level.columns if c != "path"), F.concat("path", "more").alias("path"), *extra)
    return upper


def manifest(rows: DataFrame) -> DataFrame:
    """rows (group, id, leaf, ...) with subroot, root and path, the siblings from the leaf up to the root."""
    levels, subroots = trees(placed(stored(rows.withColumn("node", F.col("leaf")), "leaves"), "id", "leaf"))
    subroots = stored(subroots.select(F.lit(0).alias("group"), F.col("group").alias("name"), "node"), "subroots")
    tops, root = trees(placed(subroots, "name"))
    first = root.first()
    above = stored(over(tops).select(F.col("name").alias("group"), "path", F.col("node").alias("subroot")), "above")
    release(*tops)
    found = over(levels, sized(above, 10_000)).withColumn("root", F.lit(first[1] if first else None).cast("string"))
    return found.select(*rows.columns, "subroot", "root", "path")


def proof(path: Column) -> Column:
    """Digest of a row's siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root to which a leaf leads with these siblings."""
    return F.aggregate(path, node, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def verify(found: DataFrame) -> DataFrame:
    """A manifest with column changed: folded_root and verified."""
    return found.withColumn("folded_root", folded(F.col("changed"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by source; where crc32 of the id is even, the text is checked without its line feeds."""
    docs = table(spark, sf_dir, "documents")
    tampered = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(even & F.col("text").contains("\n"), leaf(*tampered)).alias("other"))
    found = verify(manifest(rows).withColumn("changed", F.coalesce("other", "leaf")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _levels(name: str, start: str, group: str, count: int) -> str:
    """CTEs of the tree's levels: {name}0 is `start` (group, i, node, n), {name}k has the parents."""
    out = [f"{name}0 AS ({start})"]
    for k in range(count):
        run = f"string_agg(node, '' ORDER BY i)"
        out.append(f"{name}{k + 1} AS (SELECT {group}, i // 3 AS i, CASE WHEN min(n) > 1 THEN sha256({run}) ELSE min(node) END AS node, (min(n) + 2) // 3 AS n FROM {name}{k} GROUP BY {group}, i // 3)")
        out.append(
            f"{name}s{k} AS (SELECT {group}, i, CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER (PARTITION BY {group}, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, "
            f"CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER (PARTITION BY {group}, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r, n > 1 AS more FROM {name}{k})"
        )
    return ",\n".join(out)


def _oracle(levels: int = 10, tops: int = 4) -> str:
    """The query in SQL, for sources of at most 3**levels rows and at most 3**tops sources."""
    said = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    fields = " || ".join(map(said, FIELDS))
    changed = fields.replace("text", "replace(text, chr(10), '')")
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, source, sha256({fields}) AS leaf, CASE WHEN {crc} % 2 = 0 THEN sha256({changed}) ELSE sha256({fields}) END AS h0, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)",
        _levels("t", "SELECT source, i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM d", "source", levels),
        f"subs AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM t{levels})",
        _levels("u", "SELECT 0 AS g, j AS i, subroot AS node, count(*) OVER () AS n FROM subs", "g", tops),
        "f0 AS (SELECT d.doc_id, d.leaf, d.source, d.i, subs.subroot, subs.j, d.h0 AS h, '' AS p FROM d JOIN subs ON d.source IS NOT DISTINCT FROM subs.source)",
    ]
    for k in range(levels + tops):
        at, met = (f"ts{k}", f"f{k}.source IS NOT DISTINCT FROM s.source AND f{k}.i // {3**k} = s.i") if k < levels else (f"us{k - levels}", f"f{k}.j // {3 ** (k - levels)} = s.i")
        parts.append(f"f{k + 1} AS (SELECT doc_id, leaf, f{k}.source, f{k}.i, subroot, j, CASE WHEN more THEN sha256(l || h || r) ELSE h END AS h, p || l || r AS p FROM f{k} JOIN {at} s ON {met})")
    end = levels + tops
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, node AS root, sha256(p) AS proof_sha256, h AS folded_root, h = node AS verified FROM f{end}, u{tops}"


ORACLE = _oracle()
