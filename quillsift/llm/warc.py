"""WARC archives with revisit resolution.

1. Headers (id, url, payload digest and length) are shuffled by digest; of equal payloads of at least LEAST_BYTES the
   record with the smallest id is the response, and digests that occur once drop out here.
2. Pages are joined with what is left by digest (broadcast if it is counted and small, else a shuffle join that splits
   skewed digests) and get fresh headers. Map tasks compress each record as a gzip member of its own and pack members
   into archives of about FILE_BYTES, each opened by a warcinfo record. Spark's text writer stores an archive as one file
   of one line; the line's separator is an empty gzip member, so it only marks the end of the file.
3. Archives are read back as binary files and parsed member by member in Arrow batches; revisit records are joined to
   the responses they refer to.

Definitions: null html is empty; null urls write no target header; control characters and spaces of an url are written
as %20 in its header. Null ids count as largest. Rows repeated with the smallest id are responses all; of equal ids the
one with the smallest url is the original. Record ids name a record, but for rows that repeat an original wholly (id,
url and payload): these share its record id. A payload of any length is one record, in memory once or twice; an archive
is bounded by its bytes, not its records. Only the id, url and html columns are read, under names of their own. An empty
table gives no records and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import cut, new_folder, sized, small_batches, table

LEAST_BYTES = 100
FILE_BYTES, BATCH_BYTES = 16 << 20, 8 << 20
END = "\r\n"
NO_BYTES = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, bytes, refers_to, refers_url, again, original); refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("long")})
    headers = rows.select("id", "url", "digest", "bytes").where(F.col("bytes") >= LEAST_BYTES)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("url"))).alias("first")
    originals = cut(headers.groupBy("digest").agg(F.count("*").alias("n"), first).where("n > 1").select("digest", "first"))
    joined = rows.join(sized(originals), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id"))
    return joined.select("id", "url", "payload", "digest", "bytes", F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"), again.alias("again"), (F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.url").eqNullSafe(F.col("url")) & F.col("first").isNotNull()).alias("original"))


def _urn(*of: Column) -> Column:
    name = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("null")) for c in of))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(name.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write(resolved: DataFrame, folder: str, date: str | None = None) -> None:
    """Write archives below folder; date: of the records, now if None."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END)))
    uri = lambda u: F.regexp_replace(u, r"[\x00-\x20\x7F]", "%20")
    again = F.col("again")
    original = _urn(F.col("id"), F.col("url"), F.col("digest"))
    own = F.when(F.col("original"), original).otherwise(_urn(F.col("id"), F.col("url"), F.col("digest"), F.monotonically_increasing_id()))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    head = F.concat_ws(
        "", F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", own), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Refers-To", F.when(again, _urn(F.col("refers_to"), F.col("refers_url"), F.col("digest")))),
        line("WARC-Refers-To-Target-URI", F.when(again, uri(F.col("refers_url")))), line("WARC-Refers-To-Date", F.when(again, F.lit(date))),
        line("WARC-Profile", F.when(again, F.lit(PROFILE))), line("Page-ID", F.col("id").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(END),
    )
    parts = resolved.select(F.concat(head, http).alias("head"), F.when(again, F.lit("")).otherwise(F.col("payload")).alias("payload"))
    about = f"software: quillsift{END}format: WARC File Format 1.1{END}".encode()

    def opened() -> list[bytes]:
        lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}", END]
        return [gzip.compress(END.join(lines).encode() + about + 2 * END.encode(), 6, mtime=0)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = opened(), 0
        for batch in batches:
            for h, payload in zip(batch.column(0), batch.column(1), strict=True):
                members.append(gzip.compress(h.as_py().encode() + payload.as_py().encode() + 2 * END.encode(), 6, mtime=0))
                held += len(members[-1])
                if held > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])
                    members, held = opened(), 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])

    small_batches(resolved.sparkSession, 200)
    files = parts.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", NO_BYTES.decode("latin-1")).option("maxRecordsPerFile", 1).text(folder)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; every gzip member must be one record."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a member")
            parts.append(member.decompress(view[at : at + 65_536]))
            at += len(view[at : at + 65_536])
        at -= len(member.unused_data)
        plain = b"".join(parts)
        if not plain:
            continue
        head, _, rest = plain.partition(b"\r\n\r\n")
        first, *lines = head.decode().split(END)
        headers = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"not a record: {plain[:40]!r}")
        yield headers, rest[:size]


def read(spark: SparkSession, folder: str, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, record_id, refers_id, payload_digest, payload_bytes), and payload if asked for.

    Digests and lengths of responses are worked out again from the payload and must be those of their headers.
    """
    names = ["page_id", "url", "record_type", "record_id", "refers_id", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string()]
    width = 7 + with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for h, block in records(content.as_py()):
                    if h["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    size = int(http.rpartition(b"Content-Length:")[2])
                    if h["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {h['warc-record-id']} doesn't have the payload its headers tell")
                    rows.append((h.get("page-id"), h.get("warc-target-uri"), h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), digest, size, payload.decode() if with_payload and h["warc-type"] == "response" else None))
                    held += 200 + len(payload) * with_payload
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:width], kinds, strict=False)], names[:width])

    schema = ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in names[:width])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, schema).withColumn("page_id", F.col("page_id").cast(id_type))


def rejoin(found: DataFrame) -> DataFrame:
    """Read records with refers_to, the id of the response that a revisit record refers to."""
    responses = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("_r")).agg(F.min("page_id").alias("_id"), F.min("payload_digest").alias("_digest"))
    revisits = found.where("record_type = 'revisit'")
    revisits = revisits.join(responses, (revisits.refers_id == responses._r) & (revisits.payload_digest == responses._digest), "left").withColumnRenamed("_id", "refers_to").drop("_r", "_digest")
    return found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(dict(found.dtypes)["page_id"])).unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write(resolve(table(spark, sf_dir, "pages")), folder)
    found = rejoin(cut(read(spark, folder)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), m AS (SELECT *, strlen(x) AS n, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(x) AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM m
"""
