"""WARC archives: index first, then coalesced sorted byte-range reads of the selected records.

Every page becomes a WARC/1.1 record in a gzip member of its own; the first page of each payload is a response,
later ones are revisit records that refer to it.  Each task writes its archives below the shared folder under a name
of its own, so a task that runs again after a lost executor leaves no half-written archive in the index, and returns
an index row for each record: archive, offset, length, URL and digest.  A reader picks records from the index alone,
sorts them by offset within their archive, joins neighbouring ranges and reads each joined range in one go.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import Scratch, table

#: Smaller payloads are always stored as responses.
LEAST_SHARED = 100
#: An archive that has grown to this size is closed and the next begun.
ARCHIVE_BYTES = 1 << 30
#: Ranges closer than GAP bytes are read as one, up to SPAN bytes.
GAP, SPAN = 64 << 10, 2 << 20
#: Compressed bytes that a reading task gets on average.
TASK_BYTES = 4 << 20
CRLF = "\r\n"


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, record (text), payload_bytes, digest, type and refers_to of each page, in UTF-8.

    Null html is an empty payload.  Null page ids are rows of their own: they sort first as archive order goes,
    never refer to another page and are never referred to.  Rows that repeat a page id and its payload are the
    same record and get the same type.  Control characters in a URL are left out of its header.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest, size = F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes")
    narrow = pages.select("page_id", digest, size).where(F.col("payload_bytes") >= LEAST_SHARED)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = narrow.join(first, "digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    rows = pages.select("page_id", "url", html.alias("html"), digest, size).join(again, ["page_id", "digest"], "left")
    return rows.withColumn("type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).withColumn("record", _record())


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _record() -> Column:
    body = F.when(F.col("type") == "revisit", F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _name(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x1F\x7F]", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("type") == "revisit", F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _name(F.col("refers_to")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head, body)


def write(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes the archives and then their index, which is returned."""
    base = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(base)
        where.create_dir(folder, recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            for record in batch.column(batch.num_columns - 1).cast(pa.large_binary()):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress(record.as_py() + b"\r\n\r\n", 6, mtime=0)
                out.write(member)
                files.append(name)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=[*batch.schema.names[:-1], "archive", "offset", "length"])
        if out is not None:
            out.close()

    rows = records(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "digest", "type", F.col("refers_to").cast("long").alias("refers_to"), "record")
    return scratch.write(rows.mapInArrow(run, "page_id long, url string, digest string, type string, refers_to long, archive string, offset long, length long"), "index")


def read(selected: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, type, refers_to, payload, digest header and URL of the selected index rows, read from the archives."""
    order = Window.partitionBy("archive").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length"), 1).over(order)
    runs = selected.select("archive", "offset", "length").withColumn("run", F.sum(F.when(gap > GAP, 1).otherwise(0)).over(order))
    # A run of neighbours is read as one range, but for a cut at every SPAN bytes.
    spans = runs.groupBy("archive", "run", (F.col("offset") / SPAN).cast("long").alias("part")).agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
    spans = scratch.write(spans.select("archive", "begin", "end", "ranges"), "spans")
    # Tasks by the bytes that they read: the rows that name the ranges are small however much they stand for.
    tasks = -(-(spans.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] or 0) // TASK_BYTES)
    base = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read_spans(base, batches)

    dealt = spans.repartition(max(1, tasks), "archive", "begin")
    return dealt.mapInArrow(run, "page_id long, type string, refers_to long, payload binary, digest string, url string")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record; ValueError if it isn't one."""
    head, sep, rest = raw.removesuffix(b"\r\n\r\n").partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size:
        raise ValueError("record length differs from its header")
    return fields, rest


def _page(name: str | None) -> int | None:
    return None if name in (None, "<urn:page:null>") else int(name[10:-1])


def _read_spans(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    where, folder = fs.FileSystem.from_uri(base)
    schema = pa.schema([("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest", pa.string()), ("url", pa.string())])
    for batch in batches:
        for file, begin, end, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with where.open_input_file(f"{folder}/{file}") as f:
                block = f.read_at(end - begin, begin)
            rows = []
            for r in ranges:
                at = r["offset"] - begin
                fields, body = parse_record(gzip.decompress(block[at : at + r["length"]]))
                rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), body, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Target-URI"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def resolve(read: DataFrame, scratch: Scratch) -> DataFrame:
    """Length and digest of each read record's full payload; a revisit's are those of the response it refers to."""
    own = read.select("page_id", "type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"), "digest")
    own = scratch.write(own, "read")
    responses = own.where(F.col("type") == "response").select(F.col("page_id").alias("refers_to"), F.col("n").alias("response_n"), F.col("sha").alias("response_sha")).dropDuplicates(["refers_to", "response_sha"])
    joined = own.join(responses, (own.refers_to == responses.refers_to) & (own.digest == responses.response_sha), "left").drop(responses.refers_to)
    revisit = F.col("type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("response_n")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.col("response_sha")).otherwise(F.col("sha")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back through their index."""
    scratch = Scratch(spark, "warc")
    index = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch)
    return resolve(read(index, scratch), scratch)


OP4_SQL = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN strlen(html) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT page_id, html, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first_id
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
