"""Content-addressed WARC archive.

Every page becomes a record: an exact head (the WARC header lines and the HTTP header) and a payload (its
markup in UTF-8).  ``store`` keeps each distinct payload once, under its SHA-256 digest; payloads are told
apart by the digest and their bytes, so an address stands for one payload only, and two payloads of
one digest get addresses of their own.  Heads are kept apart, one row per record, with the address of
their payload.  ``restore`` joins them back into the original records.  ``write_files`` writes the
archive as WARC 1.1 files, in which of equal payloads the first is a response and the others revisit
it, and ``read_files`` parses such files.

Scale: copies of a payload collapse map-side before the one shuffle of payloads; addresses and heads are
small rows, and the joins on them are plain equi-joins that adaptive execution splits where an address
is held by very many records.  Files are written by Spark's text writer, so they may lie on any
shared file system and a lost executor leaves no half file; reading deals out files, and a reader holds one
compressed file and one record at a time.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, shared_dir, stored

#: Payload bytes that a reader hands on at once, besides the last record.
READ_BYTES = 4 << 20
# Line end, the two that end a record, the names of the WARC fields and the profile of a revisit.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Head field of ours that keeps the id of the row.
ROW_FIELD = "X-Row-Id"
#: A line break would end a field, so it is escaped; in the id, which is read back, the escape sign too.
ROW_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def _escaped(text: Column, escapes: Sequence[tuple[str, str]]) -> Column:
    for sign, code in escapes:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def _unescaped(text: str | None) -> str | None:
    for sign, code in reversed(ROW_ESCAPES):
        text = text and text.replace(code, sign)
    return text


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: four groups of ten hexadecimal digits are eight base32 digits each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


@dataclass
class Archive:
    """``heads``: rid, id, uri, bytes, sha1, address, first (the response that a record revisits or is).
    ``payloads``: address, payload; each payload once."""

    heads: DataFrame
    payloads: DataFrame
    digest: Callable[[Column], Column] = sha256


def store(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
          least_bytes: int = 0, digest: Callable[[Column], Column] = sha256) -> Archive:
    """Write the two tables of an archive.

    Of records with equal payloads of ``least_bytes`` or more the one with the smallest id (null ids last, then
    the first row) is the response and the others revisit it; smaller payloads are stored once too, but
    each record is a response.  Null payloads count as empty; null addresses (``uri_col``) leave the field out; repeated
    rows are records of their own; other columns are ignored.  An empty table gives an empty archive."""
    text = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("uri"), text.alias("payload"))
    rows = rows.withColumn("digest", digest(F.encode("payload", "UTF-8")))
    # grouping by the bytes beside the digest is the verification: equal digests of unequal bytes stay two rows
    kept = stored(rows.groupBy("digest", "payload").agg(F.count("*").alias("n")).drop("n"), "warc-payloads")
    slim = rows.select("id", "uri", F.octet_length("payload").cast("long").alias("bytes"),
                       base32_sha1(F.encode("payload", "UTF-8")).alias("sha1"), "digest")
    clash = kept.groupBy("digest").count().filter("count > 1")
    if clash.isEmpty():
        address = F.col("digest")
        payloads = kept.select(address.alias("address"), "payload")
    else:
        by = Window.partitionBy("digest").orderBy("payload")
        payloads = stored(kept.select(F.concat_ws("-", "digest", F.row_number().over(by).cast("string")).alias("address"),
                                      "digest", "payload"), "warc-payloads")
        address = F.col("address")
        slim = rows.join(payloads, ["digest", "payload"]).select(
            "id", "uri", F.octet_length("payload").cast("long").alias("bytes"),
            base32_sha1(F.encode("payload", "UTF-8")).alias("sha1"), "address")
        payloads = payloads.select("address", "payload")
    slim = stored(slim.select(F.monotonically_increasing_id().alias("rid"), "id", "uri", "bytes", "sha1",
                              address.alias("address")), "warc-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rid"))
    firsts = stored(slim.groupBy("address").agg(first.alias("f")).select("address", "f.rid", "f.id"), "warc-firsts")
    heads = slim.join(firsts.select("address", F.col("rid").alias("first")), "address")
    heads = heads.withColumn("first", F.when(F.col("bytes") >= least_bytes, F.col("first")).otherwise(F.col("rid")))
    return Archive(heads, payloads, digest)


def record_uuid(archive: str, rid: Column) -> Column:
    """A record id from the archive's name and the record's row number, in the form of a UUID."""
    h = F.sha1(F.concat_ws("/", F.lit(archive), rid.cast("string")).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def head_text(archive: str, date: str, revisit: Column) -> Column:
    """The exact head of a record: WARC fields, empty line, HTTP header and its empty line."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))

    def urn(rid: Column) -> Column:
        return F.concat(F.lit("<urn:uuid:"), record_uuid(archive, rid), F.lit(">"))

    uri = _escaped(F.col("uri"), ROW_ESCAPES[1:])
    return F.concat(
        F.lit(VERSION + CRLF), field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", urn(F.col("rid"))), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        field("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        field("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        field(ROW_FIELD, _escaped(F.col("id").cast("string"), ROW_ESCAPES)),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", block.cast("string")),
        F.lit(CRLF), http)


def restore(archive: Archive, name: str = "archive", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(rid, id, head, payload): every original record whole, revisits with the payload that they share.

    A payload whose bytes don't have the digest in its address fails the job."""
    full = archive.heads.select("rid", "id", "address", head_text(name, date, F.lit(False)).alias("head"))
    digest = archive.digest(F.encode("payload", "UTF-8")).cast("string")
    sound = F.when(F.startswith("address", digest), F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload does not have the digest of its address")).cast("string"))
    return full.join(archive.payloads, "address").select("rid", "id", "head", sound.alias("payload"))


def write_files(archive: Archive, path: str, name: str = "archive", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archive as gzipped WARC files below ``path``: a response has its payload, a revisit none."""
    revisit = F.col("rid") != F.col("first")
    responses = archive.heads.filter(~revisit).select("address", head_text(name, date, F.lit(False)).alias("head"))
    whole = responses.join(archive.payloads, "address").select(F.concat("head", "payload").alias("value"))
    whole.unionAll(archive.heads.filter(revisit).select(head_text(name, date, F.lit(True)).alias("value"))) \
        .write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, head bytes, payload) of each record of one WARC file; lengths decide, not separators."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if line.rstrip(b"\r\n") != VERSION.encode():
            raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
        head, fields = [line], {}
        while (line := stream.readline()).strip():
            head.append(line)
            key, _, value = line.decode().rstrip(CRLF).partition(": ")
            fields[key] = value
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record ends early")
        http, gap, payload = block.partition(RECORD_END.encode())
        yield fields, b"".join(head) + line + http + gap, payload


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, uri, row_id, declared, head, payload) of every record of the files
    below ``path``; ``refers_to`` is a record id, ``declared`` the digest in the head, and a revisit's
    payload is empty.  No files, or empty ones, give no rows."""
    names = ["record_id", "record_type", "refers_to", "uri", "row_id", "declared", "head", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            kinds = [pa.string()] * 6 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                    for f, head, payload in parse(stream):
                        rows.append((f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Refers-To"), f.get("WARC-Target-URI"),
                                     _unescaped(f.get(ROW_FIELD)), f["WARC-Payload-Digest"].removeprefix("sha1:"), head, payload))
                        size += len(payload)
                        if size >= READ_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {'binary' if n in ('head', 'payload') else 'string'}" for n in names))


def resolved(records: DataFrame) -> DataFrame:
    """(row_id, payload_bytes, payload_digest, record_type, refers_to) of records read back.

    Length and digest are taken from the payload that was read, for a revisit from that of the response it
    refers to; a head that declares another digest fails the job, a revisit without its response too."""
    measured = stored(records.select(
        "record_id", "record_type", "refers_to", "row_id", "declared", F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1")), "warc-read")
    of = measured.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("bytes").alias("b"), F.col("sha1").alias("s"), F.col("row_id").alias("of"))
    revisit = F.col("record_type") == "revisit"
    both = measured.filter(~revisit).select("*", F.col("bytes").alias("b"), F.col("sha1").alias("s"),
                                            F.lit(None).cast("string").alias("of"))
    both = both.unionByName(measured.filter(revisit).join(of, "refers_to", "left"))
    sound = F.when(F.col("declared") == F.col("s"), F.col("s")).otherwise(
        F.raise_error(F.lit("a WARC payload does not have the digest of its record")).cast("string"))
    return both.select("row_id", F.col("b").alias("payload_bytes"), sound.alias("payload_digest"), "record_type",
                       F.col("of").alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive ``pages``, write it as WARC files, read them back: id, payload_bytes, payload_digest, record_type and
    refers_to (the id of the response that a revisit refers to), one row per page."""
    spark = pages.sparkSession
    archive = store(pages, id_col, uri_col, payload_col)
    path = f"{shared_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    write_files(archive, path)
    release(archive.payloads)
    kind = pages.schema[id_col].dataType
    return resolved(read_files(spark, path)).select(
        F.col("row_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
