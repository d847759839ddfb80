"""WARC archives: written as request, response (or revisit) and metadata records, read back as transactions.

Writing: each page becomes three records that share one capture identifier; the request and the metadata name
it in ``WARC-Concurrent-To``. Of equal payloads (SHA-256) the one of the smallest id is a response, the others are
revisits without a payload. Spark's text writer ends every record with the two line ends that the format
asks for, so the files are plain WARC 1.1 in one gzip member each, written through the usual commit.

Reading: Spark's text reader cuts the files at double line ends and streams the pieces of a file in order; the
worker joins them again by ``Content-Length``, one record at a time, so neither a file nor an archive has to fit
in memory, and any file system Spark reads will do. Lengths and payload digests are verified. ``transactions``
then joins the records by their concurrent-to identifiers, in either direction, into one nested row per capture.

Defined cases: null payload is empty; null address leaves out the header; control characters and blanks of an
address are written as ``%20`` (the page is named by its id, not by the address); a null id is never the smallest,
is left out of the metadata and read back as null; if no row of a payload has an id all are responses; rows that
repeat the smallest id of their payload are all responses, as a page does not revisit itself; each repeated row
is a capture of its own; records that name no capture of the archive are in no transaction; a truncated record or
a wrong digest raises; an empty table gives no captures; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetlake.llm.tokenout import small_batches
from snippetlake.session import cut, shared_dir

END = "\r\n"
BREAK = END + END
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of blocks that a reading worker holds before it gives out a batch.
HELD = 8 << 20
RECORD = (
    "type string, id string, concurrent array<string>, target string, date string, payload_key string, "
    "payload_bytes bigint, payload_digest string, fields map<string,string>"
)
CAPTURES = ("response", "revisit")


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of a SHA-1 given in hexadecimal: five hex digits are four of the 32 letters."""

    def chunk(c: Column) -> Column:
        bits = F.conv(F.substring(hexed, c * 5 + 1, F.lit(5)), 16, 10).cast("int")
        at = [F.floor(bits / (1 << s)).cast("int") % 32 + 1 for s in (15, 10, 5, 0)]
        return F.concat(*[F.substring(F.lit(BASE32), a, F.lit(1)) for a in at])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), chunk), "")


def _record(kind: str, identity: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """The text of a record; headers that are null are left out."""
    head = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), identity, F.lit(">")),
        *headers,
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *head), F.lit(BREAK), block)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one request, response or revisit, and metadata record per row of ``pages`` below ``folder``."""
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("content"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("content", 256)))
    # written first, so that its size is known and a hot payload's rows can be split
    least = cut(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("page").alias("least")).where("n > 1 and least is not null").select("sha", "least"))
    named = rows.join(least, "sha", "left").withColumns({"capture": F.uuid(), "asked": F.uuid(), "about": F.uuid()})
    again = F.col("least").isNotNull() & ~F.col("page").eqNullSafe(F.col("least"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    target_line = F.concat(F.lit("WARC-Target-URI: "), target)
    date_line = F.lit(f"WARC-Date: {date}")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: <urn:uuid:"), F.col("capture"), F.lit(">"))
    digests = [
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.sha1("content"))),
        F.concat(F.lit("X-Payload-SHA256: "), F.lower(F.hex("sha"))),
    ]
    size = F.octet_length("content").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(BREAK))
    path = F.coalesce(F.nullif(F.regexp_extract(target, r"://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{END}Host: "), F.regexp_extract(F.coalesce(target, F.lit("")), r"://([^/?#]*)", 1), F.lit(BREAK))
    about = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit(END)), F.lit("payload-length: "), size, F.lit(END))
    shared = [date_line, target_line]
    records = F.array(
        _record("request", F.col("asked"), [*shared, concurrent], "application/http; msgtype=request", F.coalesce(asked, F.lit(f"GET / HTTP/1.1{BREAK}"))),
        F.when(again, _record("revisit", F.col("capture"), [*shared, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), *digests], "application/http; msgtype=response", http)).otherwise(
            _record("response", F.col("capture"), [*shared, *digests], "application/http; msgtype=response", F.concat(http, F.col("content")))
        ),
        _record("metadata", F.col("about"), [*shared, concurrent], "application/warc-fields", about),
    )
    named.select(F.explode(records).alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(folder)


def _fields(lines: bytes) -> list[tuple[str, str]]:
    """Named fields; a line that begins with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines.decode("utf-8", "replace").split(END):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


class _Stream:
    """Puts the pieces of one file together again and yields (header fields, block)."""

    def __init__(self, path: str):
        self.path, self.head, self.size = path, None, 0
        self.parts: list[bytes] = []
        self.have = 0

    def feed(self, piece: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        if self.head is None:
            piece = piece.lstrip(b"\r\n")  # what is left of the end of the record before
            if not piece:
                return
            version, _, lines = piece.partition(END.encode())
            if not version.startswith(b"WARC/1."):
                raise ValueError(f"{self.path}: not a WARC record: {version[:40]!r}")
            self.head = _fields(lines)
            self.size = int(dict(self.head)["content-length"])
            self.parts, self.have = [], -len(BREAK)
            if not self.size:
                yield self._done()
            return
        self.parts.append(piece)
        self.have += len(BREAK) + len(piece)
        if self.have >= self.size:
            joined = BREAK.encode().join(self.parts)
            block, rest = joined[: self.size], joined[self.size :]
            yield self._done(block)
            if rest:
                yield from self.feed(rest)

    def _done(self, block: bytes = b"") -> tuple[list[tuple[str, str]], bytes]:
        head, self.head, self.parts = self.head, None, []
        return head, block

    def end(self) -> None:
        if self.head is not None:
            raise ValueError(f"{self.path}: the last record is truncated")


def _parsed(head: list[tuple[str, str]], block: bytes) -> dict:
    one = dict(head)
    kind = one.get("warc-type", "")
    row = {"type": kind, "id": one.get("warc-record-id"), "concurrent": [v for k, v in head if k == "warc-concurrent-to"], "target": one.get("warc-target-uri"), "date": one.get("warc-date")}
    said = one.get("warc-payload-digest")
    row |= {"payload_key": one.get("x-payload-sha256") or said, "payload_bytes": None, "payload_digest": None, "fields": [], "payload": None}
    if kind == "response":
        payload = block.partition(BREAK.encode())[2] if "http" in one.get("content-type", "") else block
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if said and said.lower().startswith("sha1:") and said[5:].upper() != digest:
            raise ValueError(f"payload of {row['id']} does not have the digest {said}")
        row |= {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}
    elif one.get("content-type", "").startswith("application/warc-fields"):
        row["fields"] = list(dict(_fields(block)).items())
    return row


def _parse(with_payload: bool):
    schema = pa.schema(
        [("type", pa.string()), ("id", pa.string()), ("concurrent", pa.list_(pa.string())), ("target", pa.string()), ("date", pa.string()), ("payload_key", pa.string())]
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
        + ([("payload", pa.binary())] if with_payload else [])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, held = None, [], 0
        for batch in batches:
            for piece, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream is None or stream.path != path:
                    if stream:
                        stream.end()
                    stream = _Stream(path)
                for head, block in stream.feed(piece):
                    rows.append(_parsed(head, block))
                    held += 500 + (len(block) if with_payload else 0)
                    if held >= HELD:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if stream:
            stream.end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return work


def records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives: ``RECORD``, and the payload of responses if wanted."""
    small_batches(spark)
    pieces = spark.read.option("lineSep", BREAK).text(folder).select(F.col("value").cast("binary"), F.col("_metadata.file_path"))
    return pieces.mapInArrow(_parse(with_payload), RECORD + (", payload binary" if with_payload else ""))


def transactions(found: DataFrame) -> DataFrame:
    """One row per capture of ``found`` (records, best written first): its ``response`` (or revisit), its
    ``requests`` and its ``metadata``, each a struct or sorted list of structs."""
    names = [c for c in found.columns if c != "payload"]
    captures = found.where(F.col("type").isin(*CAPTURES))
    others = found.where(~F.col("type").isin(*CAPTURES))
    naming = others.select(F.explode("concurrent").alias("capture"), F.col("id").alias("other"))
    named = captures.select(F.col("id").alias("capture"), F.explode("concurrent").alias("other"))
    links = naming.unionByName(named).distinct()
    of = links.join(others.select(F.col("id").alias("other"), F.struct(*[F.col(c) for c in names]).alias("record")), "other")
    kind = lambda k: F.array_sort(F.collect_list(F.when(F.col("record.type") == k, F.struct("record.id", "record.target", "record.date", F.map_entries("record.fields").alias("fields")))))
    attached = of.groupBy("capture").agg(kind("request").alias("requests"), kind("metadata").alias("metadata"))
    response = captures.select(F.col("id").alias("capture"), F.struct(*[F.col(c) for c in found.columns]).alias("response"))
    return response.join(attached, "capture", "left")


def pages(assembled: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of transactions; revisits take
    length and digest from the response they refer to."""
    fields = F.map_from_entries(F.col("metadata")[0]["fields"])
    narrow = assembled.select(
        F.element_at(fields, "page-id").cast("bigint").alias("page_id"),
        *[F.col("response")[c].alias(c) for c in ("type", "payload_key", "payload_bytes", "payload_digest")],
    )
    narrow = cut(narrow)
    same = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    responses = narrow.where("type = 'response'").select(*same, F.lit(None).cast("bigint").alias("refers_to"))
    revisits = narrow.where("type = 'revisit'").select("payload_key", "page_id", F.col("type").alias("record_type"))
    first = narrow.where("type = 'response'").groupBy("payload_key").agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("first"))
    # written first: a payload that many pages share is then a plain exchange, which can be split
    first = cut(first.where(F.col("first.page_id").isNotNull()))
    resolved = revisits.join(first, "payload_key", "left").select("page_id", "first.payload_bytes", "first.payload_digest", "record_type", F.col("first.page_id").alias("refers_to"))
    return responses.unionByName(resolved)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
