"""WARC archives without repeated payloads: revisit resolution.

Headers (no payloads) are shuffled by payload digest. Of the responses with equal payloads of `least` bytes or more, that with
the smallest page_id stays a response; the others, and revisit records that an archive already holds, become revisits that
refer to it. Archives are then written with fresh headers: a revisit has the HTTP header of its capture and no payload.

Spark's text writer puts the records down, so that archives go to any store, half-written files of lost executors never
count, and each file is one gzip stream. They are read as whole files, record by record by Content-Length, so
that nothing in a payload is taken for a header; payloads are held one at a time, and their digests are checked. Payloads move once, by the
ids of their records, which are as many as there are rows; digests that very many records share meet their response by a broadcast of at most
HOT rows.

Defined cases: a null payload is empty; payloads below `least` bytes are all responses; of rows that repeat the smallest page_id
the one with the smallest record id is the response; a null page_id stands behind all others and stays null, also where it is
referred to; a null url has no header; line ends in a url are written %0D and %0A and blanks at its ends are lost; a very long page is one
record (a file, as Spark reads it, holds 2 GB at most); a revisit whose original is in no archive stays a revisit that refers to nothing; an empty table
gives an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemesh.llm.common import scratch_dir, written

#: Keys that are broadcast, at most: those that hold more than this part of all rows.
HOT = 1000
#: Payload bytes that a task of the reader hands on at a time, at least.
BATCH_BYTES = 16 << 20
#: Records of a file, at most.
FILE_RECORDS = 16_384
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def captures(pages: DataFrame) -> DataFrame:
    """(record_id, page_id, url, payload) of a table read from files: a record's id comes of its file and row, the same at every attempt."""
    name = F.md5(F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(dashed.alias("record_id"), "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def headers(records: DataFrame) -> DataFrame:
    """(record_id, record_type, page_id, url, payload_bytes, payload_digest) of captures, all of them responses."""
    return records.select("record_id", F.lit("response").alias("record_type"), "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))


def met(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Rows of many with the row of one that has their key, which is a key of one. Keys that hold more than 1/HOT of many have their rows broadcast (HOT at most); the others meet by a shuffle."""
    n = many.count()
    hot = F.broadcast(many.groupBy(key).count().where(F.col("count") * HOT > n).select(key))
    rest = many.join(hot, key, "left_anti").join(one, key)
    return many.join(F.broadcast(one.join(hot, key, "left_semi")), key).unionByName(rest)


def resolution(heads: DataFrame, least: int = 100) -> DataFrame:
    """(record_id, refers_id, refers_page, refers_url) of the records that are to be revisits, by their headers (a written table); refers_* null where no archive has the original."""
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url")
    first = heads.where("record_type = 'response'").groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    originals = written(first.select("payload_digest", "first.page_id", "first.record_id", "first.url", "n").selectExpr("payload_digest", "record_id AS refers_id", "page_id AS refers_page", "url AS refers_url", "n"), "warc-originals")
    asked = written(heads.where(f"record_type = 'revisit' OR payload_bytes >= {least}").select("record_id", "record_type", "payload_digest"), "warc-headers")
    found = met(asked, originals, "payload_digest").where("record_type = 'revisit' OR record_id <> refers_id")
    lost = asked.where("record_type = 'revisit'").join(originals, "payload_digest", "left_anti").selectExpr("record_id", "CAST(null AS string) AS refers_id", "CAST(null AS bigint) AS refers_page", "CAST(null AS string) AS refers_url")
    return found.select("record_id", "refers_id", "refers_page", "refers_url").unionByName(lost)


def _field(name: str, value: Column) -> Column:
    """A header line; none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write(records: DataFrame, heads: DataFrame, revisits: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write an archive of records (record_id, payload) with fresh headers, as revisits where `revisits` says so."""
    about = heads.select("record_id", "page_id", "url", "payload_bytes", "payload_digest").join(revisits.withColumn("again", F.lit(True)), "record_id", "left")
    rows = records.select("record_id", "payload").join(about, "record_id")
    again = F.coalesce("again", F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _field("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))  # the bytes as they are
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn(F.col("record_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _field("WARC-Profile", F.when(again, PROFILE)),
        _field("WARC-Refers-To", F.when(again, urn(F.col("refers_id")))),
        _field("WARC-Refers-To-Target-URI", F.when(again, _uri(F.col("refers_url")))),
        _field("Page-Id", F.col("page_id").cast("string")),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    # a record ends with two line ends, the last line feed of which is the writer's
    text = F.concat(head, F.lit(CRLF), http, body, F.lit(f"{CRLF}\r"))
    rows.select(text.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, which may be packed as one gzip stream or as one for each record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        fields = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(size := int(fields["content-length"]))
        if len(block) < size:
            raise ValueError(f"{fields.get('warc-record-id')} is cut off")
        yield fields, block


def _length(http: bytes) -> int | None:
    """What the Content-Length of an HTTP header says."""
    for line in http.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    return None


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_id[, payload]) of the responses and revisits of the archives at path. A revisit's payload is null, its length what its HTTP header says."""
    types = {"record_id": pa.string(), "record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_id": pa.string()} | ({"payload": pa.binary()} if payload else {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=list(types))
            out, size = [], 0
            return made

        for files in batches:
            for content in files.column("content"):
                for fields, block in parsed(content.as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    n = _length(http)
                    if kind == "response":
                        own = hashlib.sha256(body).hexdigest()
                        if digest not in (None, own):
                            raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't that of its digest")
                        digest, n = own, len(body)
                    page = fields.get("page-id")
                    row = [fields["warc-record-id"][10:-1], kind, int(page) if page else None, fields.get("warc-target-uri"), n, digest, fields["warc-refers-to"][10:-1] if "warc-refers-to" in fields else None]
                    out.append([*row, body if kind == "response" else None] if payload else row)
                    size += 500 + len(body) * payload
                    if size >= BATCH_BYTES:
                        yield batch()
        if out:
            yield batch()

    schema = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_id string" + ", payload binary" * payload
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def resolved(heads: DataFrame) -> DataFrame:
    """heads (a written table) with refers_to, the page_id of the response that a revisit refers to, and with that response's length and digest."""
    own = ["record_id", "page_id", "url", "record_type"]
    back = heads.where("record_type = 'revisit'")
    originals = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    found = met(back.select(*own, "refers_id"), originals, "refers_id").select(*own, "payload_bytes", "payload_digest", "refers_to")
    lost = back.join(originals.select("refers_id"), "refers_id", "left_anti")
    none = F.lit(None).cast("long").alias("refers_to")
    return heads.where("record_type = 'response'").select(*own, "payload_bytes", "payload_digest", none).unionByName(found).unionByName(lost.select(*own, "payload_bytes", "payload_digest", none))


def deduplicated(spark: SparkSession, source: str, target: str, least: int = 100) -> None:
    """Write the archives at source anew at target: each payload once, revisits resolved against all of them."""
    heads = written(read(spark, source, payload=False).drop("refers_id"), "warc-headers")
    write(read(spark, source), heads, resolution(heads, least), target)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    heads = written(headers(records), "warc-headers")
    path = f"{scratch_dir(spark).rstrip('/')}/rolemesh/warc-{uuid.uuid4().hex}"
    write(records, heads, resolution(heads), path)
    back = resolved(written(read(spark, path, payload=False), "warc-headers"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS k FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND k > 1 THEN first END AS refers_to, url FROM f
"""
