"""WARC archives: writing captures, reading records back, and assembling transactions.

A capture is three records: the request, the response (or a revisit of an equal
payload), and metadata.  Request and metadata name the response in
``WARC-Concurrent-To``.

Writing is a Spark text sink, gzipped, so archives go to any file system that Spark
writes to, and a lost task is written anew.  Each task fills an archive up to the
target by a running sum of bytes, so an archive holds at most the target and one
more capture.  (The sink makes one gzip member of an archive, not one a record.)
Reading parses whole archives by their length fields, one archive per row, so
payloads may hold anything, separators included.

Assembly joins response, request and metadata through the identifiers (in one
shuffle, keyed by the response's identifier) and gives one nested row per capture.
A revisit names the response's record in ``WARC-Refers-To``; what it says about the
payload is joined from that record.

Defined results: null html is an empty payload, null url an empty target; line
ends in a url are percent-encoded; every input row is one capture, repeated rows
included (of rows with the least page_id of a payload one is the response, and the
others revisit it); a null page_id stays null and is never the response that others
revisit.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import runtime

CRLF = "\r\n"
MIN_REVISIT_BYTES = 100
SALTS = 16
TARGET_BYTES = 32 << 20
DATE = "2026-03-02T00:00:00Z"


def planned(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds row, payload, payload_bytes, payload_digest, record_type, and first_id and first_row of what a revisit refers to.

    Equal payloads are found by digest: the least page_id of each is a partial
    aggregate, and only digests that occur twice are joined back, over ``SALTS``
    copies so that one payload with a third of all rows is joined by many tasks.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = (
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
        .withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
        .withColumn("payload_digest", F.sha2("payload", 256))
    )
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")
    groups = base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null")
    salted = groups.select(F.col("payload_digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    joined = base.join(salted, (F.col("payload_digest") == F.col("d")) & (F.pmod(F.xxhash64("row"), F.lit(SALTS)) == F.col("s")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row"))
    return joined.select(
        "page_id", "url", "row", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("first_id"), F.when(revisit, F.col("first_row")).alias("first_row"),
    )


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def _record(kind: Column, record_id: Column, target: Column, headers: list[tuple[str, Column]], block: list[Column], size: Column) -> list[Column]:
    """The parts of a record, to be put together once (payloads may be long)."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), target)]
    lines += [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]  # a null header is left out
    lines.append(F.concat(F.lit("Content-Length: "), size.cast("string")))
    return [F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), *block]


def records(captures: DataFrame) -> DataFrame:
    """One row ``value`` per capture: its three records, each but the last followed by the blank lines that end it."""
    key = [F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("row").cast("string")]
    response_id = _urn(F.lit("response"), *key)
    referred = F.when(F.col("first_row").isNotNull(), _urn(F.lit("response"), F.col("first_id").cast("string"), F.col("first_row").cast("string")))
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    path = F.regexp_replace(target, r"^[^:/?#]*://[^/?#]*", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    get = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record(
        F.lit("request"), _urn(F.lit("request"), *key), target, [("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/http; msgtype=request"))], [get], F.octet_length(get)
    )
    response = _record(
        F.col("record_type"), response_id, target,
        [
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", referred),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ],
        [http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))],
        F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")),
    )
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF))
    fields = F.concat(*(F.coalesce(field(name, F.col(c)), F.lit("")) for name, c in (("pageId", "page_id"), ("payloadBytes", "payload_bytes"))))
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), *key), target, [("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))], [fields], F.octet_length(fields))
    end = F.lit(CRLF + CRLF)
    return captures.select(F.concat(*request, end, *response, end, *metadata).alias("value"))


def write(captures: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> None:
    """Archives of about ``target_bytes`` (before compression) below ``path``."""
    end = (CRLF + CRLF).encode()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = lambda held: pa.record_batch([pa.array([end.join(held)], pa.binary()).cast(pa.string())], ["value"])
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                held.append(value.as_buffer().to_pybytes())
                size += len(held[-1])
                if size >= target_bytes:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    records(captures).mapInArrow(filled, "value string").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


_RECORD = "record_type string, record_id string, concurrent_to string, target_uri string, header_digest string, refers_to string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def parse(data: bytes, archive: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; raises on a malformed archive."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at} of {archive}")
        headers = {}
        for line in data[at:head].decode("utf-8").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = data[head + 4 : head + 4 + size]
        at = head + 4 + size
        if len(block) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of {archive} does not end where its length says")
        yield headers, block
        at += 4


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``."""
    schema = _RECORD + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for headers, block in parse(gzip.decompress(content.as_buffer()), name):
                    kind = headers["warc-type"]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    full = kind == "response"
                    fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode().split(CRLF) if ":" in line] if kind == "metadata" else []
                    rows.append(
                        (kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                         headers.get("warc-refers-to"), len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else None, fields, payload if full and with_payload else None)
                    )
                kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
                yield pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(parsed, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), request and metadata, joined through concurrent-to.

    The three kinds meet on the response's identifier in one shuffle of the
    records; of several records of a kind the one with the least identifier counts.
    """
    payload = [c for c in records.columns if c == "payload"]
    kind = F.col("record_type")
    own = F.when(kind.isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))

    def part(chosen: Column, *columns: str) -> Column:
        return F.min_by(F.struct(*columns), F.when(chosen, F.col("record_id")))

    main = kind.isin("response", "revisit")
    captures = records.withColumn("capture", own).groupBy("capture").agg(
        part(main, "record_type", "record_id", "target_uri", "header_digest", "refers_to", "payload_bytes", "payload_digest", *payload).alias("response"),
        part(kind == "request", "record_id", "target_uri").alias("request"),
        part(kind == "metadata", "record_id", "fields").alias("metadata"),
    )
    return captures.where("response is not null")


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    runtime.shared_folder(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"warc-{uuid.uuid4().hex}")


def roundtrip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them back, and gives what the assembled captures say."""
    spark = pages.sparkSession
    path = path or archive_folder(spark)
    write(planned(pages), path)
    field = lambda name: F.col("metadata.fields")[name].cast("bigint")
    # Used three times below: settled, so that the archives are read once.
    told = runtime.settled(assemble(read(spark, path)).select(
        field("pageId").alias("page_id"), field("payloadBytes").alias("told_bytes"), "response.record_type", "response.record_id", "response.header_digest",
        "response.refers_to", "response.payload_bytes", "response.payload_digest", F.pmod(F.xxhash64("response.record_id"), F.lit(SALTS)).cast("int").alias("salt"),
    ))
    # One response may be referred to by a third of all rows, so it is met in SALTS tasks.
    asked = told.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    origin = told.join(asked, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("origin_id"), F.col("payload_bytes").alias("origin_bytes"), F.col("payload_digest").alias("origin_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    captures = told.join(origin, ["refers_to", "salt"], "left")
    digest, size = F.coalesce("payload_digest", "origin_digest"), F.coalesce("payload_bytes", "origin_bytes")
    same = (digest == F.col("header_digest")) & (size == F.col("told_bytes"))
    checked = F.when(F.coalesce(same, F.lit(False)), digest).otherwise(F.raise_error(F.lit("a payload is not what its headers say")))
    return captures.select("page_id", size.alias("payload_bytes"), checked.alias("payload_digest"), "record_type", F.col("origin_id").alias("refers_to"))
