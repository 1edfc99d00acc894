"""WARC archives: written by Spark's text writer, read back, transactions assembled.

Per page a request, a response (or revisit) and a metadata record are written;
request and metadata name the response's record id in WARC-Concurrent-To. A
record ends with two line ends, which the text writer puts as its separator, so
the files are WARC/1.1, each one gzip member, in any store Spark can write. Files
are read whole (``binaryFile``), so the records per file follow the mean size, and
records are cut by Content-Length.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.frames import scratch, written

FILE_BYTES = 16 << 20  # before compression
MIN_REVISIT = 100
END = "\r\n"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, fields map<string,string>, payload binary"


def _head(kind: str, record_id: Column, uri: Column, content_type: str, more: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")),
             F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.when(uri != "", F.concat(F.lit("WARC-Target-URI: "), uri))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in more]  # concat_ws leaves nulls out
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), body)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` as WARC files below ``path``.

    Of records with equal payloads of at least ``min_revisit`` bytes, the one with
    the smallest id is a response and the others revisits without payload that
    refer to it; smaller payloads are always responses. Null payloads are empty,
    null urls leave out the target. Record ids name a row by its contents, so
    reruns write the same records and equal rows share an id.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("page"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "[\\x00-\\x20]", "%20").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    rows = rows.withColumn("capture", F.sha2(F.concat_ws("\n", F.coalesce("page", F.lit("-")), "uri", "digest"), 256))
    # the smallest id of each payload, as a number where ids are numbers; ties by capture
    rank = F.struct(F.col("page").isNull(), F.expr("try_cast(page AS decimal(38,0))"), F.col("page"), F.col("capture"))
    small = written(rows.filter(F.col("bytes") >= min_revisit).select("digest", "capture", rank.alias("rank")), "warc-digests")
    firsts = small.groupBy("digest").agg(F.min("rank").alias("m"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.filter("copies > 1").select("digest", F.col("m.capture").alias("first"))
    # payloads move once, by capture, so rows with one payload spread out
    again = small.join(firsts, "digest").filter("first <> capture").select("capture", "first").distinct()
    rows = rows.join(again, "capture", "left")
    revisit = F.col("first").isNotNull()
    rid = F.concat(F.lit("urn:capture:"), F.col("capture"), F.lit(":response"))
    first_id = F.concat(F.lit("<urn:capture:"), F.col("first"), F.lit(":response>"))
    status = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    uri = F.col("uri")
    response = _head("response", rid, uri, "application/http;msgtype=response", [("WARC-Payload-Digest", digest)], F.concat(status, F.col("payload")))
    repeat = _head("revisit", rid, uri, "application/http;msgtype=response", [
        ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", first_id)], status)
    to = [("WARC-Concurrent-To", F.concat(F.lit("<"), rid, F.lit(">")))]
    ask = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}User-Agent: rowsmith{END}{END}"))
    request = _head("request", F.concat(F.lit("urn:capture:"), F.col("capture"), F.lit(":request")), uri, "application/http;msgtype=request", to, ask)
    about = F.concat_ws(END, F.concat(F.lit("pageId: "), F.col("page")), F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string")), F.lit(""))
    metadata = _head("metadata", F.concat(F.lit("urn:capture:"), F.col("capture"), F.lit(":metadata")), uri, "application/warc-fields", to, about)
    count, total = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(payload) + 2000), F.lit(0)).cast("long")).first()
    per_file = max(3, 3 * file_bytes * count // max(1, total))
    records = rows.select(F.explode(F.array(request, F.when(revisit, repeat).otherwise(response), metadata)).alias("value"))
    records.write.options(lineSep=END + END, compression="gzip", maxRecordsPerFile=per_file).text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one WARC file, plain or gzip."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (head_end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:60]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = head_end + 4
        body = data[start : start + int(head["content-length"])]
        if len(body) < int(head["content-length"]):
            raise ValueError(f"record at byte {at} is cut short")
        at = start + len(body)
        while data[at : at + 2] == b"\r\n":
            at += 2
        kind, content = head.get("warc-type"), head.get("content-type", "")
        fields, payload = {}, None
        if content.startswith("application/warc-fields"):
            fields = dict(x.split(": ", 1) for x in body.decode().split("\r\n") if ": " in x)
        elif content.startswith("application/http") and kind == "response":
            payload = body.partition(b"\r\n\r\n")[2]
        yield {
            "record_id": head.get("warc-record-id", "").strip("<>"), "type": kind, "concurrent_to": head["warc-concurrent-to"].strip("<>") if "warc-concurrent-to" in head else None,
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "target_uri": head.get("warc-target-uri"),
            "payload_digest": head.get("warc-payload-digest"), "fields": list(fields.items()), "payload": payload,
        }


_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            rows: list[dict] = []
            size = 0
            for r in parse_records(data.as_py()):
                rows.append(r)
                size += len(r["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path``, one row each; an empty file has none."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, with the request and metadata concurrent to it.

    ``capture, target_uri, copies, response, request, metadata``. Records with
    one id are equal and count once; ``copies`` tells how many responses had the
    id. A response without request or metadata has null there; a record that is
    concurrent to no response is left out, as it belongs to no capture.
    """
    kind, answer = F.col("type"), F.col("type").isin("response", "revisit")
    capture = F.when(answer, F.col("record_id")).when(kind.isin("request", "metadata"), F.col("concurrent_to"))
    # length and hash are taken before the shuffle, so payloads move only where a caller asks for them
    own = records.select(
        "*", capture.alias("capture"), F.octet_length("payload").alias("payload_bytes"), F.when(kind == "response", F.sha2("payload", 256)).alias("payload_sha256"))
    fields = ["refers_to", "payload_digest", "payload_bytes", "payload_sha256", "payload"]

    def first_of(which: Column, value: Column) -> Column:
        return F.first(F.when(which, value), ignorenulls=True)

    beside = F.struct("record_id", "target_uri", "fields")
    found = own.filter("capture IS NOT NULL").groupBy("capture").agg(
        F.count_if(answer).alias("copies"), first_of(answer, kind).alias("kind"), first_of(answer, F.col("target_uri")).alias("uri"),
        *[first_of(answer, F.col(c)).alias(c) for c in fields], *[first_of(kind == k, beside).alias(k) for k in ("request", "metadata")])
    return found.filter("copies > 0").select(
        "capture", F.col("uri").alias("target_uri"), "copies", F.struct(F.col("kind").alias("type"), *fields).alias("response"), "request", "metadata")


def captures(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder, read it back and assemble it."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, **options)
    return assemble(read_records(spark, path))
