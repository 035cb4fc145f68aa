"""WARC archives: writing captures with revisits, reading records, and putting transactions together.

``write_archive`` writes a request, a response or revisit, and a metadata record for every page; the last two name the
capture in WARC-Concurrent-To.  Spark's text writer makes the files (a record is one "line" that ends in CRLF CRLF), so
they go to any file system and only committed tasks leave files.  ``read_records`` parses archives by Content-Length.
``assemble`` joins request and metadata records to the capture that they are concurrent to and emits one nested row per
capture; payloads that a query doesn't use are pruned before the joins.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrange

CRLF = "\r\n"
#: Records in one file, which bounds what a reading task holds together with the pages' size.
FILE_RECORDS = 12_000
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, uri string, date string, content_type string, "
    "payload_digest string, payload_bytes long, head string, payload binary, fields map<string,string>")
_FIVE_BITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every 5 hex digits are 4 digits of base 32."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _FIVE_BITS, _BASE32)


def _urn(kind: str, *parts: Column) -> Column:
    digits = F.md5(F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, headers: dict[str, Column | str | None], block: Column) -> Column:
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}")]
    for name, value in headers.items():
        lines.append(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value))  # a null line is left out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``pages`` as gzipped WARC files into the folder ``path``.

    Of payloads (UTF-8; null: empty) that are equal and of at least ``least`` bytes, the row with the largest id is the
    response (of rows that also share the id, that with the largest place); the others are revisits of it.  A null id is
    smaller than any other and leaves no page-id line; a null URI becomes ``urn:none``; control characters and spaces of
    a URI are written as %20.  An empty table leaves an archive without records."""
    rows = arrange(pages, {id_col: "id", uri_col: "uri", payload_col: "payload"}, text=None).drop("block")
    rows = rows.withColumns({
        "payload": F.coalesce(F.col("payload").cast("string"), F.lit("")),
        "uri": F.coalesce(F.regexp_replace(F.col("uri").cast("string"), r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none"))})
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": base32_sha1(F.col("payload"))})
    place = F.struct("id", "row_file", "row_no")
    first = rows.select("digest", "bytes", place.alias("place")).where(F.col("bytes") >= least).groupBy("digest").agg(F.max("place").alias("first"))
    rows = rows.join(first, "digest", "left")

    same = F.col("first").isNull() | ((F.col("first.row_file") == F.col("row_file")) & (F.col("first.row_no") == F.col("row_no")))
    own, to = _urn("capture", F.col("row_file"), F.col("row_no")), _urn("capture", F.col("first.row_file"), F.col("first.row_no"))
    common = {"WARC-Date": date, "WARC-Target-URI": F.col("uri")}
    head = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", "Content-Length: "])), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    http = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    response = _record("response", {"WARC-Record-ID": own, **common, **http, "Content-Type": "application/http;msgtype=response"}, F.concat(head, F.col("payload")))
    revisit = _record("revisit", {"WARC-Record-ID": own, **common, **http, "WARC-Refers-To": to, "WARC-Profile": REVISIT, "Content-Type": "application/http;msgtype=response"}, head)
    asked = F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF * 2}"))
    request = _record("request", {"WARC-Record-ID": _urn("request", F.col("row_file"), F.col("row_no")), **common, "WARC-Concurrent-To": own, "Content-Type": "application/http;msgtype=request"}, asked)
    noted = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.lit("via: table"))
    metadata = _record("metadata", {"WARC-Record-ID": _urn("metadata", F.col("row_file"), F.col("row_no")), **common, "WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"}, noted)
    records = rows.select(F.explode(F.array(request, F.when(same, response).otherwise(revisit), metadata)).alias("record"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            key, text = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
            if key == "warc-concurrent-to" and key in out:
                out[key] += f" {text}"
            else:
                out.setdefault(key, text)
    return out


def parse(f: io.BufferedIOBase):
    """Records of one archive: (headers, block). Stops with an error where the bytes are no WARC record."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        head = []
        while (line := f.readline()).strip():
            head.append(line.rstrip(b"\r\n"))
        fields = _fields(b"\r\n".join(head))
        size = int(fields["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def _row(h: dict[str, str], block: bytes) -> tuple:
    kind, head, payload, fields = h.get("warc-type"), None, block, {}
    http = h.get("content-type", "").startswith("application/http")
    if http:
        top, _, payload = block.partition(b"\r\n\r\n")
        head, fields = top.decode("utf-8", "replace"), _fields(top)
    elif h.get("content-type", "").startswith("application/warc-fields"):
        fields = _fields(block)
    given = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind == "revisit":  # the payload is elsewhere
        digest, size, payload = given, int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None, None
    else:
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if kind == "response" and given not in (None, digest):
            raise ValueError(f"{h.get('warc-record-id')}: payload digest is {digest}, not {given}")
    return (kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), digest, size, head, payload, list(fields.items()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder, columns as in ``RECORDS``.  All files are read, plain and gzipped ones,
    whatever their names, but for hidden ones and ``_SUCCESS``; a file that is no archive is an error.  Of a repeated header
    the first counts, but for WARC-Concurrent-To, whose values are joined by a space."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def read(batches):
        types = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for cell in b.column(0):
                raw = cell.as_buffer()
                f = pa.BufferReader(raw)
                f = io.BufferedReader(gzip.GzipFile(fileobj=f) if raw.slice(0, 2).to_pybytes() == b"\x1f\x8b" else f, 1 << 20)
                rows, size = [], 0
                for h, block in parse(f):
                    rows.append(_row(h, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(read, RECORDS)


def _named(records: DataFrame) -> DataFrame:
    """(record_id, other) for every WARC-Concurrent-To, as it stands."""
    return records.select("record_id", F.explode(F.split("concurrent_to", " ")).alias("other")).where("record_id is not null and other <> ''")


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: ``capture``, ``request`` and ``metadata`` (nested records, null where missing) with
    ``n_requests``, ``n_metadata`` and ``concurrent_ids``, the ids of all requests and metadata records of the capture.

    A record belongs to a capture that it names in WARC-Concurrent-To, or that names it.  Of several requests or metadata
    records the one with the smallest record id is nested; the others are listed by id, and ``left_over`` has them whole, so
    no group of records is collected."""
    row = F.struct(*[F.col(c) for c in records.columns])
    capture = F.col("warc_type").isin("response", "revisit")
    out = records.where(capture).select(F.col("record_id").alias("to"), row.alias("capture"))
    links = _named(records.where(~capture)).select(F.col("record_id").alias("side_id"), F.col("other").alias("to"))
    links = links.unionByName(_named(records.where(capture)).select(F.col("other").alias("side_id"), F.col("record_id").alias("to"))).distinct()
    sides = records.where(F.col("warc_type").isin("request", "metadata")).select(F.col("record_id").alias("side_id"), "warc_type", row.alias("row"))
    met = links.join(sides, "side_id").groupBy("to").agg(
        *[F.min_by(F.when(F.col("warc_type") == kind, F.col("row")), F.when(F.col("warc_type") == kind, F.col("side_id"))).alias(kind) for kind in ("request", "metadata")],
        *[F.count(F.when(F.col("warc_type") == kind, 1)).alias(n) for kind, n in (("request", "n_requests"), ("metadata", "n_metadata"))],
        F.sort_array(F.collect_set("side_id")).alias("concurrent_ids"))
    out = out.join(met, "to", "left")
    return out.select("capture", "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
                      F.coalesce("concurrent_ids", F.array().cast("array<string>")).alias("concurrent_ids"))


def left_over(records: DataFrame) -> DataFrame:
    """Records that no row of ``assemble`` holds: those concurrent to no capture, and further ones of a capture."""
    side = records.where(~F.col("warc_type").isin("response", "revisit") | F.col("warc_type").isNull())
    rows = assemble(records)
    held = rows.select(F.col("request.record_id").alias("record_id")).unionByName(rows.select(F.col("metadata.record_id").alias("record_id"))).where("record_id is not null")
    return side.join(held, "record_id", "left_anti")
