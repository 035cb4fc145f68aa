import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from tessera.llm.queries import captures
from tessera.llm.warc import assemble, left_over, parse, read_records, write_archive
from tests.conftest import SF001

ROWS = [
    (1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>x</p>"),
    (5, "http://f\r\nX: y", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "http://g", "é😀" * 40_000), (7, "u", "\r\n\r\n"), (2, None, "<p>x</p>"), (None, None, None),
]
TYPES = "page_id long, url string, html string"


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), top if len(body) >= least else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, tmp_path, least):
    write_archive(spark.createDataFrame(ROWS, TYPES), str(tmp_path / "w"), least=least)
    records = read_records(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(ROWS) and left_over(records).count() == 0
    got = captures(records).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == [x[:3] for x in expected(ROWS)]
    responses = [r for r in got if r.record_type == "response"]
    big = [r for r in responses if r.payload_bytes >= least]
    assert len(big) == len({r.payload_digest for r in big})
    assert all(r.record_type == "response" for r in got if r.payload_bytes < least)
    tops = {d: t for _, n, d, t in expected(ROWS, least)}
    assert all(r.refers_to == tops[r.payload_digest] for r in got if r.record_type == "revisit")
    assert {r.capture.payload for r in assemble(records).collect() if r.capture.warc_type == "response"} == {(h or "").encode() for _, _, h in ROWS}


def test_files_are_warc(spark, tmp_path):
    write_archive(spark.createDataFrame(ROWS, TYPES).coalesce(1), str(tmp_path / "w"))
    found = []
    for f in (tmp_path / "w").glob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        found += list(parse(io.BytesIO(raw)))
        assert not raw or raw.endswith(b"\r\n\r\n")
    assert len(found) == 3 * len(ROWS)
    assert all("\n" not in v for h, _ in found for v in h.values())


def test_missing_and_further_records(spark, tmp_path):
    def rec(kind, i, to=None):
        block = b"a: 1"
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {i}", f"Content-Length: {len(block)}", "Content-Type: application/warc-fields"] + ([f"WARC-Concurrent-To: {to}"] if to else [])
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    records = [rec("warcinfo", "i"), rec("response", "c1"), rec("metadata", "m2", "c1"), rec("metadata", "m1", "c1"), rec("request", "r1", "c9"), rec("response", "c2")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # a member for each record
    read = read_records(spark, str(tmp_path / "w"))
    got = {r.capture.record_id: r for r in assemble(read).collect()}
    assert (got["c1"].metadata.record_id, got["c1"].n_metadata, got["c1"].request) == ("m1", 2, None)
    assert (got["c2"].metadata, got["c2"].n_requests) == (None, 0)
    assert {r.record_id for r in left_over(read).collect()} == {"i", "m2", "r1"}


def record(kind, i, to=(), block=b"a: 1", content="application/warc-fields", **more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {i}", f"Content-Length: {len(block)}", f"Content-Type: {content}"]
    lines += [f"WARC-Concurrent-To: {x}" for x in to] + [f"{k}: {v}" for k, v in more.items()]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_plain_archives_and_other_names(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(record("response", "c1") + record("metadata", "m1", ["c1"]))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(record("response", "c2") + record("metadata", "m2", ["c2"])))
    (tmp_path / "w" / "c").write_bytes(gzip.compress(record("response", "c3")) + gzip.compress(record("request", "r3", ["c3"])))
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    read = read_records(spark, str(tmp_path / "w"))
    assert sorted(r.record_id for r in read.collect()) == ["c1", "c2", "c3", "m1", "m2", "r3"]
    got = {r.capture.record_id: r for r in assemble(read).collect()}
    assert (got["c1"].metadata.record_id, got["c2"].metadata.record_id, got["c3"].request.record_id) == ("m1", "m2", "r3")
    (tmp_path / "w" / "odd.txt").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no WARC record"):
        read_records(spark, str(tmp_path / "w")).count()


def test_either_side_names_the_other(spark, tmp_path):
    rows = [
        record("response", "c1", ["r1", "m1"]), record("request", "r1"), record("metadata", "m1"), record("metadata", "m2", ["c1"]),
        record("response", "c2"), record("request", "r2", ["c2", "c3"]), record("revisit", "c3", ["r2"], **{"warc-type": "response"}), record("metadata", "m9", ["c8"]),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(rows))
    read = read_records(spark, str(tmp_path / "w"))
    got = {r.capture.record_id: r for r in assemble(read).collect()}
    assert (got["c1"].request.record_id, got["c1"].metadata.record_id, got["c1"].n_requests, got["c1"].n_metadata) == ("r1", "m1", 1, 2)
    assert got["c1"].concurrent_ids == ["m1", "m2", "r1"]
    assert got["c2"].request.record_id == got["c3"].request.record_id == "r2" and got["c3"].capture.warc_type == "revisit"
    assert {r.record_id for r in left_over(read).collect()} == {"m2", "m9"}


def test_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x", "d", 5, "r")], TYPES + ", digest string, bytes long, record string").withColumnRenamed("record", "first")
    write_archive(pages, str(tmp_path / "w"))
    assert [(r.page_id, r.payload_bytes) for r in captures(read_records(spark, str(tmp_path / "w"))).collect()] == [(1, 1)]


def test_pages_and_empty_table(spark, tmp_path):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    write_archive(pages, str(tmp_path / "w"))
    got = captures(read_records(spark, str(tmp_path / "w"))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == [x[:3] for x in expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])]
    write_archive(pages.limit(0), str(tmp_path / "none"))
    assert captures(read_records(spark, str(tmp_path / "none"))).count() == 0
