import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from censora.llm import warc
from censora.llm.queries import QUERIES


def digest(payload):
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


ROWS = [
    (1, "http://a/1", "<html>é</html>"),
    (2, "http://a/2\r\nX: y", "<html>é</html>"),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/5", "x" * 300_000),
    (5, "http://a/5", "x" * 300_000),
    (None, "http://a/none", "<html>é</html>"),
    (None, "http://a/alone", "alone"),
    (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n\r\n"),
]
DDL = "page_id long, url string, html string"
ALL = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"


@pytest.fixture
def written(spark, tmp_path):
    def write(rows, **options):
        path = str(tmp_path / "warc")
        warc.write_pages(spark.createDataFrame(rows, DDL).withColumn("payload", F.lit("clash")).repartition(2), path, **options)
        return path

    return write


def test_round_trip(spark, written):
    got = {(r["record_id"], r["record_type"], r["refers_to"], r["http_length"], r["payload_digest"], bytes(r["payload"])) for r in warc.read_pages(spark, written(ROWS), ALL).collect()}
    want = set()
    for page, _, html in ROWS:
        body = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "").encode() == body and p is not None]
        to = max(ids) if ids and page != max(ids) else None
        urn = f"urn:x-page:{'' if page is None else page}"
        want.add((urn, "revisit" if to else "response", f"urn:x-page:{to}" if to else None, len(body), digest(body), b"" if to else body))
    assert got == want


def test_addresses_stay_on_one_line(spark, written):
    uris = {r[0] for r in warc.read_pages(spark, written(ROWS), "target_uri string").collect()}
    assert "http://a/2%0D%0AX: y" in uris and None in uris


def test_small_payloads_need_no_revisit(spark, written):
    kinds = [r[0] for r in warc.read_pages(spark, written(ROWS, min_bytes=1_000_000), "record_type string").collect()]
    assert kinds == ["response"] * len(ROWS)


def test_predicates_are_pushed_and_payloads_skipped(spark, written, monkeypatch):
    path = written(ROWS)
    df = warc.read_pages(spark, path, "record_id string, record_type string, payload_digest string")
    picked = df.where((F.col("record_type") == "revisit") & F.col("payload_digest").isin(digest("<html>é</html>".encode()), "none"))
    assert sorted(r["record_id"] for r in picked.collect()) == ["urn:x-page:", "urn:x-page:1"]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    # Without the payload no block is inflated to its end.
    asked = []
    real = warc.zlib.decompressobj

    class Spy:
        def __init__(self, *a):
            self.inner = real(*a)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def decompress(self, data, limit):
            got = self.inner.decompress(data, limit)
            asked.append(len(got))
            return got

    monkeypatch.setattr(warc.zlib, "decompressobj", Spy)
    reader = warc.WarcReader(path, df.schema, warc.PARTITION_BYTES)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len(ROWS) and sum(asked) < 40_000


def test_archives_of_others(spark, tmp_path):
    plain = b"".join(warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x:{i}>"), ("Content-Type", "text/plain")], b"body %d" % i * 400) for i in range(3))
    (tmp_path / "a.warc").write_bytes(plain)
    members = b"".join(gzip.compress(warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:y:{i}>")], b"info" * 9000)) for i in range(3))
    (tmp_path / "b.warc.gz").write_bytes(members)
    rows = warc.read_pages(spark, str(tmp_path), "record_id string, content_length long, payload binary").collect()
    assert sorted((r["record_id"], r["content_length"], bytes(r["payload"][:6])) for r in rows) == [(f"urn:x:{i}", 2400, b"body %d" % i) for i in range(3)] + [
        (f"urn:y:{i}", 36_000, b"infoin") for i in range(3)
    ]


def test_partitions_by_size_and_unlisted_files(spark, written, tmp_path):
    path = written(ROWS)
    written(ROWS[:2])  # appended
    with open(f"{path}/left-by-a-lost-task.warc.gz", "wb") as file:
        file.write(warc.member(warc.record([("WARC-Type", "response")], b"")))
    reader = warc.WarcReader(path, spark.createDataFrame([], "record_type string").schema, 1)
    assert len(reader.partitions()) == len([p for part in reader.partitions() for p in part.paths]) >= 2
    assert not any("lost" in p for part in reader.partitions() for p in part.paths)


def test_empty_table(spark, written):
    path = written([])
    assert warc.read_pages(spark, path).collect() == []


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"].encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op5_warc"](spark, folder).collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows} == {(i, len(b), digest(b)[5:]) for i, b in pages.items()}
