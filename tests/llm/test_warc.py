import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sievework.llm import warc
from sievework.session import new_path

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2 b\nc", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://a/5", "x" * 700_000),
         (6, "http://a/6", "WARC/1.1\r\n\r\n"), (None, "http://a/7", "<p>é</p>"), (8, "http://a/8", "lone"), (8, "http://a/8", "lone")]
SCHEMA = "page_id long, url string, html string, sha string, keep long, hit string"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "s", 1, "h") for p in PAGES], SCHEMA)


def digest(html):
    return "sha1:" + base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, pages):
    got = warc.read_archive(spark, warc.archive(pages), verify=True).collect()
    assert len(got) == len(PAGES)
    for r in got:
        key = r.record_id.removeprefix("urn:x-page:")
        html = next(h for k, _, h in PAGES if str(k).replace("None", "null") == key) or ""
        same = [k for k, _, h in PAGES if (h or "") == html and k is not None]
        assert r.payload_length == len(html.encode()) and r.payload_digest == digest(html)
        assert r.content_type == "text/html; charset=utf-8"
        if str(max(same)) == key:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, html.encode())
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", f"urn:x-page:{max(same)}", None)
    assert sorted(r.record_type for r in got).count("revisit") == 3


def test_small_payloads_are_all_responses(pages):
    got = {(r.record_id, r.record_type) for r in warc.records(pages, min_bytes=8).collect()}
    assert ("urn:x-page:3", "response") in got and ("urn:x-page:1", "revisit") in got


def test_predicates_reach_the_reader(spark, pages):
    path = warc.archive(pages)
    df = warc.read_archive(spark, path, "record_type string, record_id string, target_uri string, payload binary")
    assert {r.record_id for r in df.filter("record_type = 'revisit'").collect()} == {"urn:x-page:1", "urn:x-page:3", "urn:x-page:null"}
    assert df.filter(F.col("target_uri").startswith("http://a/") & (F.col("record_type") == "response")).count() == 5
    assert df.filter("record_id in ('urn:x-page:5', 'urn:x-page:9')").count() == 1
    assert df.filter("target_uri is null").count() == 2
    plan = df.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and not re.search(r"\bFilter\b", plan)


def test_content_type_is_that_of_the_http_header(spark, pages):
    df = warc.read_archive(spark, warc.archive(pages))
    assert df.filter("content_type = 'text/html; charset=utf-8'").count() == len(PAGES)
    assert df.filter("content_type = 'text/html; charset=utf-8' and record_type = 'revisit'").count() == 3
    assert df.filter("content_type like 'application/http%' or content_type is null").count() == 0
    assert df.filter(F.col("content_type").startswith("application/http")).count() == 0


def test_unwanted_payloads_are_not_inflated(pages, monkeypatch):
    path = warc.archive(pages)
    inflated = []
    real = warc._Member.block
    monkeypatch.setattr(warc._Member, "block", lambda self: inflated.append(1) or real(self))
    reader = warc.WarcReader(path, ["record_id", "payload_length"], False, 1 << 20)
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == len(PAGES) and not inflated
    reader = warc.WarcReader(path, ["payload"], False, 1 << 20)
    list(reader.pushFilters([warc.ds.EqualTo(("record_id",), "urn:x-page:5")]))
    assert [len(r[0]) for p in reader.partitions() for r in reader.read(p)] == [700_000] and len(inflated) == 1


def test_files_roll_over_and_lost_attempts_are_not_read(spark, pages):
    path = new_path(spark, "warc")
    warc.register(spark)
    warc.records(pages).write.format("warc").option("file_bytes", 200).mode("append").save(path)
    store, folder = warc._store(path)
    with store.open_output_stream(f"{folder}/part-lost.warc.gz", compression=None) as out:
        out.write(b"not committed")
    reader = warc.WarcReader(path, ["record_id"], False, 500)
    plan = reader.partitions()
    assert len(plan) > 1 and not any("lost" in f for p in plan for f in p.files)
    assert spark.read.format("warc").load(path).count() == len(PAGES)


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_files(spark, tmp_path, packed):
    def record(kind, uri, body):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\n"
                f"Content-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    data = [record("warcinfo", "i", b"software: x"), record("resource", "a", b"y" * 100_000), record("resource", "b", b"")]
    file = tmp_path / ("f.warc.gz" if packed else "f.warc")
    file.write_bytes(b"".join(map(gzip.compress, data) if packed else data))
    got = warc.read_archive(spark, str(tmp_path)).filter("record_type = 'resource'").collect()
    assert [(r.target_uri, len(r.payload)) for r in got] == [("a", 100_000), ("b", 0)]


def test_a_wrong_digest_is_found(spark, tmp_path):
    row = {"record_type": "response", "record_id": "urn:a", "payload": b"abc", "payload_digest": digest("abd")}
    (tmp_path / "a.warc.gz").write_bytes(warc._member(warc._record(row)))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path), verify=True).collect()


def test_empty_table(spark, pages):
    assert warc.read_archive(spark, warc.archive(pages.limit(0))).collect() == []
