"""ARC files of both versions, their conversion, and the round trip of pages."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.llm import warc
from tablewright.llm.common import scratch


def arc_file(version, records, packed):
    intro = f"{version} 0 origin\n{warc.ARC_FIELDS[version]}\n".encode()
    parts = [f"filedesc://old.arc 0.0.0.0 19990102030405 text/plain {len(intro)}\n".encode() + intro + b"\n"]
    for url, block in records:
        middle = "1.2.3.4 19990102030405 text/html"
        if version == 2:
            middle += " 200 - - 17 old.arc"
        parts.append(f"{url} {middle} {len(block)}\n".encode() + block + b"\n")
    return b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [True, False])
def test_header_lines_by_version(version, packed):
    records = [("http://a.example/", b"HTTP/1.0 200 OK\r\n\r\nbody\n\nhttp://x 1 2 3 4\n"), ("dns:b c", b""), ("http://é.example/", b"plain")]
    found = list(warc.read_arc(arc_file(version, records, packed)))
    assert [(r.fields["URL"], r.block) for r in found] == records
    assert {r.archive for r in found} == {"old.arc"} and found[0].date == "1999-01-02T03:04:05Z"
    assert found[0].parts()[1].startswith(b"body") and found[2].parts() == (b"", b"plain")
    assert len({r.record_id for r in found}) == 3
    assert not any(r.truncated for r in found)


def test_records_cut_short_and_broken_lines():
    raw = arc_file(1, [("http://a/", b"0123456789")], False)
    assert [(r.block, r.truncated) for r in warc.read_arc(raw[:-5])] == [(b"012345", True)]
    assert b"WARC-Truncated: length" in warc.warc_record(next(warc.read_arc(raw[:-5])), None)
    with pytest.raises(PrepareError):
        list(warc.read_arc(b"no header at all\n"))
    assert list(warc.read_arc(b"\n")) == []


def test_bytes_behind_members_are_not_lost():
    whole = arc_file(1, [("http://a/", b"one"), ("http://b/", b"two")], True)
    assert len(list(warc.read_arc(whole + b"\n"))) == 2
    second = whole.rindex(b"\x1f\x8b")
    for bad in (whole[:second] + b"\n" + whole[second:], whole + b"\n\n", whole + b"rest", whole[:-3], whole[:second] + whole[second : second + 12]):
        with pytest.raises(PrepareError):
            list(warc.read_arc(bad))


def test_types_and_digests():
    raw = arc_file(1, [("http://a/", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody"), ("dns:a", b"text")], True)
    page, name = warc.read_arc(raw)
    fields, block = next(warc.read_warc(warc.warc_record(page, None)))
    assert fields["warc-type"] == "response" and block == page.block
    assert fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"body").hexdigest()
    fields, block = next(warc.read_warc(warc.warc_record(page, ("<urn:uuid:1>", "http://b/", "2000-01-01T00:00:00Z"))))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:uuid:1>"
    assert block == b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n"
    fields, _ = next(warc.read_warc(warc.warc_record(name, None)))
    assert fields["warc-type"] == "resource"


def round_trip(spark, df, **kw):
    arcs, warcs = scratch(spark, "test-arc"), scratch(spark, "test-warc")
    warc.write_arc(df, arcs, **kw)
    warc.arc_to_warc(spark, arcs, warcs)
    return warc.read_records(spark, warcs)


@pytest.mark.parametrize("version", [1, 2])
def test_pages_there_and_back(spark, version):
    long, hundred = "x\r\n\r\nWARC/1.1\r\n" * 40_000, "é" * 50
    rows = [(k, "http://e/ a\n", f"page {k} " * 30) for k in range(50)]
    rows += [(100, None, hundred), (99, "u", hundred), (98, "", hundred), (97, "u", hundred[:-1]), (96, "u", hundred[:-1])]
    rows += [(200, "u", None), (201, "u", ""), (None, "u", hundred), (300, "u", long), (301, "u", long), (301, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(4)
    found = round_trip(spark, df, version=version, file_bytes=20_000)
    first, got = {98: 98, 300: 300}, []
    for r in found.collect():
        got.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    wanted = []
    for key, _, html in rows:
        body = (html or "").encode()
        to = {hundred: 98, long: 300}.get(html) if key is not None else None
        revisit = to is not None and key != first.get(to)
        wanted.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    urls = {r["url"] for r in found.collect()}
    assert urls == {"http://e/%20a%0A", "-", "u"}


def test_a_repeated_smallest_id(spark):
    rows = [(1, "u", "y" * 200)] * 2
    found = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in found) == [("response", None), ("revisit", 1)]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(spark, df).count() == 0
