"""WARC bundles: exact round trips, records by identifier, and which of equal payloads are kept."""

import hashlib
import io

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkpulse.llm import warc

LONG = "<p>naïve 日本語 😀</p>" * 80
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2\r\nWARC-Type: x", LONG), (3, None, LONG), (3, None, LONG), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://b/ä b", "short"),
    (7, "http://b/7", "short"), (8, "http://b/8", "WARC/1.1\r\n\r\n" * 100), (9, "http://b/9", "x" * 3_000_000), (None, "http://b/none", LONG), (None, None, "y" * 999), (10, "u", "z" * 1000), (11, "u", "z" * 1000),
    (12, "u", "q" * 999), (13, "u", "q" * 999)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = "file://" + str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"key": F.lit("taken"), "body": F.lit("taken"), "_digest": F.lit("taken"), "payload": F.lit("taken")})
    warc.write_archive(pages.repartition(3), root)
    return root


def wanted() -> list[tuple]:
    last: dict = {}
    for key, _, html in ROWS:
        if len((html or "").encode()) >= 1000 and key is not None:
            last[html] = max(last.get(html, key), key)
    out = []
    for key, _, html in ROWS:
        body = (html or "").encode()
        refers = last.get(html) if len(body) >= 1000 and last.get(html) != key else None
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_records_come_back(spark, archive):
    records = warc.read_archive(spark, archive)
    assert sorted((tuple(r) for r in warc.summary(records).collect()), key=str) == wanted()
    rows = records.collect()
    texts = {(str(k), (h or "").encode()) for k, _, h in ROWS}
    assert all((str(warc.key_of(r.record_id)), bytes(r.payload)) in texts for r in rows if r.record_type == "response")
    assert all(r.payload is None and r.refers_to for r in rows if r.record_type == "revisit")
    urls = {warc.key_of(r.record_id): r.url for r in rows}
    assert urls["1"] == "http://a/1" and urls["2"] == "http://a/2%0D%0AWARC-Type:%20x" and urls["3"] is None and urls["6"] == "http://b/ä%20b"


def test_records_are_fetched_by_identifier(spark, archive):
    got = warc.fetch(spark, archive, [warc.record_id("9"), warc.record_id("1"), warc.record_id("404"), warc.record_id("3")]).collect()
    assert sorted(warc.key_of(r.record_id) for r in got) == ["1", "3", "3", "9"]
    assert {warc.key_of(r.record_id): r.payload and len(r.payload) for r in got} == {"9": 3_000_000, "3": len(LONG.encode()), "1": None}
    assert warc.fetch(spark, archive, [warc.record_id("404")]).count() == 0


def test_files_are_plain_zstandard(spark, archive):
    ids = 0
    for r in warc.bundles(spark, archive).collect():
        data = bytes(r.content)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() if data else b""
        at, names = 0, []
        while at < len(whole):
            found, at = warc.parsed(whole, at)
            names.append(found["record_id"])
        assert names == [p[0] for p in warc.places(data)]
        ids += len(names)
    assert ids == len(ROWS)


def test_an_empty_table_makes_an_empty_archive(spark, tmp_path):
    root = "file://" + str(tmp_path)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), root)
    assert warc.read_archive(spark, root).count() == 0 and warc.fetch(spark, root, ["urn:page:1"]).count() == 0


def test_frames_and_places():
    bundle, data = warc.Bundle(), [(f"urn:page:{k}", warc.record(str(k), "u", "00" * 20, n, None, b"%d" % k * n, "2024-01-01T00:00:00Z")) for k, n in enumerate([10, 100_000, 200_000, 5, 900_000, 0, 7])]
    for name, record in data:
        bundle.add(name, record)
    stored = bundle.bytes()
    table = warc.seek_table(stored)
    assert len(table) > 3 and sum(n for _, n in table) + 17 + 8 * len(table) == len(stored)
    for (name, frame, start, size, offset, length), (want, record) in zip(warc.places(stored), data, strict=True):
        assert name == want and table[frame] == (start, size)
        assert warc.frame_at(stored, start, size)[offset : offset + length] == record
    assert {frame for _, frame, *_ in warc.places(stored)} == set(range(len(table) - 1))
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(stored[:-1])
    with pytest.raises(ValueError, match="whole record"):
        warc.parsed(data[0][1][:-4] + b"oops")


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = con.execute(entry.oracle_sql()["op12_warc"]).fetchall()
    assert sorted((tuple(r) for r in entry.queries()["op12_warc"](spark, folder).collect()), key=str) == sorted(want, key=str)
