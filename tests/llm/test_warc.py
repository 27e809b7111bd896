"""WARC archives: round trip, file layout, revisits, odd rows."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard

from corpuscope.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def rows_of(spark, pages, **options):
    manifest = warc.write_archives(pages, **options)
    return manifest, sorted(warc.read_archives(spark, manifest).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.record_type))


def test_round_trip_and_revisits(spark):
    long = "<p>" + "höre " * 60
    pages = spark.createDataFrame(
        [(3, "http://a/3", long, "x"), (1, "http://a/1", long, "x"), (2, "http://a/ \n2", "short", None), (4, None, "short", None), (5, "u", None, "y"),
         (6, "u", "", "y"), (7, "u", "z" * 300_000, "y"), (None, "u", long, "y"), (8, "u", long + "!", "q"), (8, "u", long + "!", "q")], SCHEMA)
    _, rows = rows_of(spark, pages)
    assert len(rows) == 10
    full = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        payload = (full[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (bytes(r.payload) == payload) if r.record_type == "response" else r.payload is None
    assert [(r.page_id, r.record_type, r.refers_to) for r in rows] == [
        (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None),
        (7, "response", None), (8, "response", None), (8, "revisit", 8), (None, "revisit", 1)]
    assert rows[1].target_uri == "http://a/%20%0A2" and rows[3].target_uri == "urn:page:4"


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_rows_of_several_files(spark, tmp_path, monkeypatch, broadcast):
    """Whatever task a repeated row is in: one response, and of rows with other urls that of the smallest."""
    monkeypatch.setattr(warc, "REPEATS", 3)
    body, other = "<p>" + "words " * 60, "<p>" + "other " * 60
    for _ in range(4):
        rows = [(1, "u", body), (2, "v", body), (3, "z", other), (None, "n", body), (4, "w", "short"), (4, "w", "short")]
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    spark.createDataFrame([(3, None, other), (3, "a", other)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept if broadcast else "-1")
    try:
        _, found = rows_of(spark, spark.read.parquet(str(tmp_path / "p")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert [(r.page_id, r.record_type, r.refers_to) for r in found] == [
        (1, "response", None), *[(1, "revisit", 1)] * 3, *[(2, "revisit", 1)] * 4, (3, "response", None), *[(3, "revisit", 3)] * 5,
        *[(4, "response", None)] * 8, *[(None, "revisit", 1)] * 4]
    assert {(r.payload_bytes, r.payload_digest) for r in found if r.page_id == 3} == {(len(other), hashlib.sha256(other.encode()).hexdigest())}


def test_archives_are_cut_and_hold_a_dictionary(spark, monkeypatch):
    pages = spark.range(400).selectExpr("id as page_id", "'http://h/' as url", "concat('<html>the same words in every page ', id, repeat(' and more', 40)) as html")
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    manifest, rows = rows_of(spark, pages.coalesce(1), archive_bytes=40_000)
    assert len(rows) == 400 and manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == 400
    fs, path = warc.filesystem(manifest.first().archive)
    data = fs.open_input_stream(path, compression=None).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    frame = codec.decompressobj()
    assert frame.decompress(data[8 + size:]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and frame.eof and frame.unused_data
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-3])))


def test_empty_table(spark):
    manifest, rows = rows_of(spark, spark.createDataFrame([], SCHEMA))
    assert rows == [] and manifest.count() == 0


def test_damage_is_seen():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 1, "u", False)
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"payload\r\n", b"paYload\r\n"))
