import hashlib

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from lattica.llm import warc

SCHEMA = "page_id long, url string, html string, sum string, best long"
ROWS = [(1, "http://a", "<p>one</p>", "x", 1), (2, "http://b", "<p>one</p>", "x", 1), (3, None, None, None, None), (4, "http://d", "", "x", 1), (5, "u\r\nv", "é" * 300_000, "x", 1), (6, "http://e", "a\r\n\r\nb", "x", 1), (None, "http://n", "<p>one</p>", "x", 1), (7, "", "<p>two</p>", None, 2)]


def test_contract_rows(spark):
    got = {r.page_id: r for r in warc.op4(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response" and got[2].refers_to is None
    assert got[3].refers_to == 4 and got[4].payload_bytes == 0 and got[3].payload_digest == got[4].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert got[5].payload_bytes == 600_000 and got[None].record_type == "response"
    for i, _, html, *_ in ROWS:
        assert got[i].payload_digest == warc.digest((html or "").encode())
    assert warc.op4(spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_round_trip_and_single_records(spark):
    bundles = warc.write(spark.createDataFrame(ROWS, SCHEMA))
    back = {r.page_id: r for r in warc.read(bundles).collect()}
    assert {i: back[i].payload for i, _, html, *_ in ROWS if back[i].record_type == "response"} == {i: html or "" for i, _, html, *_ in ROWS if i not in (1, 3)}
    some = warc.read(bundles, spark.createDataFrame([("urn:page:5",), ("urn:page:2",)], "record_id string")).collect()
    assert sorted(r.page_id for r in some) == [2, 5]


def test_seek_table_and_offsets():
    bundle, plain = warc.Bundle(), b""
    for i in range(200):
        data = warc.record(i, f"http://x/{i}", hashlib.sha256(str(i).encode()).hexdigest().encode() * 200)
        bundle.add(f"urn:page:{i}", data)
        plain += data
    data, index = bundle.finish()
    assert len({e[1] for e in index}) > 5
    reader = warc.Reader(data)
    for record_id, frame, offset, length in index:
        head, payload = reader.read(frame, offset, length)
        assert head["WARC-Record-ID"] == f"<{record_id}>" and len(payload) == 12_800
    # an ordinary reader passes over the seek table and gets all records in order
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == plain
    assert sum(s[2] for s in reader.spans) == len(plain)


def test_damage_is_noticed(spark):
    rows = warc.write(spark.createDataFrame(ROWS[:2], SCHEMA))
    bad = rows.withColumn("bytes", F.expr("concat(substring(bytes, 1, 40), X'00', substring(bytes, 42))"))
    with pytest.raises(Exception):
        warc.read(bad).collect()


def test_as_the_sql_on_the_table(spark, sf):
    got = sorted(tuple(r) for r in warc.op4(spark.read.parquet(f"{sf}/pages.parquet")).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert got == sorted(con.execute(warc.ORACLE).fetchall())


def test_export(spark, tmp_path):
    made = warc.export(warc.write(spark.createDataFrame(ROWS, SCHEMA)), str(tmp_path / "out")).collect()
    for r in made:
        assert (tmp_path / "out" / r.bundle).stat().st_size == r.size
