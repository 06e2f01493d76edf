from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import warc

LONG = "<p>" + "é" * 60 + "</p>"


def plain(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(page_id, first.get(data, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        # a lone record without an id has nothing to refer to
        revisit = to is not None and page_id != to
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a/é x", LONG), (1, "http://b", LONG), (2, None, None), (4, "http://c", ""),
        (5, "http://d", "short"), (6, "http://e", "short"), (7, "http://f", LONG + "\r\n\r\n"),
        (1, "http://b", LONG), (8, "http://g", "x" * 99), (9, "http://h", "x" * 99),
        (10, "http://i", "y" * 100), (11, "http://j", "y" * 100), (12, "u", "z" * 300_000),
        (None, "http://k", LONG), (None, "http://l", "w" * 200), (None, "http://l", "w" * 200)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumnRenamed(
        "page_id", "page_id").selectExpr("*", "'extra' AS payload", "0 AS digest")


@pytest.mark.parametrize("file_bytes,range_bytes", [(1 << 28, 1 << 23), (400, 600)])
def test_round_trip(spark, tmp_path, pages, monkeypatch, file_bytes, range_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    rows = warc.read_records(index, str(tmp_path / "w")).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in rows]
    assert sorted(got, key=str) == plain(ROWS)
    for r in rows:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    some = warc.read_records(index.where("page_id in (5, 12)"), str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in some) == [5, 12]
    assert {r.url for r in rows} == {url for _, url, _ in ROWS}


def test_files_are_gzip_members_of_warc(spark, tmp_path, pages):
    import gzip

    index = warc.write_archives(pages, str(tmp_path / "w")).collect()
    for r in index:
        data = (tmp_path / "w" / r.file).read_bytes()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= 1
        head = gzip.decompress(data[r.offset:r.offset + r.length]).split(b"\r\n")
        assert head[0] == b"WARC/1.1" and head[1].endswith(r.record_type.encode())


def test_sql_and_folder(spark, pages):
    """The registered SQL on the same rows, null ids included; archives in a qualified folder."""
    import duckdb

    folder = warc.archive_folder(spark)
    assert folder.startswith("file:/")
    index = warc.write_archives(pages, folder)
    got = [tuple(r) for r in warc.read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    assert sorted(got, key=str) == sorted(con.execute(warc.SQL).fetchall(), key=str) == plain(ROWS)


def test_no_pages(spark, tmp_path, pages):
    index = warc.write_archives(pages.limit(0), str(tmp_path / "w"))
    assert warc.read_records(index, str(tmp_path / "w")).count() == 0


def test_damage_is_an_error(spark, tmp_path, pages):
    index = warc.write_archives(pages.where("page_id = 12").withColumn(
        "html", F.expr("array_join(transform(sequence(1, 9999), x -> md5(cast(x AS string))), '')")),
        str(tmp_path / "w"))
    file = next((tmp_path / "w").glob("*.gz"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception):
        warc.read_records(index, str(tmp_path / "w")).collect()
