from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib

import pytest
from conftest import values
from pyarrow import fs
from tidemark.llm import warc
from tidemark.session import run_dir

from .conftest import SF_DIR

SCHEMA = "page_id bigint, url string, html string, digest string, first int"
ODD = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""),
    (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (None, "u", "alone"), (None, "v", "alone"),
    (6, "u", "x" * 3_000_000), (7, "u", "twice"), (7, "u", "twice"), (8, "é ü", "twice"),
]


def expected(rows, least_bytes=0):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in rows:
        data = (html or "").encode()
        one = first.get(html or "")
        again = len(data) >= least_bytes and one is not None and page != one
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", one if again else None))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    found = warc.archive(pages, archive_bytes=200_000)
    assert values(found, *COLUMNS) == expected(rows)
    payloads = {r.page_id: r.payload for r in found.collect() if r.record_type == "response"}
    html = dict(rows)
    assert all(bytes(p) == (html[i] or "").encode() for i, p in payloads.items())
    urls = {r.page_id: r.url for r in pages.collect()}
    assert all(r.url == urls[r.page_id] for r in found.collect())


@pytest.mark.parametrize("least_bytes", [0, 6])
def test_odd_rows(spark, least_bytes):
    pages = spark.createDataFrame([(*r, "d", 1) for r in ODD], SCHEMA).repartition(3)
    found = warc.archive(pages, least_bytes=least_bytes)
    assert values(found, *COLUMNS) == expected([(r[0], r[2]) for r in ODD], least_bytes)
    assert {r.url for r in found.collect()} == {r[1] for r in ODD}
    assert warc.archive(pages.limit(0)).count() == 0


def test_normalised_members_and_index(spark, tmp_path):
    records = [warc.record(i, f"http://x/{i}", b"p" * i, "response", None) for i in range(50)]
    whole, members = tmp_path / "whole.warc.gz", tmp_path / "members.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(records)))
    local = fs.LocalFileSystem()
    assert warc.normalise_file(str(whole), str(members), local) == 50
    data = members.read_bytes()
    entries = [json.loads(line) for line in (tmp_path / "members.warc.gz.idx").read_text().splitlines()]
    for entry, record in zip(entries, records):
        member = data[entry["offset"] : entry["offset"] + entry["length"]]
        assert zlib.decompress(member, wbits=31) == record
    assert gzip.decompress(data) == b"".join(records)
    # what is normal already stays the same
    again = tmp_path / "again.warc.gz"
    assert warc.normalise_file(str(members), str(again), local) == 50
    assert again.read_bytes() == data


def test_broken_archives_are_errors(tmp_path):
    record = warc.record(1, "u", b"payload", "response", None)
    local = fs.LocalFileSystem()
    for data in (gzip.compress(record)[:-20], gzip.compress(record[:-9])):
        (tmp_path / "a.warc.gz").write_bytes(data)
        with pytest.raises(ValueError):
            warc.normalise_file(str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz"), local)
    with pytest.raises(ValueError):
        warc.read_member(gzip.compress(record.replace(b"payload", b"pAyload")), True)


def test_folder_is_below_the_shared_one(spark):
    assert run_dir(spark, "warc").startswith((spark.conf.get("spark.checkpoint.dir", None) or "/"))


def test_schemes_of_spark():
    for given, wanted in (
        ("s3a://bucket/x", "s3://bucket/x"),
        ("s3n://bucket/x", "s3://bucket/x"),
        ("wasbs://c@a/x", "abfss://c@a/x"),
        ("/mnt/shared", "/mnt/shared"),
        ("file:///tmp/x", "file:///tmp/x"),
        ("hdfs://host:8020/x", "hdfs://host:8020/x"),
    ):
        assert warc.known_uri(given) == wanted
    assert warc.file_system("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        warc.file_system("nosuch://x/y")
