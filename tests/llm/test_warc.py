import base64
import hashlib

import numpy as np
import pytest

from scriptorium.llm import warc
from scriptorium.llm.common import new_dir

INNER = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n"
PAGES = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, INNER), (None, "a"), (0, "é\r\n\r\n"), (1, "a"), (9, "WARC/1.1\r\n"), (None, "only"), (7, "x" * 200_000)]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in PAGES], "page_id long, url string, html string, payload_bytes string")
    path = new_dir(spark, "test-warc")
    warc.write_archives(df, path)
    rows = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).na.fill("null").collect())
    want = []
    for i, html in PAGES:
        ids = [j for j, h in PAGES if (h or "") == (html or "") and j is not None]
        first = min(ids) if ids else None
        again = i != first
        want.append((str(i) if i is not None else "null", len((html or "").encode()), digest(html), "revisit" if again else "response", str(first) if again else "null"))
    assert rows == sorted(want)


def test_query_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rows = {r.page_id: r for r in warc.op10_warc(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(pages)
    for p in pages:
        r = rows[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p.html.encode()), digest(p.html))
        first = min(q.page_id for q in pages if q.html == p.html)
        assert (r.record_type, r.refers_to) == (("response", None) if first == p.page_id else ("revisit", first))


def test_pointer_jumping_drops_magic_in_payloads():
    offsets, successors = np.array([0, 40, 100, 160]), np.array([100, 90, 200, 200])
    assert warc.reachable(offsets, successors, 200).tolist() == [True, False, True, False]
    chain = np.arange(1000) * 10
    assert warc.reachable(chain, chain + 10, 10_000).all()
    with pytest.raises(ValueError, match="end"):
        warc.reachable(offsets, np.array([90, 90, 200, 200]), 200)
    with pytest.raises(ValueError, match="start"):
        warc.reachable(offsets + 1, successors, 200)


def test_empty_table(spark):
    path = new_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_records_have_addresses_and_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 8)
    monkeypatch.setattr(warc, "SMALL", 1000)
    pages = [(i, f"https://x.example/{i}\nb" if i != 3 else None, "p" * (5 if i in (7, 8) else 300 + i)) for i in range(40)] + [(i, f"u{i}", str(i) * 2000) for i in range(40, 50)]
    path = new_dir(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    files = [(r.path, bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).collect()]
    counts = sorted(c.count(b"WARC-Record-ID") for p, c in files if "size=0" in p)
    assert counts == [8] * 5 and {c.count(b"WARC-Record-ID") for p, c in files if "size=2" in p} == {2}
    whole = b"".join(c for _, c in files)
    again = whole[whole.index(b"WARC-Type: revisit") :].partition(b"\r\n\r\n")[0]
    assert b"WARC-Refers-To: <urn:page:7>" in again and b"WARC-Refers-To-Target-URI: https://x.example/7%0Ab" in again
    assert b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 300\r\n\r\n" + b"p" * 300 + b"\r\n\r\n" in whole
    targets = {r.page_id: r.target for r in warc.read_archives(spark, path).collect()}
    assert targets["3"] is None and targets["4"] == "https://x.example/4%0Ab" and len(targets) == 50
