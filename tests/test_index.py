"""Index payloads of every shape: no payload goes without a row, and a broken or short index is an error."""

import json

import pytest

from scriptorium.operators import ingest


def entry(i, **change):
    return {"id": f"e-{i}", "type": "speech", "date": "2024-01-01", "title": "t", "url": "https://a.example/x", "source": "https://b.example/y"} | change


def report(spark, bodies, fewest=2):
    rows = ingest.index_report(spark.createDataFrame(list(enumerate(bodies)), "k long, body string"), "k", "body", fewest).collect()
    return {(r.k, r.place): r.fault for r in rows}


def test_payloads(spark):
    good = json.dumps({"total": 2, "entries": [entry(1), entry(2)]})
    bodies = [good, "not json", "[]", "{}", "", None, json.dumps({"entries": []}), json.dumps({"entries": [entry(1)]}), json.dumps({"total": 3, "entries": [entry(1), entry(2)]}), json.dumps({"total": "x", "entries": [entry(1), entry(2, durationSec="long")]})]
    assert report(spark, bodies) == {(0, 0): None, (0, 1): None, (1, None): "unreadable", (2, None): "unreadable", (3, None): "no entries", (4, None): "unreadable", (5, None): "unreadable", (6, None): "too few", (7, None): "too few", (7, 0): None, (8, None): "total", (8, 0): None, (8, 1): None, (9, 0): None, (9, 1): None}


def test_entries(spark):
    odd = [entry(1), entry(1), entry(2, id="A b"), entry(3, id=None), entry(4, type="poem"), entry(5, date="1.1.2024"), entry(6, title=" "), entry(7, url="ftp://x"), entry(8, source=None), None]
    found = report(spark, [json.dumps({"entries": odd}), json.dumps({"entries": [entry(1), entry(9)]})])
    assert [found[0, i] for i in range(10)] == [None, "duplicate", "id", "id", "type", "date", "address or title", "address or title", "address or title", "not an object"]
    assert found[1, 0] is None and found[1, 1] is None  # an id of another payload is no duplicate


def test_an_index_is_accepted_or_not(spark):
    frame = lambda body: spark.createDataFrame([("index.json", body)], "k string, body string")
    assert ingest.accepted_index(frame(json.dumps({"entries": [entry(i) for i in range(300)]})), "k", "body").count() == 300
    with pytest.raises(ValueError, match="index.json: too few"):
        ingest.accepted_index(frame(json.dumps({"entries": [entry(i) for i in range(270)]})), "k", "body")
    with pytest.raises(ValueError, match=r"index.json\[1\]: duplicate"):
        ingest.accepted_index(frame(json.dumps({"entries": [entry(1), entry(1)]})), "k", "body", 1)
    assert ingest.index_report(frame("{}").limit(0), "k", "body").count() == 0
