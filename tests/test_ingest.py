"""Readers of files, and rules of ingestion that no query shows."""

import json

import pytest

from scriptorium.functions import pages
from scriptorium.operators import ingest, states
from pyspark.sql import functions as F


def test_scan_sets_bad_files_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "n": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "x", "n": 2}))
    (tmp_path / "c.json").write_text('{"id": "c", ')
    good, bad = ingest.scan(spark, str(tmp_path), "id string, n long", "id")
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert sorted(tuple(r) for r in bad.collect()) == [("b", "name is not the id"), ("c", "unreadable")]
    with pytest.raises(Exception):
        ingest.checked(spark, str(tmp_path), "id string, n long").collect()


def test_caption_files_and_whole_files(spark, tmp_path):
    (tmp_path / "abc.en.json3").write_text(json.dumps({"events": [{"tStartMs": 1500, "segs": [{"utf8": "Hi​ "}, {"utf8": "there"}]}, {"tStartMs": 2000}]}))
    assert [tuple(r) for r in ingest.cues(ingest.caption_files(spark, str(tmp_path)), "player", "events").collect()] == [("abc", 0, 1.5, "Hi there")]
    assert ingest.whole_files(spark, str(tmp_path)).select("file").collect()[0][0] == "abc.en.json3"


@pytest.mark.parametrize(
    "paragraph, want",
    [
        ("Jane Doe (1:02): Hello: there", ("Jane Doe", 62.0, "Hello: there")), ("[0:01:05] Bob : Yes", ("Bob", 65.0, "Yes")), ("HOST A: Good day", ("HOST A", None, "Good day")), ("SOURCE: a wire", None),
        ("Host: lower case", None), ("HOST:", None), ("Note (not a clock): text", None), ("[1:02] : no name", None), ("plain text", None), ("Al (1:2): x", None),
    ],
)
def test_labels(paragraph, want):
    assert pages.labelled(paragraph) == want


def test_dialogue_needs_a_time_or_enough_labels():
    assert pages.classify("A B: x\n\nplain")[0] == "article" and pages.classify("")[0] == "none"
    kind, segments = pages.classify("Ann (0:05): hi\n\nplain")
    assert kind == "dialogue" and segments == [("Ann", 5.0, "hi"), (None, None, "plain")]
    assert pages.classify("\n\n".join(["AB: x"] * 3 + ["plain"] * 7))[0] == "dialogue" and pages.classify("\n\n".join(["AB: x"] * 3 + ["plain"] * 8))[0] == "article"


def test_pages_and_forms(spark):
    row = spark.range(1).select(states.page_number(F.lit("7x")), states.page_number(F.lit("-2")), states.page_number(F.lit("x")), ingest.date_zh(F.lit("2024-03-09")), ingest.date_zh(F.lit("soon")), ingest.file_name(F.lit("a/b c"))).first()
    assert tuple(row) == (7, 1, 1, "2024年3月9日", "soon", "a_b_c.json")
