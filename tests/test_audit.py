"""The audit's rules, each held and broken, with nulls and repeats."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import audit, states, validate

RECORD = dict(
    place=1, id="r-1", slug="t-1", snapshot="s", type="speech", kind="dialogue", day="2024-02-29", title_en="About rivers", title_zh="关于河流", summary_en="", summary_zh="", source_url="https://x.example/a",
    archive_url="https://archive.example/items/r-1", embed_url=None, thumbnail_url=None, duration=5.0, fetched_at="2024-01-01T00:00:00Z", status="reviewed", reviewed_at="2024-01-02T00:00:00Z", model="m", source_missing=False, hash="h", has_segments=True,
)
TYPES = {"place": "long", "duration": "double", "source_missing": "boolean", "has_segments": "boolean", "turn": "long", "start": "double"}
SEGMENT = dict(place=1, turn=0, sid="s0", speaker_en="Ada Lovelace", speaker_zh="埃达", start=0.0, text_en="They walk by the river", text_zh="他们在河边走")


def frame(spark, base, rows):
    schema = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in base)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def found(spark, records, segments=(), **options):
    rows = audit.audit(frame(spark, RECORD, records), frame(spark, SEGMENT, segments), "archive.example", **options).collect()
    return sorted((r.id, r.field, r.message) for r in rows)


def test_a_sound_record_has_no_issue(spark):
    assert found(spark, [{}], [{}, {"turn": 1, "sid": "s1", "start": 0.0}], source_hash=F.lit("h"), snapshot="s", expected=1, baseline=spark.createDataFrame([("r-1",)], "id string")) == []


BROKEN = [
    ({"slug": None}, "slug", "required"), ({"hash": " "}, "hash", "required"), ({"type": None}, "type", "unknown type"), ({"kind": None}, "kind", "unknown content"), ({"day": None}, "day", "invalid date"), ({"day": "2023-02-29"}, "day", "invalid date"),
    ({"fetched_at": None}, "fetched_at", "not a time stamp"), ({"source_url": None}, "source_url", "not a web address"), ({"archive_url": None}, "archive_url", "not a web address"), ({"embed_url": "x"}, "embed_url", "not a web address"),
    ({"archive_url": "https://archive.example/items/r-2"}, "archive_url", "not this record of the archive"), ({"archive_url": "https://other.example/items/r-1"}, "archive_url", "not this record of the archive"), ({"embed_url": "https://www.youtube.com/embed/a"}, "embed_url", "not the private player"),
    ({"duration": -1.0}, "duration", "negative"), ({"duration": float("nan")}, "duration", "negative"), ({"has_segments": None}, "segments", "no list"), ({"kind": "none"}, "segments", "a text without a kind"), ({"has_segments": False}, "segments", "a kind without a text"),
    ({"status": None}, "status", "missing state"), ({"status": "failed"}, "status", "not reviewed"), ({"reviewed_at": None}, "reviewed_at", "reviewed without a stamp"), ({"model": None}, "model", "reviewed without a model"), ({"source_missing": True}, "source_missing", "gone from the source"),
    ({"title_zh": None}, "title_zh", "missing translation"), ({"title_zh": "rivers"}, "title_zh", "no Chinese characters"), ({"title_en": "It was 5", "title_zh": "是6"}, "title_zh", "numbers changed"), ({"title_en": "Up $2-3 billion", "title_zh": "涨20亿至30亿"}, "title_zh", "numbers to review"),
]


def test_each_broken_field(spark):
    rows = [RECORD | {"place": i, "id": f"r-{i}", "slug": f"t-{i}", "archive_url": f"https://archive.example/items/r-{i}"} | change for i, (change, _, _) in enumerate(BROKEN)]
    want = sorted((r["id"], field, message) for r, (_, field, message) in zip(rows, BROKEN))
    got = found(spark, rows)
    assert got == want


SEGMENTS = [
    ([{"sid": None}, {"turn": 1, "sid": None}], [("segments[0].sid", "missing"), ("segments[1].sid", "missing")]),
    ([{}, {"turn": 1}, {"turn": 2}], [("segments[1].sid", "duplicate"), ("segments[2].sid", "duplicate")]),
    ([{"text_en": None}], [("segments[0].text_en", "missing source text")]),
    ([{"text_zh": None}], [("segments[0].text_zh", "missing translation")]),
    ([{"speaker_zh": None}], [("segments[0].speaker_zh", "missing translation")]),
    ([{"speaker_zh": "ada lovelace"}, {"turn": 1, "sid": "b", "speaker_en": "Grace", "speaker_zh": "Grace"}], []),
    ([{"speaker_en": "Old friend", "speaker_zh": "Old friend"}], [("segments[0].speaker_zh", "no Chinese characters")]),
    ([{"start": -1.0}, {"turn": 1, "sid": "b", "start": 9.0}, {"turn": 2, "sid": "c", "start": None}, {"turn": 3, "sid": "d", "start": 8.0}], [("segments[0].start", "negative"), ("segments[3].start", "decreasing")]),
    ([{"text_en": "Short words " * 8, "text_zh": "短"}], [("segments[0].text_zh", "implausibly short")]),
    ([{"text_zh": "people walk along the river every day 河"}], [("segments[0].text_zh", "too much English left")]),
    ([{"text_en": "Big Falcon Rocket and NASA Ames Center", "text_zh": "Big Falcon Rocket NASA Ames Center SpaceX Starlink 都在"}], []),
    ([{"text_zh": "长" * 40}, {"turn": 1, "sid": "b", "text_zh": "长" * 40}], []),
    ([{"text_zh": "长" * 40}, {"turn": 1, "sid": "b", "text_en": "Another source", "text_zh": "长" * 40}], [("segments[1].text_zh", "repeats the one before for another source")]),
]


@pytest.mark.parametrize("rows, want", SEGMENTS)
def test_segments(spark, rows, want):
    assert found(spark, [{}], rows) == sorted(("r-1", *w) for w in want)


def test_sets(spark):
    rows = [{"place": i, "id": i_, "slug": s, "archive_url": f"https://archive.example/items/{i_}"} for i, i_, s in ((3, "x", "a"), (1, "x", "b"), (2, "y", "b"), (4, None, None), (5, None, None))]
    issues = audit.audit(frame(spark, RECORD, rows), frame(spark, SEGMENT, []), "archive.example", snapshot="t", expected=7, baseline=spark.createDataFrame([("x",), ("z",), ("z",)], "id string")).collect()
    got = sorted(((r.id or "", r.field, r.message) for r in issues if r.message in ("duplicate", "missing required baseline record") or r.field == "records"))
    assert got == [("", "records", "expected 7, found 5"), ("x", "id", "duplicate"), ("y", "slug", "duplicate"), ("z", "id", "missing required baseline record")]
    assert sum(r.message == "another snapshot" for r in issues) == 5


def test_incomplete_sets(spark):
    assert found(spark, [{"title_zh": None, "status": "pending"}], [{"text_zh": "", "text_en": "word " * 300}], incomplete=True) == []


def test_words_and_domains(spark):
    rows = [("visit example.com", False), ("visit the bridge", True), ("See https://a.example/some/words", False), ("a.com.au is here now", True), ("NASA HQ", False), (None, False)]
    df = spark.createDataFrame(rows, "x string, y boolean")
    assert [bool(r.n) == r.y for r in df.select("y", validate.needs_han(F.col("x")).alias("n")).collect()] == [True] * 6
    said = spark.createDataFrame([("Twenty-five percent, and 3!", True), ("three cars", False), ("$5", False), ("5x", False), ("", True)], "x string, y boolean")
    assert all(r.n == r.y for r in said.select("y", validate.numeric_utterance(F.col("x")).alias("n")).collect())


def test_forced_runs_take_any_state(spark):
    df = spark.createDataFrame([(s, d) for s in ("pending", "translated", "reviewed", "failed", None) for d in (True, False)], "s string, d boolean")
    pick = lambda **o: {(r.s, r.d) for r in df.where(states.reviewable(F.col("s"), F.col("d"), **o)).collect()}
    assert pick() == {("translated", True), ("translated", False), ("failed", True)} and len(pick(force=True)) == 10
    assert pick(force=True, resume=False) == pick(resume=False) == {("translated", True), ("translated", False)}


def test_facets_of_any_size(spark):
    known = spark.range(1500).select(F.concat(F.lit("v"), "id").alias("k")).union(spark.createDataFrame([("v3",), (None,)], "k string"))
    rows = spark.range(1501).select("id", F.concat(F.lit("v"), "id").alias("asked"))
    got = {r.id: r.type for r in states.with_parameter(rows, "type", F.col("asked"), known, "all").collect()}
    assert got[1499] == "v1499" and got[1500] == "all" and len(got) == 1501
