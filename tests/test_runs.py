"""Published versions, checkpoints, batches of calls, and runs over records."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import published as P
from scriptorium.operators import translate as R

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def store(spark, tmp_path):
    return P.Store(spark, f"file://{tmp_path}/table")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_versions(spark, store):
    assert store.read() is None and store.latest() is None and store.recover(0) == []
    assert store.write(spark.range(3)) == 0 and store.write(spark.range(5), by="me") == 1
    assert ids(store.read()) == [0, 1, 2, 3, 4] and ids(store.read(0)) == [0, 1, 2]
    assert store.facts()["rows"] == 5 and store.facts()["by"] == "me" and store.facts(0)["parent"] is None
    store.write(spark.createDataFrame([], "a string"))
    assert store.read().schema.simpleString() == "struct<a:string>" and store.read().count() == 0


def test_a_stage_is_not_read_before_its_publication(spark, store):
    store.write(spark.range(3))
    entry = store.stage(spark.range(9))
    assert ids(store.read()) == [0, 1, 2]
    assert store.recover() == []  # too young
    assert store.publish(entry) == 1 and store.read().count() == 9


def test_of_two_writers_one_wins(spark, store):
    store.write(spark.range(1))
    a, b = store.stage(spark.range(2)), store.stage(spark.range(3))
    store.publish(b)
    with pytest.raises(P.Conflict):
        store.publish(a)
    assert store.read().count() == 3 and store.recover(-5) == [a["stage"]] and store.read().count() == 3
    # Even if both look at the log at the same time, the rename of the second fails.
    c = store.stage(spark.range(4))
    late = P.Store(spark, store.root)
    late.numbers, late.latest = (lambda: [0, 1]), (lambda: 1)
    c["parent"] = 1
    store.write(spark.range(5))
    with pytest.raises(P.Conflict):
        late.publish(c)
    assert store.read().count() == 5


def test_too_few_rows_and_failing_writes_leave_nothing(spark, store, tmp_path):
    store.write(spark.range(300), fewest=271)
    with pytest.raises(P.TooFew):
        store.write(spark.range(270), fewest=271)
    with pytest.raises(Exception, match="broken|ARITHMETIC|raise"):
        store.write(spark.range(10).select(F.raise_error(F.lit("broken")).alias("id")))
    assert store.read().count() == 300 and len(os.listdir(tmp_path / "table/data")) == 1


def test_broken_and_foreign_versions_are_passed_over(spark, store, tmp_path):
    store.write(spark.range(2))
    log = tmp_path / "table/log"
    (log / f"{1:020d}.json").write_text("{")
    (log / f"{2:020d}.json").write_text(json.dumps({"format": 99, "stage": "x", "schema": {}}))
    (log / "odd.json").write_text("{}")
    assert store.latest() == 0 and store.read().count() == 2
    assert store.write(spark.range(7)) == 3 and store.read().count() == 7
    assert P.Store(spark, store.root, format=2).read() is None


def test_a_killed_writer_leaves_the_version_before(spark, store):
    store.write(spark.range(4))
    code = f"""
import os, sys
sys.path.insert(0, {HERE!r})
from pyspark.sql import SparkSession
from scriptorium.operators.published import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
store = Store(spark, {store.root!r})
store.stage(spark.range(99))
print("staged", flush=True)
os.kill(os.getpid(), 9)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert "staged" in run.stdout and run.returncode == -9
    assert store.read().count() == 4 and store.latest() == 0
    time.sleep(0.01)
    assert len(store.recover(-5)) == 1 and store.read().count() == 4
    assert store.write(spark.range(6)) == 1


def test_checkpoints_never_raise(spark, store):
    assert P.checkpoint(store, R.CHECKPOINT).count() == 0
    store.write(spark.range(2))
    assert P.checkpoint(store, R.CHECKPOINT).count() == 0  # another shape
    store.write(spark.createDataFrame([("a", "u", "h", "s", "r", False)], R.CHECKPOINT))
    assert P.checkpoint(store, R.CHECKPOINT).count() == 1 and P.checkpoint(P.Store(spark, store.root, 2), R.CHECKPOINT).count() == 0


UNIT = "id string, unit string, text string, unit_hash string"


def calls(spark, tmp_path, texts, fail=(), fatal=(), once=(), most=10, parts=1):
    """The outcomes, and the batches the function was called with, in the order of the calls."""
    log = tmp_path / f"calls{time.time()}"
    log.mkdir()

    def run(batch):
        n = len(os.listdir(log))
        (log / f"{n:05d}-{os.getpid()}").write_text(json.dumps(batch))
        if set(batch) & set(fatal):
            raise R.Fatal("limit")
        if set(batch) & set(fail) or set(batch) & set(once) and not any(len(json.loads((log / x).read_text())) == 1 for x in os.listdir(log) if not x.startswith(f"{n:05d}")):
            raise ValueError("bad batch")
        return [t.upper() for t in batch]

    df = spark.createDataFrame([("e", f"{i:03d}", t, "") for i, t in enumerate(texts)], UNIT).coalesce(parts)
    rows = {r.unit: (r.result, r.error) for r in R.called(df, run, most).collect()}
    return [rows[f"{i:03d}"] for i in range(len(texts))], [json.loads((log / x).read_text()) for x in sorted(os.listdir(log))]


def test_batches_by_size():
    assert R.batches([6, 5, 4, 3, 20, 1], 10) == [[0, 2], [1, 3, 5], [4]]
    assert R.batches([], 10) == [] and R.batches([50], 10) == [[0]]


def test_batches_are_filled_and_failures_isolated(spark, tmp_path):
    out, seen = calls(spark, tmp_path, ["aaaa", "bbbb", "cc", "dddd"])
    assert out == [(t.upper() if t else None, None) for t in ("aaaa", "bbbb", "cc", "dddd")] and seen == [["aaaa", "bbbb", "cc"], ["dddd"]]
    out, seen = calls(spark, tmp_path, ["aaaa", "bbbb", "cc", "dddd"], fail={"bbbb"})
    assert [r for r, _ in out] == ["AAAA", None, "CC", "DDDD"] and out[1][1] == "bad batch"
    assert seen == [["aaaa", "bbbb", "cc"], ["aaaa", "bbbb"], ["aaaa"], ["bbbb"], ["bbbb"], ["cc"], ["dddd"]]  # halves, and one more try alone


def test_a_fatal_error_ends_the_calls(spark, tmp_path):
    out, seen = calls(spark, tmp_path, ["aaaaaaaa", "bbbbbbbb", "cccccccc", "dddddddd"], fatal={"bbbbbbbb"})
    assert [r for r, _ in out] == ["AAAAAAAA", None, None, None] and {e for _, e in out[1:]} == {"fatal: limit"} and len(seen) == 2


def test_later_waves_are_not_begun(spark, tmp_path):
    log = tmp_path / "waves"
    log.mkdir()

    def run(batch):
        (log / f"{time.time_ns()}").write_text("")
        raise R.Fatal("limit")

    df = spark.createDataFrame([(f"e{i}", "u", "text", "") for i in range(40)], UNIT).coalesce(1)
    out = R.in_waves(df, run, lambda x: x.checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(x.collect(), x.schema), waves=5)
    rows = out.collect()
    assert len(rows) == 40 and {r.error for r in rows} == {"fatal: limit"} and len(os.listdir(log)) == 1


RECORDS = "id string, source_hash string, status string, model string, translated_at string, reviewed_at string, last_error string"
UNITS = "id string, unit string, text string, speaker string, text_zh string"


def hash_of(spark, text, speaker=None):
    return spark.createDataFrame([(text, speaker)], "text string, speaker string").select(R.unit_hash()).first()[0]


def run(spark, records, units, saved=(), results=None, **options):
    """One run; results: text -> result, an error for what isn't there."""
    records, units = spark.createDataFrame(records, RECORDS), spark.createDataFrame(units, UNITS)
    cp = spark.createDataFrame(list(saved), R.CHECKPOINT)
    planned = R.plan(records, units, cp, **options)
    pending = planned.where("pending")
    known = results or {}

    def call(texts):
        return [known[t] for t in texts]

    outcome = R.called(pending, call)
    out, shown, saved = R.finish(records, planned, outcome, cp, "m2", "now")
    return {r.id: r for r in out.collect()}, {(r.id, r.unit): r.text_zh for r in shown.collect()}, saved.collect(), sorted(r.text for r in pending.collect())


def test_a_first_run(spark):
    records, units, saved, asked = run(spark, [("a", "h", "pending", None, None, None, None), ("b", "h", None, None, None, None, "old")], [("a", "u1", "one", None, ""), ("a", "u2", "two", None, None), ("b", "u1", "costs 5", None, "")], results={"one": "甲", "two": "乙", "costs 5": "价6"})
    assert asked == ["costs 5", "one", "two"]
    assert records["a"].status == "translated" and records["a"].model == "m2" and records["a"].translated_at == "now" and records["a"].last_error is None
    assert records["b"].status == "failed" and records["b"].last_error == "u1: changed numbers" and units == {("a", "u1"): "甲", ("a", "u2"): "乙", ("b", "u1"): ""}
    assert {(r.id, r.unit, r.result, r.forced) for r in saved} == {("a", "u1", "甲", False), ("a", "u2", "乙", False)}


def test_a_resumed_run_asks_for_what_is_missing(spark):
    h = hash_of(spark, "one")
    records, units, saved, asked = run(spark, [("a", "h", "failed", "m1", None, None, "x")], [("a", "u1", "one", None, ""), ("a", "u2", "two", None, "")], [("a", "u1", h, "h", "甲", False)], {"two": "乙"})
    assert asked == ["two"] and records["a"].status == "translated" and units == {("a", "u1"): "甲", ("a", "u2"): "乙"}
    # A changed unit has another hash; without a resume only what has no text is asked for.
    assert run(spark, [("a", "h", "failed", "m1", None, None, "x")], [("a", "u1", "one!", None, "")], [("a", "u1", h, "h", "甲", False)], {"one!": "丙"})[3] == ["one!"]
    assert run(spark, [("a", "h", "failed", "m1", None, None, "x")], [("a", "u1", "one", None, "已有"), ("a", "u2", "two", None, "")], results={"two": "乙"}, resume=False)[3] == ["two"]


def test_complete_records_are_skipped_or_stamped(spark):
    h = hash_of(spark, "one")
    row, unit = ("a", "new", "reviewed", "m1", "t", "r", None), ("a", "u1", "one", None, "甲")
    for saved in ((), [("a", "u1", h, "new", "甲", False)]):
        records, units, _, asked = run(spark, [row], [unit], saved)
        assert asked == [] and tuple(records["a"])[2:6] == ("reviewed", "m1", "t", "r") and units == {("a", "u1"): "甲"}
    _, _, saved, asked = run(spark, [row], [unit], [("a", "u1", h, "old", "甲", False)])
    assert asked == [] and [r.source_hash for r in saved] == ["new"]  # only other fields of the source changed
    records, units, _, asked = run(spark, [row], [("a", "u1", "uno", None, "甲")], [("a", "u1", h, "old", "甲", False)], {"uno": "乙"})
    assert asked == ["uno"] and records["a"].status == "translated" and records["a"].reviewed_at is None and units == {("a", "u1"): "乙"}


def test_bad_numbers_are_asked_for_again(spark):
    _, units, _, asked = run(spark, [("a", "h", "failed", None, None, None, None)], [("a", "u1", "costs 5", None, "价6"), ("a", "u2", "ok", None, "好")], results={"costs 5": "价5"})
    assert asked == ["costs 5"] and units == {("a", "u1"): "价5", ("a", "u2"): "好"}


def test_a_forced_run_is_isolated(spark):
    row, units = ("a", "h", "reviewed", "m1", "t", "r", None), [("a", "u1", "one", None, "旧甲"), ("a", "u2", "two", None, "旧乙")]
    records, shown, saved, asked = run(spark, [row], units, [("a", "u1", hash_of(spark, "one"), "h", "存", False)], {"one": "甲"}, force=True)
    assert asked == ["one", "two"]
    assert tuple(records["a"])[2:6] == ("reviewed", "m1", "t", "r") and records["a"].last_error.startswith("u2: ")
    assert shown == {("a", "u1"): "旧甲", ("a", "u2"): "旧乙"}  # nothing of it is published
    # The next run resumes it, still isolated, and publishes at its end.
    records, shown, saved, asked = run(spark, [tuple(records["a"])], units, saved, {"two": "乙"})
    assert asked == ["two"] and records["a"].status == "translated" and records["a"].reviewed_at is None and records["a"].last_error is None
    assert shown == {("a", "u1"): "甲", ("a", "u2"): "乙"} and not any(r.forced for r in saved)
    # A forced run that got nothing at all is remembered as well.
    records, shown, saved, _ = run(spark, [row], units, force=True)
    assert records["a"].status == "reviewed" and run(spark, [tuple(records["a"])], units, saved, {"one": "1", "two": "2"})[3] == ["one", "two"]


def test_other_records_and_empty_tables(spark):
    saved = [("z", "u", "x", "h", "r", False)]
    records, units, kept, asked = run(spark, [("a", "h", "pending", None, None, None, None)], [], saved)
    assert asked == [] and units == {} and [tuple(r) for r in kept] == saved
    assert run(spark, [], [])[0] == {}
