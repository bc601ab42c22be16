"""Runs of an injected function over the units of records: which units are pending, batches by size, outcomes by record, and what is published.

Tables
    records      id, source_hash, status, model, translated_at, reviewed_at, last_error
    units        id, unit, text, speaker, text_zh       (what a record has to have translated, with what it has)
    checkpoint   id, unit, unit_hash, source_hash, result, forced

A run of a record is isolated if it is forced, or resumes one that was. An isolated run starts from nothing and shows nothing before its end: if it fails,
the record stays as it was published, with the error beside it. Other runs keep what is done of them. All of it is joins and aggregations by record; texts go
to the function in batches, in Arrow batches of the units' own tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import numbers
from scriptorium.operators.packing import Batches, bisected

CHECKPOINT = "id string, unit string, unit_hash string, source_hash string, result string, forced boolean"
#: Characters of a batch, and units whose batches a task keeps in mind at once.
BATCH_CHARS, QUEUE = 12_000, 5_000


class Fatal(Exception):
    """An error after which no further call makes sense, such as a used-up limit."""


def unit_hash(text: str = "text", speaker: str = "speaker") -> Column:
    return F.sha2(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"), F.coalesce(speaker, F.lit("")).alias("s"))), 256)


def batches(sizes: list[int], most: int) -> list[list[int]]:
    """Places of a queue by batch: the first that is left is taken, then all later ones that fit."""
    fit, out = Batches(), []
    for i, size in enumerate(sizes):
        n = fit.put(size, most)
        while len(out) <= n:
            out.append([])
        out[n].append(i)
    return out


def called(units: DataFrame, run: Callable[[list[str]], list[str]], most: int = BATCH_CHARS) -> DataFrame:
    """(id, unit, unit_hash, result, error) of the units: batches by size across records; a failed batch is run in halves, a unit alone once more.

    After a fatal error a task calls no more, and its other units have that error too (``fatal: ...``)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop: Fatal | None = None

        def outcome(part: pd.DataFrame) -> list[tuple[str | None, str | None]]:
            nonlocal stop
            texts, out = part["text"].fillna("").tolist(), [(None, None)] * len(part)
            for batch in batches([len(x) for x in texts], most):
                if stop is None:
                    try:
                        for i, result, error in bisected(batch, lambda at: run([texts[i] for i in at]), (Fatal,)):
                            out[i] = result, str(error) or type(error).__name__ if error else None
                    except Fatal as e:
                        stop = e
                if stop is not None:
                    for i in batch:
                        out[i] = out[i] if out[i] != (None, None) else (None, f"fatal: {stop}")
            return out

        for frame in frames:
            for at in range(0, len(frame), QUEUE):
                part = frame.iloc[at : at + QUEUE]
                rows = outcome(part)
                yield part.assign(result=[r for r, _ in rows], error=[e for _, e in rows])[["id", "unit", "unit_hash", "result", "error"]]

    return units.select("id", "unit", "unit_hash", "text").mapInPandas(work, "id string, unit string, unit_hash string, result string, error string")


def in_waves(units: DataFrame, run: Callable[[list[str]], list[str]], written: Callable[[DataFrame], DataFrame], waves: int = 1, most: int = BATCH_CHARS) -> DataFrame:
    """The outcomes of all units, wave by wave: after a wave with a fatal error the later ones aren't begun, and their units have the error.

    ``written`` stores a wave's outcomes (a call isn't repeated when they are read)."""
    done, stopped = None, None
    for n in range(waves):
        part = units.where(F.pmod(F.xxhash64("id", "unit"), F.lit(waves)) == n)
        if stopped is None:
            out = written(called(part, run, most))
            hit = out.where(F.startswith("error", F.lit("fatal: "))).select("error").head(1)
            stopped = hit[0][0] if hit else None
        else:
            out = part.select("id", "unit", "unit_hash", F.lit(None).cast("string").alias("result"), F.lit(stopped).alias("error"))
        done = out if done is None else done.unionByName(out)
    return done


def good_numbers(source: Column, target: Column) -> Column:
    return numbers.level(source, F.coalesce(target, F.lit(""))) != "error"


def plan(records: DataFrame, units: DataFrame, checkpoint: DataFrame, force: bool = False, resume: bool = True, good: Callable[[Column, Column], Column] = good_numbers) -> DataFrame:
    """Every unit with its record's state and what is to become of it: columns base, stored, pending, and the record's isolated, action
    (skip, stamp: skip with the new source noted, run)."""
    kept = checkpoint if resume and not force else checkpoint.limit(0)
    runs = kept.groupBy("id").agg(F.max("source_hash").alias("_at"), F.bool_or("forced").alias("_forced"))
    saved = kept.where(F.trim(F.coalesce("result", F.lit(""))) != "").select("id", "unit", F.col("unit_hash"), F.col("result").alias("_stored")).dropDuplicates(["id", "unit", "unit_hash"])
    u = units.select("id", "unit", "text", "speaker", "text_zh").withColumn("unit_hash", unit_hash())
    # What is known of each unit is found by its key alone, so that the texts are shuffled once.
    keys = u.select("id", "unit", "unit_hash").distinct().join(saved, ["id", "unit", "unit_hash"], "left")
    whole = keys.groupBy("id").agg(F.bool_and(F.col("_stored").isNotNull()).alias("_whole"))
    r = records.join(runs, "id", "left").join(whole, "id", "left")
    complete = F.coalesce(F.col("status").isin("translated", "reviewed"), F.lit(False))
    changed = complete & F.coalesce(F.col("_at") != F.col("source_hash"), F.lit(False))
    isolated = F.lit(force) | F.coalesce("_forced", F.lit(False))
    action = F.when(isolated, "run").when(complete & ~changed, "skip").when(changed & F.coalesce("_whole", F.lit(True)), "stamp").otherwise("run")
    state = r.select("id", "source_hash", isolated.alias("isolated"), changed.alias("_changed"), action.alias("action"))
    known = keys.join(state, "id").select(F.col("id").alias("_id"), F.col("unit").alias("_unit"), F.col("unit_hash").alias("_hash"), "_stored", "source_hash", "isolated", "_changed", "action")
    met = (F.col("id") == F.col("_id")) & F.col("unit").eqNullSafe(F.col("_unit")) & (F.col("unit_hash") == F.col("_hash"))
    rows = u.join(known, met).withColumn("base", F.when(F.col("isolated"), "").otherwise(F.coalesce("text_zh", F.lit(""))))
    has = F.trim("base") != ""
    settled = has & ~F.col("isolated") & F.lit(resume) & (~F.col("_changed") | F.col("_stored").isNotNull())
    start = F.when(settled, F.col("base")).otherwise(F.coalesce(F.col("_stored"), F.when(~F.col("_changed"), F.col("base")), F.lit("")))
    rows = rows.withColumn("start", start)
    bad = (F.trim("start") != "") & ~good(F.col("text"), F.col("start"))
    todo = F.lit(force) | bad | F.when(F.lit(resume), ~settled & F.col("_stored").isNull()).otherwise(~has)
    return rows.select("id", "unit", "text", "speaker", "text_zh", "unit_hash", "source_hash", "isolated", "action", "start", (F.coalesce(todo, F.lit(True)) & (F.col("action") == "run")).alias("pending"))


def finish(records: DataFrame, planned: DataFrame, results: DataFrame, checkpoint: DataFrame, model: str, at: str, good: Callable[[Column, Column], Column] = good_numbers) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, units, checkpoint) after a run; results: the outcomes of the pending units. Publish all three together.

    A result that is blank or changes numbers isn't taken."""
    # Whether there is a text is told before the joins, so that the outcomes by record are found without texts; these are shuffled once.
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fresh = results.select("id", "unit", "unit_hash", F.col("result").alias("_result"), F.col("error").alias("_error"), (~empty("result")).alias("_given"))
    ran_units = planned.where("action = 'run'").withColumn("_empty", empty("start"))

    def judged(units: DataFrame) -> DataFrame:
        rows = units.join(fresh, ["id", "unit", "unit_hash"], "left")
        given = F.coalesce("_given", F.lit(False))
        fault = F.when(~F.col("pending"), None).when(F.col("_error").isNotNull(), F.col("_error")).when(~given, "empty").when(~good(F.col("text"), F.col("_result")), "changed numbers")
        rows = rows.withColumn("_fault", fault)
        now = F.when(F.col("pending") & F.col("_fault").isNull(), F.col("_result")).when(F.col("pending"), "").otherwise(F.col("start"))
        blank = F.when(F.col("pending"), F.col("_fault").isNotNull() | ~given).otherwise(F.col("_empty"))
        return rows.withColumn("_now", F.coalesce(now, F.lit(""))).withColumn("_blank", blank)

    blank = F.col("_blank")
    ends = judged(ran_units).groupBy("id").agg(F.bool_and(~blank).alias("_ok"), F.min(F.when(blank, F.concat("unit", F.lit(": "), F.coalesce("_fault", F.lit("missing"))))).alias("_why"), F.first("isolated").alias("_isolated"))
    rows = judged(ran_units.join(ends.select("id", "_ok"), "id"))
    r = records.join(ends, "id", "left").join(planned.select("id", "action").distinct(), "id", "left")
    ran, ok = F.col("action") == "run", F.coalesce("_ok", F.lit(True))  # a record without units is complete
    lone = ran & F.coalesce("_isolated", F.lit(False))
    pick = lambda done, failed, other: F.when(ran & ok, done).when(lone, other).when(ran, failed).otherwise(other)
    out = r.select(
        "id", "source_hash", pick(F.lit("translated"), F.lit("failed"), F.col("status")).alias("status"), pick(F.lit(model), F.lit(model), F.col("model")).alias("model"), pick(F.lit(at), F.col("translated_at"), F.col("translated_at")).alias("translated_at"),
        pick(F.lit(None), F.lit(None), F.col("reviewed_at")).cast("string").alias("reviewed_at"), F.when(ran & ok, None).when(ran, F.col("_why")).otherwise(F.col("last_error")).alias("last_error"),
    )
    shown = rows.select("id", "unit", "text", "speaker", F.when(F.col("isolated") & ~F.col("_ok"), F.col("text_zh")).otherwise(F.col("_now")).alias("text_zh"))
    units = shown.unionByName(planned.where("action <> 'run'").select("id", "unit", "text", "speaker", "text_zh"))
    # Records that ran have their units of now; those that are skipped keep theirs, stamped anew where only other fields of the source changed.
    mine = rows.where(~blank).select("id", "unit", "unit_hash", "source_hash", F.col("_now").alias("result"), (F.col("isolated") & ~F.col("_ok")).alias("forced"))
    opened = rows.where("isolated and not _ok").groupBy("id").agg(F.first("source_hash").alias("source_hash"))
    flags = opened.select("id", F.lit("").alias("unit"), F.lit("").alias("unit_hash"), "source_hash", F.lit("").alias("result"), F.lit(True).alias("forced"))
    stamps = planned.where("action = 'stamp'").select("id", F.col("source_hash").alias("_new")).distinct()
    others = checkpoint.join(ran_units.select("id").distinct(), "id", "left_anti").join(stamps, "id", "left").withColumn("source_hash", F.coalesce("_new", "source_hash")).drop("_new")
    columns = ["id", "unit", "unit_hash", "source_hash", "result", "forced"]
    return out, units, others.select(*columns).unionByName(mine.select(*columns)).unionByName(flags.select(*columns))
