"""What a run has to do, and what state it leaves: pending units, reviews, merges of corrections; and the rules that whole records keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import urls
from scriptorium.operators import validate as V

# What a record may be, the sites it may name, and when a text counts as too short for its source.
TYPES, CONTENTS, STATES = ["interview", "keynote", "speech", "earnings", "space"], ["dialogue", "article", "none"], ["pending", "translated", "reviewed", "failed"]
PLAYER_HOST, LONG, SHARE = "www.youtube-nocookie.com", 1000, 0.08
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def not_in(c: str, known: list[str]) -> Column:
    return ~F.coalesce(F.col(c).isin(known), F.lit(False))


def record_rules(site: str, folder: str = "/items/") -> list[V.Rule]:
    """The rules of a record's own fields; segments: its array, parts and zh_parts: trimmed lengths of source and translation."""
    blank = [V.Rule(c, "required", V.non_blank(c)) for c in ("id", "slug", "snapshot", "title_en", "hash")]
    address = [V.Rule(c, "not a web address", F.col(c).isNotNull() & ~urls.is_web(F.col(c))) for c in ("source_url", "archive_url", "embed_url", "thumbnail_url")]
    own = (urls.host(F.col("archive_url")) == site) & F.startswith(urls.path(F.col("archive_url")), F.lit(folder))
    empty = F.coalesce(F.size("segments"), F.lit(0)) <= 0
    return [
        *blank,
        V.Rule("type", "unknown type", not_in("type", TYPES)),
        V.Rule("kind", "unknown content", not_in("kind", CONTENTS)),
        V.Rule("day", "invalid date", V.bad_date("day")),
        V.Rule("fetched_at", "not a time stamp", ~F.coalesce(F.col("fetched_at").rlike(STAMP), F.lit(False))),
        *address,
        V.Rule("archive_url", "not of the archive", urls.is_web(F.col("archive_url")) & ~own),
        V.Rule("embed_url", "not the private player", urls.is_web(F.col("embed_url")) & (urls.host(F.col("embed_url")) != PLAYER_HOST)),
        V.Rule("duration", "negative", F.col("duration") < 0),
        V.Rule("segments", "a text without a kind", (F.col("kind") == "none") & ~empty),
        V.Rule("segments", "a kind without a text", (F.col("kind") != "none") & empty),
        V.Rule("segments", "translation too short", (F.col("parts") >= LONG) & (F.col("zh_parts") < SHARE * F.col("parts"))),
        V.Rule("title_zh", "missing translation", V.non_blank("title_zh")),
        V.Rule("status", "unknown state", not_in("status", STATES)),
        V.Rule("status", "not reviewed", F.col("status").isin([s for s in STATES if s != "reviewed"])),
        V.Rule("reviewed_at", "reviewed without a stamp", (F.col("status") == "reviewed") & V.non_blank("reviewed_at")),
        V.Rule("source_missing", "gone from the source", F.col("source_missing"), "warning"),
    ]


def segment_rules() -> list[V.Rule]:
    """The rules of segments that stand beside the one before (columns _zh and _start, and _times: how often the id occurs in its record)."""
    zh, en = F.trim("text_zh"), F.trim("text_en")
    return [
        V.Rule("sid", "missing", V.non_blank("sid")),
        V.Rule("sid", "duplicate", F.col("_times") > 1),
        V.Rule("text_en", "missing source text", en == ""),
        V.Rule("text_zh", "missing translation", zh == ""),
        V.Rule("text_zh", "no Chinese characters", (zh != "") & V.needs_han(F.col("text_en")) & (V.han_count(F.col("text_zh")) == 0)),
        V.Rule("text_zh", "implausibly short", (zh != "") & V.too_short(F.col("text_en"), F.col("text_zh"))),
        V.Rule("text_zh", "repeats the one before", (zh == F.trim("_zh")) & (F.length(zh) >= 30)),
        V.Rule("speaker_zh", "missing", V.non_blank("speaker_zh") & ~V.non_blank("speaker_en")),
        V.Rule("start", "negative", F.col("start") < 0),
        V.Rule("start", "decreasing", (F.col("start") >= 0) & (F.col("start") < F.col("_start"))),
    ]


def beside(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Segments with the text before, the last valid start before and the count of their id; a window is one record."""
    w = Window.partitionBy(key).orderBy(order)
    start = F.last(F.when(F.col("start") >= 0, F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    times = segments.groupBy(key, "sid").agg(F.count(F.lit(1)).alias("_times"))
    return segments.withColumns({"_zh": F.lag("text_zh").over(w), "_start": F.coalesce(start, F.lit(-1.0))}).join(times, [key, "sid"])


def repeats(df: DataFrame, key: str, field: str) -> DataFrame:
    """An issue for each row but the first of a repeated value: counted by aggregation, then joined back by the few that repeat."""
    again = df.groupBy(field).agg(F.count(F.lit(1)).alias("_c"), F.min(key).alias("_first")).where("_c > 1")
    rows = df.join(again, field).where(F.col(key) != F.col("_first"))
    return rows.select(F.lit("error").alias("severity"), F.col(key).cast("string").alias("id"), F.lit(field).alias("field"), F.lit("duplicate").alias("message"))


def differs(df: DataFrame, key: str, field: str, want: Column, message: str) -> DataFrame:
    return V.issues(df, key, [V.Rule(field, message, ~F.col(field).eqNullSafe(want))])


def wrong_count(df: DataFrame, expected: int) -> DataFrame:
    """One issue if there aren't as many rows as expected."""
    n = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return n.select(F.lit("error").alias("severity"), F.lit(None).cast("string").alias("id"), F.lit("records").alias("field"), F.concat(F.lit(f"expected {expected}, found "), F.col("n").cast("string")).alias("message"))


def pending(df: DataFrame, force: bool = False, resume: bool = True) -> Column:
    """Whether a unit is to be translated; the order of the tests matters.

    bad_numbers: of its parent; settled: its parent's text is authoritative; stored: a valid checkpoint; complete: the base has a text."""
    return F.lit(True) if force else F.when(F.col("bad_numbers"), True).when(F.col("settled"), False).when(F.lit(resume), ~F.col("stored")).otherwise(~F.col("complete"))


def pending_review(df: DataFrame, force: bool = False, resume: bool = True) -> Column:
    """Whether a unit is to be reviewed: always without a resume, else if its numbers are bad or what was reviewed has changed."""
    return F.lit(True) if force or not resume else F.col("bad_numbers") | ~F.col("reviewed_hash").eqNullSafe(F.col("hash"))


def complete_draft(text: Column, speaker_en: Column, speaker_zh: Column) -> Column:
    """An aggregate: every unit has its translation, and its speaker's name where there is one."""
    full = (F.coalesce(F.trim(text), F.lit("")) != "") & ((F.coalesce(speaker_en, F.lit("")) == "") | (F.coalesce(speaker_zh, F.lit("")) != ""))
    return F.bool_and(full)


def reviewable(status: Column, draft: Column, force: bool = False, resume: bool = True) -> Column:
    """Whether a record can be reviewed: a forced run that resumes takes any state."""
    return F.lit(force and resume) | F.coalesce(status == "translated", F.lit(False)) | (F.lit(resume) & F.coalesce((status == "failed") & draft, F.lit(False)))


def change_of(df: DataFrame) -> Column:
    """What became of a record since its checkpoint: new, skipped (nothing, or only its metadata, changed) or changed."""
    same_text = F.col("text_hash").eqNullSafe(F.col("old_text_hash"))
    return F.when(F.col("old_hash").isNull(), "new").when(F.col("hash") == F.col("old_hash"), "skipped").when(same_text, "skipped, stamped anew").otherwise("changed")


def reviewed(units: DataFrame, corrections: DataFrame, record: str, unit: str, good) -> DataFrame:
    """(record, status, fixed): the review's outcome. Corrections are merged into the draft; a record is reviewed if it was translated and every
    unit keeps good(source, text), else failed; other states stay. Nothing of a failed record is taken over."""
    text = F.coalesce(F.col("fix"), F.col("draft"))
    merged = units.join(corrections.select(record, unit, F.col("text").alias("fix")), [record, unit], "left")
    outcome = merged.groupBy(record).agg(F.first("status").alias("old"), F.bool_and(good(F.col("source"), text)).alias("ok"), F.count("fix").alias("fixes"))
    status = F.when(F.col("old") != "translated", F.col("old")).when(F.col("ok"), "reviewed").otherwise("failed")
    return outcome.select(record, status.alias("status"), F.when(status == "reviewed", F.col("fixes")).otherwise(0).cast("long").alias("fixed"))


def evidence(x: Column, patterns: list[str]) -> Column:
    """How often any of the patterns occurs."""
    return sum((F.regexp_count(x, F.lit(p)) for p in patterns), F.lit(0))


def with_parameter(rows: DataFrame, name: str, asked: Column, known: DataFrame, default: str) -> DataFrame:
    """Adds a facet's value: the asked one if it is among the known ones (one column, however many rows), else the default."""
    values = known.select(F.col(known.columns[0]).alias("_known")).where("_known is not null").distinct()
    return rows.withColumn(name, asked).join(values, F.col(name) == F.col("_known"), "left").withColumn(name, F.coalesce("_known", F.lit(default))).drop("_known")


def page_number(x: Column) -> Column:
    """The leading whole number, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d{1,9})", 1).try_cast("int"), F.lit(1)))


def scoped(rows: DataFrame, scope: str) -> DataFrame:
    """A search scope: one collection, or all without the transcripts, whose text the records hold as well."""
    return rows.where(F.col("collection") == "transcripts") if scope == "transcripts" else rows.where(F.col("collection") != "transcripts")


def year_of(day: Column) -> Column:
    return F.when(day.rlike(r"^\d{4}"), F.substring(day, 1, 4)).otherwise("未知")


def unescaped_markdown(x: Column) -> Column:
    return T.replaced(F.regexp_replace(x, r"\\([\\`*_\[\]#+.-])", "$1"), [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")])
