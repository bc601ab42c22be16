"""The whole audit of translated records: rules of fields, segments, texts and sets, each null-safe, as rows (severity, id, field, message).

A record has (place, id, slug, snapshot, type, kind, day, title_en, title_zh, summary_en, summary_zh, source_url, archive_url, embed_url,
thumbnail_url, duration, fetched_at, status, reviewed_at, model, source_missing, hash, has_segments); a segment has (place, turn, sid, speaker_en,
speaker_zh, start, text_en, text_zh). ``place`` is the load order and tells records apart even if their ids don't.

All texts of a record, whatever their field, become rows of one table (source and translation), which one set of rules reads in one pass. Windows are those of
one record's segments; values that repeat in the set are found by aggregation and joined back, so that a value which a third of all records share is no hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import numbers, urls
from scriptorium.operators import validate as V
from scriptorium.operators.ingest import encoded
from scriptorium.operators.states import CONTENTS, LONG, SHARE, STAMP, STATES, TYPES, not_in, wrong_count

# The player's hosts, names that stay as they are, and how names are written in a source.
PLAYERS = ["youtube-nocookie.com", "www.youtube-nocookie.com"]
PRESERVED = ["Model 3", "Model S", "Model X", "Model Y", "Falcon 9", "Falcon Heavy", "Raptor", "Super Heavy", "Cybertruck", "Tesla", "SpaceX", "xAI", "Starlink", "Starship", "Optimus", "Neuralink", "Grok", "NASA", "AllThingsD", "Big Think", "VivaTech", "Clubhouse", "Cyber Rodeo"]
CAPITAL = "(?:[A-Z]{2,}|[A-Z][a-z]+)"
NAMES = rf"\b(?:[A-Z]{{2,}}(?:\s+{CAPITAL}){{0,4}}|[A-Z][a-z]+(?:\s+{CAPITAL}){{1,4}})\b"
#: A translation of so many characters that is the one before again.
REPEAT = 30


def no(test: Column) -> Column:
    """Whether a test doesn't hold; a null test doesn't."""
    return ~F.coalesce(test, F.lit(False))


def given(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def record_rules(site: str, folder: str) -> list[V.Rule]:
    web = {c: F.coalesce(urls.is_web(F.col(c)), F.lit(False)) for c in ("source_url", "archive_url", "embed_url", "thumbnail_url")}
    path = F.regexp_replace(urls.path(F.col("archive_url")), "/$", "")
    own = (urls.host(F.col("archive_url")) == site) & (path == F.concat(F.lit(folder), encoded(F.col("id"))))
    full, none = F.coalesce("has_segments", F.lit(False)), F.coalesce(F.col("kind") == "none", F.lit(False))
    reviewed = F.coalesce(F.col("status") == "reviewed", F.lit(False))
    return [
        *[V.Rule(c, "required", ~given(c)) for c in ("id", "slug", "snapshot", "title_en", "hash")],
        V.Rule("type", "unknown type", not_in("type", TYPES)),
        V.Rule("kind", "unknown content", not_in("kind", CONTENTS)),
        V.Rule("day", "invalid date", no(~V.bad_date("day"))),
        V.Rule("fetched_at", "not a time stamp", no(F.col("fetched_at").rlike(STAMP))),
        *[V.Rule(c, "not a web address", ~web[c]) for c in ("source_url", "archive_url")],
        *[V.Rule(c, "not a web address", F.col(c).isNotNull() & ~web[c]) for c in ("embed_url", "thumbnail_url")],
        V.Rule("archive_url", "not this record of the archive", web["archive_url"] & no(own)),
        V.Rule("embed_url", "not the private player", web["embed_url"] & no(urls.host(F.col("embed_url")).isin(PLAYERS))),
        V.Rule("duration", "negative", F.col("duration").isNotNull() & no((F.col("duration") >= 0) & (F.col("duration") < float("inf")))),
        V.Rule("segments", "no list", F.col("has_segments").isNull()),
        V.Rule("segments", "a text without a kind", none & full),
        V.Rule("segments", "a kind without a text", ~none & ~full & F.col("has_segments").isNotNull()),
        V.Rule("status", "missing state", F.col("status").isNull()),
        V.Rule("status", "unknown state", F.col("status").isNotNull() & not_in("status", STATES)),
        V.Rule("status", "not reviewed", F.col("status").isNotNull() & ~reviewed),
        V.Rule("reviewed_at", "reviewed without a stamp", reviewed & no(F.col("reviewed_at").rlike(STAMP))),
        V.Rule("model", "reviewed without a model", reviewed & ~given("model")),
        V.Rule("source_missing", "gone from the source", F.col("source_missing"), "warning"),
    ]


def segment_rules() -> list[V.Rule]:
    at = lambda name: F.concat(F.lit("segments["), F.col("turn"), F.lit(f"].{name}"))
    zh, en = F.trim(F.coalesce("text_zh", F.lit(""))), F.trim(F.coalesce("text_en", F.lit("")))
    sound = F.coalesce((F.col("start") >= 0) & (F.col("start") < float("inf")), F.lit(False))
    return [
        V.Rule(at("sid"), "missing", ~given("sid")),
        V.Rule(at("sid"), "duplicate", given("sid") & (F.col("_nth") > 1)),
        V.Rule(at("text_en"), "missing source text", en == ""),
        V.Rule(at("text_zh"), "repeats the one before for another source", (F.length(zh) >= REPEAT) & (zh == F.col("_zh")) & (en != F.col("_en"))),
        V.Rule(at("start"), "negative", F.col("start").isNotNull() & ~sound),
        V.Rule(at("start"), "decreasing", sound & (F.col("start") < F.col("_start"))),
    ]


def beside(segments: DataFrame) -> DataFrame:
    """Segments with the texts before, the last sound start before, and which occurrence of its id it is."""
    w = Window.partitionBy("place").orderBy("turn")
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    start = F.last(F.when((F.col("start") >= 0) & (F.col("start") < float("inf")), F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("place", "sid").orderBy("turn"))
    return segments.withColumns({"_zh": F.lag(clean("text_zh")).over(w), "_en": F.lag(clean("text_en")).over(w), "_start": F.coalesce(start, F.lit(-1.0)), "_nth": nth})


def texts(records: DataFrame, segments: DataFrame) -> DataFrame:
    """(place, id, field, source, target, speaker): every text that has a translation, from all fields."""
    row = lambda field, source, target, speaker=False: F.struct(field.alias("field"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(speaker).alias("speaker"))
    at = lambda name: F.concat(F.lit("segments["), F.col("turn"), F.lit(f"].{name}"))
    own = records.select("place", "id", F.inline(F.array(*[row(F.lit(f"{c}_zh"), f"{c}_en", f"{c}_zh") for c in ("title", "summary")])))
    said = segments.select("place", "id", F.inline(F.array(row(at("text_zh"), "text_en", "text_zh"), row(at("speaker_zh"), "speaker_en", "speaker_zh", True))))
    return own.unionByName(said).where(given("source"))


def speaker_kept(source: Column, target: Column) -> Column:
    """Whether a name was kept as it is: two or more capitalised or capital words, perhaps with something in brackets, that differ in case and marks only."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    words = F.split(F.regexp_replace(F.trim(source), r"\s*\([^)]*\)$", ""), r"\s+")
    return (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("^(?:[A-Z][A-Za-z'’-]+|[A-Z]{2,})$")) & (bare(source) == bare(target))


def without(text: Column, terms: Column) -> Column:
    """The text without any of an array of terms."""
    return F.aggregate(terms, text, lambda x, t: F.replace(x, t, F.lit("")))


def text_rules(preserved: list[str], incomplete: bool = False) -> list[V.Rule]:
    source, target = F.col("source"), F.coalesce("target", F.lit(""))
    here = F.trim(target) != ""
    names = F.concat(F.array(*map(F.lit, preserved)), F.regexp_extract_all(source, F.lit(NAMES), F.lit(0)))
    # English is counted without what may stay, Han characters in the whole translation.
    rest = without(F.regexp_replace(target, r"https?://\S+", " "), names)
    letters, words = F.regexp_count(rest, F.lit("[A-Za-z]")), F.regexp_count(rest, F.lit("[A-Za-z]+(?:'[A-Za-z]+)?"))
    kept = F.col("speaker") & speaker_kept(source, target)
    field = F.col("field")
    return [
        V.Rule(field, "missing translation", ~here & F.lit(not incomplete)),
        V.Rule(field, "no Chinese characters", here & V.needs_han(source, preserved) & (V.han_count(target) == 0) & ~kept & ~V.numeric_utterance(source)),
        V.Rule(field, "implausibly short", here & V.too_short(source, target)),
        V.Rule(field, "too much English left", here & (words > 4) & (letters > 12) & (letters > V.han_count(target) * 1.5)),
        V.Rule(field, "numbers changed", here & (F.col("level") == "error")),
        V.Rule(field, "numbers to review", here & (F.col("level") == "warning"), "warning"),
    ]


def later(records: DataFrame, field: str) -> DataFrame:
    """An issue for each record with a value that one loaded before it has."""
    again = records.where(given(field)).groupBy(F.col(field).alias("_v")).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    rows = records.join(again, F.col(field) == F.col("_v")).where("place <> _first")
    return rows.select(F.lit("error").alias("severity"), "id", F.lit(field).alias("field"), F.lit("duplicate").alias("message"))


def audit(records: DataFrame, segments: DataFrame, site: str, folder: str = "/items/", source_hash: Column | None = None, snapshot: str | None = None, expected: int | None = None, baseline: DataFrame | None = None, preserved: list[str] | None = None, incomplete: bool = False) -> DataFrame:
    """All issues of a set of records. source_hash: what the column hash has to be; baseline: rows (id) that have to be there;
    incomplete: translations may be missing and records unreviewed."""
    ids = records.select("place", "id")
    mine = segments.join(ids, "place")
    rules = [r for r in record_rules(site, folder) if not (incomplete and r.message == "not reviewed")]
    checked = texts(records, mine).withColumn("level", numbers.level(F.col("source"), F.coalesce("target", F.lit(""))))
    bodies = mine.groupBy("place", "id").agg(F.sum(F.length(F.trim(F.coalesce("text_en", F.lit(""))))).alias("source"), F.sum(F.length(F.trim(F.coalesce("text_zh", F.lit(""))))).alias("target"))
    found = [
        V.issues(records, "id", rules),
        V.issues(beside(mine), "id", segment_rules()),
        V.issues(checked, "id", text_rules(PRESERVED if preserved is None else preserved, incomplete)),
        later(records, "id"), later(records, "slug"),
    ]
    if not incomplete:
        found.append(V.issues(bodies, "id", [V.Rule("segments", "translation too short", (F.col("source") >= LONG) & (F.col("target") < SHARE * F.col("source")))]))
    if snapshot:
        found.append(V.issues(records, "id", [V.Rule("snapshot", "another snapshot", ~F.col("snapshot").eqNullSafe(snapshot))]))
    if source_hash is not None:
        found.append(V.issues(records, "id", [V.Rule("hash", "another source", ~F.col("hash").eqNullSafe(source_hash))]))
    if expected is not None:
        found.append(wrong_count(records, expected))
    if baseline is not None:
        found.append(V.absent(baseline.select(F.col("id").cast("string").alias("id")).distinct(), records.where("id is not null"), "id"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
