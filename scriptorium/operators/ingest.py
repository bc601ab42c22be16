"""Ingestion: payloads checked and parsed, captions, records built and merged; what is wrong becomes rows, nothing is thrown away unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import urls

# The kinds of records, and the fewest that an index may have.
KINDS = ["interview", "keynote", "speech", "earnings", "space"]
FEWEST = 271
INDEX = "struct<total:bigint,entries:array<struct<id:string,type:string,date:string,title:string,url:string,source:string,sourceLabel:string,org:string,hasTranscript:boolean,durationSec:double>>>"
PARAGRAPH = "array<struct<text:string,content:string,t:double,startSec:double,start:double>>"
TRANSCRIPT = f"struct<_corrupt_record:string,error:string,title:string,titles:map<string,string>,summary:string,text:string,textByLang:map<string,string>,dialogue:array<struct<speaker:string,paras:{PARAGRAPH},paragraphs:{PARAGRAPH}>>>"
CAPTIONS = "struct<events:array<struct<tStartMs:double,segs:array<struct<utf8:string>>>>>"


def scan(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) records of a folder of JSON files, one a file: a bad file, or one whose name isn't its record's key, is set apart."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.select("*", F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("_stem"))
    good = F.col("_corrupt").isNull() & F.col(key).eqNullSafe(F.col("_stem"))
    return rows.where(good).drop("_corrupt", "_stem"), rows.where(~good).select(F.col("_stem").alias("file"), F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise("name is not the id").alias("reason"))


def checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records whose files must all have the schema: one that hasn't fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """(player, events) of caption files, whose names begin with the player's id."""
    rows = spark.read.schema(f"events {CAPTIONS[14:-1]}").option("multiLine", True).json(path)
    return rows.select(F.regexp_extract("_metadata.file_name", "^([^.]*)", 1).alias("player"), "events")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): files as one string each."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def manifest(payload: DataFrame, column: str) -> DataFrame:
    """(id) of a manifest: a JSON array of strings; anything else has no ids."""
    return payload.select(F.explode(F.from_json(column, "array<string>")).alias("id")).where("id is not null")


def sitemap_locations(files: DataFrame, text: str) -> DataFrame:
    return files.select(F.explode(F.regexp_extract_all(text, F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("loc")).distinct()


def non_empty(x: Column) -> Column:
    return T.present(T.trim(x))


def finite(x: Column) -> Column:
    """A number, or null for what isn't one (also NaN and the infinities)."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def index_entries(payloads: DataFrame, column: str) -> DataFrame:
    """The entries of an index payload, each with its place and the first of the rules that it breaks (null: none).

    Ids have to be safe and unique; a duration below zero is no fault and becomes null."""
    parsed = payloads.select(F.from_json(column, INDEX).alias("p"))
    rows = parsed.select(F.col("p.total").alias("total"), F.size("p.entries").alias("size"), F.posexplode("p.entries").alias("place", "e")).select("total", "size", "place", "e.*")
    seen = rows.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    rules = [
        ("total", F.col("total").isNotNull() & (F.col("total") != F.col("size"))), ("id", ~F.coalesce(F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))), ("duplicate", F.col("times") > 1),
        ("type", ~F.coalesce(F.col("type").isin(KINDS), F.lit(False))), ("date", ~F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))), ("title", non_empty(F.col("title")).isNull()), ("url", ~urls.is_web(F.col("url"))), ("source", ~urls.is_web(F.col("source"))),
    ]
    fault = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])
    joined = rows.join(seen, rows["id"].eqNullSafe(seen["id"]), "left").drop(seen["id"])
    return joined.select("place", "id", "type", "date", "title", "url", F.when(F.col("durationSec") >= 0, F.col("durationSec")).alias("duration"), fault.alias("fault"))


def index_report(payloads: DataFrame, key: str, column: str, fewest: int = FEWEST) -> DataFrame:
    """(key, place, id, fault): every entry of every index payload with the first rule that it breaks (null: none), and a row without a place for each
    payload that breaks one as a whole: unreadable (no JSON object), no entries (no list of them), total (another number than it says), too few.

    So no payload goes without a row: a good one has its entries, a bad one its fault."""
    known = F.try_parse_json(column)
    is_object = known.isNotNull() & F.startswith(F.trim(column), F.lit("{"))
    rows = payloads.select(key, F.from_json(column, INDEX.replace("total:bigint,", "")).alias("p"), is_object.alias("_object"), F.when(F.schema_of_variant(F.try_variant_get(known, "$.total", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(known, "$.total", "double")).alias("total"))
    entries, size = F.col("p.entries"), F.coalesce(F.size("p.entries"), F.lit(0))
    rows = rows.withColumn("whole", F.coalesce(
        F.when(~F.coalesce("_object", F.lit(False)), F.lit("unreadable")), F.when(entries.isNull(), F.lit("no entries")),
        F.when(F.col("total") != size, F.lit("total")), F.when(size < fewest, F.lit("too few")),
    ))
    wide = rows.select(key, "whole", F.posexplode_outer("p.entries").alias("place", "e"))
    each = wide.where("place is not null").select(key, "place", "e.*")
    # The first entry with an id is sound, later ones repeat it.
    seen = each.where("id is not null").groupBy(key, "id").agg(F.min("place").alias("_first"))
    met = each.alias("a").join(seen.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("a.id") == F.col("b.id")), "left").select("a.*", "_first")
    web = lambda c: F.coalesce(urls.is_web(F.col(c)), F.lit(False))
    rules = [
        ("not an object", F.coalesce(*[F.col(c).cast("string") for c in ("id", "type", "date", "title", "url", "source")]).isNull()),
        ("id", ~F.coalesce(F.trim("id").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False))), ("duplicate", F.col("place") != F.col("_first")), ("type", ~F.coalesce(F.trim("type").isin(KINDS), F.lit(False))),
        ("date", ~F.coalesce(F.trim("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))), ("address or title", non_empty(F.col("title")).isNull() | ~web("url") | ~web("source")),
    ]
    fault = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])
    faults = rows.where("whole is not null").select(key, F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("id"), F.col("whole").alias("fault"))
    return met.select(key, "place", "id", fault.alias("fault")).unionByName(faults)


def accepted_index(payloads: DataFrame, key: str, column: str, fewest: int = FEWEST) -> DataFrame:
    """The entries of index payloads, or an error that names the first faults: an index that is broken or short must not make records vanish."""
    report = index_report(payloads, key, column, fewest)
    bad = report.where("fault is not null").orderBy(F.col("place").asc_nulls_first()).limit(5).collect()
    if bad:
        raise ValueError("the index is not accepted: " + "; ".join(f"{r[key]}{'' if r['place'] is None else '[%d]' % r['place']}: {r['fault']}" for r in bad))
    return report.select(key, "place", "id")


def transcript_parts(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """(key, error, title, kind, segments) of a transcript payload: its dialogue, else its text, else the text in English."""
    p = F.from_json(column, TRANSCRIPT)
    rows = payloads.select(key, p.alias("p"))
    flat = F.flatten(F.transform("p.dialogue", lambda g: F.transform(F.coalesce(g["paras"], g["paragraphs"]), lambda x: F.struct(non_empty(g["speaker"]).alias("speaker"), F.coalesce(x["t"], x["startSec"], x["start"]).alias("start"), non_empty(F.coalesce(x["text"], x["content"])).alias("text")))))
    spoken = F.filter(flat, lambda s: s["text"].isNotNull())
    written = F.transform(T.paragraphs(F.coalesce(non_empty(F.col("p.text")), F.col("p.textByLang")["en"], F.lit(""))), lambda x: F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("start"), x.alias("text")))
    dialogue = F.coalesce(F.size(spoken) > 0, F.lit(False))
    segments = F.when(dialogue, spoken).otherwise(written)
    kind = F.when(F.col("p").isNull() | F.col("p._corrupt_record").isNotNull() | F.col("p.error").isNotNull(), "failed").when(dialogue, "dialogue").when(F.size(written) > 0, "article").otherwise("none")
    title = F.coalesce(non_empty(F.col("p.title")), non_empty(F.col("p.titles")["en"]))
    return rows.select(key, F.col("p.error").alias("error"), title.alias("title"), kind.alias("kind"), segments.alias("segments"))


def clean_caption(x: Column) -> Column:
    """Without zero-width spaces, white-space runs as one space."""
    return T.inline_text(F.replace(x, F.lit("​"), F.lit("")))


def cues(files: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place, start, text) of caption events that have a time and words; seconds with two decimals."""
    events = F.from_json(column, CAPTIONS)["events"] if dict(files.dtypes)[column] == "string" else F.col(column)
    rows = files.select(key, F.posexplode(events).alias("place", "e")).where("e.tStartMs is not null and e.segs is not null")
    text = clean_caption(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    return rows.select(key, "place", F.round(F.col("e.tStartMs") / 1000, 2).alias("start"), text.alias("text")).where("text <> ''")


def caption_matches(files: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """(player, id): the record of each caption file by its player's id; of files for one player the last wins, one without a record has a null id."""
    last = files.groupBy("player").agg(F.max(order).alias(order))
    return last.join(records.select("id", "player"), "player", "left").select("player", "id")


def needs_page(df: DataFrame) -> Column:
    """Whether the detail page has to be read as well: the transcript has no text or summary, or neither it nor the source names a player."""
    lacking = F.col("kind").isNull() | (F.col("kind") == "none") | (F.coalesce(F.col("parts"), F.lit(0)) == 0) | (F.coalesce(F.col("summary"), F.lit("")) == "")
    return lacking | (F.col("embed").isNull() & (F.coalesce(F.col("source"), F.lit("")) != "") & urls.player_id(F.col("source")).isNull())


def built(new: DataFrame, detail: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One record a key: every field from the transcript, else the detail page, else the supplement; origin: the first that has a text."""
    rows = new
    for name, other in (("_d", detail), ("_s", extra)):
        rows = rows.join(other.select(key, *[F.col(c).alias(f"{name}{c}") for c in fields]), key, "left")
    pick = [F.coalesce(T.present(F.col(c)), T.present(F.col(f"_d{c}")), T.present(F.col(f"_s{c}"))).alias(c) for c in fields]
    origin = F.when(T.present(F.col(fields[0])).isNotNull(), "transcript").when(T.present(F.col(f"_d{fields[0]}")).isNotNull(), "detail").when(T.present(F.col(f"_s{fields[0]}")).isNotNull(), "supplement").otherwise("none")
    return rows.select(key, *pick, origin.alias("origin"))


def merged_records(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """An upsert: the first snapshot stays; a translation stays while its source does; the state stays while all of them do, else it is pending.

    Both sides: key, snapshot, title_en, summary_en, title_zh, summary_zh, status, model."""
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in ("snapshot", "title_en", "summary_en", "title_zh", "summary_zh", "status", "model")])
    same = {c: F.coalesce(F.col(f"{c}_en") == F.col(f"_{c}_en"), F.lit(False)) for c in ("title", "summary")}
    kept = [F.when(same[c], F.col(f"_{c}_zh")).otherwise("").alias(f"{c}_zh") for c in ("title", "summary")]
    status = F.when(same["title"] & same["summary"], F.col("_status")).otherwise("pending")
    return new.join(o, key, "left").select(key, F.coalesce("_snapshot", "snapshot").alias("snapshot"), *kept, status.alias("status"), F.col("_model").alias("model"))


def reuses_captions(df: DataFrame) -> Column:
    """Whether earlier captions may stay with a record: they came from captions, there are some, nothing better came, and neither the
    record nor its player changed."""
    same_player = F.coalesce(F.col("player") == F.col("old_player"), F.lit(False))
    return (F.col("old_origin") == "captions") & (F.coalesce(F.col("old_parts"), F.lit(0)) > 0) & (F.col("kind") == "none") & (F.col("id") == F.col("old_id")) & same_player & F.col("player").isNotNull()


def shown_player(url: Column) -> Column:
    """The player's id by the rules of display: v= counts on /watch only, and behind embed, shorts or live on any path."""
    host, path = F.regexp_replace(urls.host(url), r"^www\.", ""), urls.path(url)
    own = F.when(path == "/watch", urls.parameter(url, "v")).otherwise(F.regexp_extract(path, "/(?:embed|shorts|live)/+([^/]+)", 1))
    return T.present(F.when(host == "youtu.be", F.regexp_extract(path, "^/+([^/]+)", 1)).when(F.endswith(host, F.lit("youtube.com")) | (host == "youtube-nocookie.com"), own))


def embed_address(player: Column) -> Column:
    return F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), player, F.lit("?enablejsapi=1&rel=0"))


def thumbnail(own: Column, player: Column) -> Column:
    """The record's own picture, else its player's."""
    return F.coalesce(T.present(own), F.concat(F.lit("https://i.ytimg.com/vi/"), player, F.lit("/hqdefault.jpg")))


def encoded(x: Column) -> Column:
    """Percent-encoded as a part of an address."""
    return T.replaced(F.url_encode(x), [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")])


def date_zh(x: Column) -> Column:
    """2024-03-09 as 2024年3月9日; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(x, "yyyy-MM-dd"), "y年M月d日"), x)


def unfenced(x: Column) -> Column:
    """The JSON inside a fenced block, or the text itself."""
    return F.trim(F.regexp_replace(F.trim(x), r"^```(?:json)?\s*|\s*```$", ""))


def string_field(x: Column, name: str) -> Column:
    """The first string under a key, wherever it stands, with its escapes resolved."""
    raw = F.regexp_extract(x, rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    return F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")


def file_name(x: Column) -> Column:
    return F.concat(F.regexp_replace(x, "[^A-Za-z0-9._-]", "_"), F.lit(".json"))


def unit_size(*columns: str) -> Column:
    """Characters of a unit as compact JSON."""
    return F.length(F.to_json(F.struct(*columns)))


def keeps_name(source: Column, target: Column) -> Column:
    """Whether a speaker's name was kept as it is: capitalised words that differ in case and marks only."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return source.rlike(r"^[A-Z][A-Za-z.'-]*(\s+[A-Z][A-Za-z.'-]*)*$") & (bare(source) == bare(target))


def part_rows(units: DataFrame, key: list[str], parts: str, speaker: str) -> DataFrame:
    """Units in parts: ids with the part's number where there are several, the speaker on the first alone."""
    rows = units.select(*key, F.col(speaker).alias("_speaker"), F.size(parts).alias("_n"), F.posexplode(parts).alias("_i", "text"))
    ident = F.when(F.col("_n") > 1, F.concat(F.col(key[0]), F.format_string("::part:%04d", F.col("_i") + 1))).otherwise(F.col(key[0]))
    return rows.select(ident.alias("id"), F.when(F.col("_n") > 1, F.col(key[0])).alias("parent"), "text", F.when(F.col("_i") == 0, F.col("_speaker")).otherwise("").alias("speaker"))


def first_alignment(parts: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, priority) of the first candidate split whose parts all equal the given ones (null priority: none).

    parts: key, part, text. candidates: key, priority, part, text. Counts have to agree, so missing and extra parts rule a candidate out."""
    given = parts.groupBy(key).agg(F.count(F.lit(1)).alias("_given"))
    met = candidates.join(parts.withColumnRenamed("text", "_text"), [key, "part"], "left")
    whole = met.groupBy(key, "priority").agg(F.count(F.lit(1)).alias("_m"), F.bool_and(F.coalesce(F.col("text") == F.col("_text"), F.lit(False))).alias("ok"))
    best = whole.where("ok").join(given, key).where("_m = _given").groupBy(key).agg(F.min("priority").alias("priority"))
    return given.select(key).join(best, key, "left")


def in_source_order(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in source order, with their place: a top-k."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # most rows
