"""What a site publishes of its records beyond single pages: structured data of listings and details, listings by section, addresses to announce; and
what comes back into records: captions, returned units, parts of units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import numbers, urls
from scriptorium.functions import text as T
from scriptorium.operators import build as B
from scriptorium.operators import exports as X
from scriptorium.operators.related import numbered
from scriptorium.operators.snapshots import content_hash

PAGE, ANNOUNCED = 24, 10_000
# Fixed value: the picture that an archive shows where it has none.
NO_PICTURE = "/og-default.jpg"


def code_units(x: Column) -> Column:
    """A sort key for the order of UTF-16 code units, which differs from that of code points beyond the basic plane."""
    return F.encode(x, "UTF-16BE")


def sorted_by_code_units(xs: Column) -> Column:
    return F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(code_units(x).alias("k"), x.alias("x")))), lambda s: s["x"])


def modified(df: DataFrame) -> Column:
    return F.greatest(*[T.present(F.col(c)) for c in ("reviewed_at", "translated_at", "fetched_at")])


def collection_json_ld(df: DataFrame, by: str, place: str, site: str, page: int = PAGE) -> DataFrame:
    """(by, page, json): the structured data of each page of each listing: the page, and its items with their places in the whole listing.

    place: the listing's order, as a number that rises. Places come by ranges, so a listing of any length is split over tasks, and a document
    holds one page's items."""
    rows = numbered(df.select(by, place, X.first_of(F.col("title_zh"), F.col("title_en")).alias("name"), X.page_url(F.col("slug"), "records", site).alias("url"), modified(df).alias("_modified")), [by], F.col(place), [F.col(place)])
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.max("_modified").alias("_last"))
    pages = rows.withColumn("page", F.floor((F.col("position") - 1) / page) + 1).groupBy(by, "page").agg(F.array_sort(F.collect_list(F.struct(F.col("position").alias("p"), "name", "url"))).alias("x"))
    address = F.concat(F.lit(f"{site}/categories/"), by, F.lit("/"))
    items = F.transform("x", lambda r: F.struct(F.lit("ListItem").alias("@type"), r["p"].alias("position"), r["url"].alias("url"), r["name"].alias("name")))
    graph = F.array(
        F.to_json(F.struct(F.lit("CollectionPage").alias("@type"), F.concat(address, F.lit("#collection")).alias("@id"), address.alias("url"), F.struct(F.concat(address, F.lit("#items")).alias("@id")).alias("mainEntity"), F.col("_last").alias("dateModified"))),
        F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.concat(address, F.lit("#items")).alias("@id"), F.col("_n").alias("numberOfItems"), items.alias("itemListElement"))),
    )
    return pages.join(totals, by).select(by, "page", T.json_ld_safe(F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(graph, ","), F.lit("]}"))).alias("json"))


def detail_json_ld(df: DataFrame, site: str) -> DataFrame:
    """(n, json): a record's page, its way from the home page, and its medium: a video if player and picture are web addresses, else an article."""
    page, title = X.page_url(F.col("slug"), "records", site), X.first_of(F.col("title_zh"), F.col("title_en"))
    about = T.truncated(X.first_of(F.col("summary_zh"), F.col("summary_en")))
    web = lambda c: F.when(urls.is_web(F.col(c), False), F.col(c))
    picture, player = web("thumbnail_url"), web("embed_url")
    video = picture.isNotNull() & player.isNotNull()
    ident = lambda x: F.concat(page, F.lit(f"#{x}"))
    own = F.when(video, ident("video")).otherwise(ident("article"))
    cited = F.transform(X.citations(df), lambda c: F.struct(F.lit("CreativeWork").alias("@type"), c["name"].alias("name"), c["url"].alias("url")))
    of = lambda test, value: F.when(test, value)
    stamp = X.updated(df)
    step = lambda n, name, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), name.alias("name"), item.alias("item"))
    nodes = [
        F.struct(F.lit("BreadcrumbList").alias("@type"), ident("breadcrumb").alias("@id"), F.array(step(1, F.lit("影像目录"), F.lit(f"{site}/")), step(2, title, page)).alias("itemListElement")),
        F.struct(F.lit("WebPage").alias("@type"), ident("webpage").alias("@id"), page.alias("url"), title.alias("name"), about.alias("description"), F.col("day").alias("datePublished"), stamp.alias("dateModified"), F.struct(own.alias("@id")).alias("mainEntity"), of(picture.isNotNull(), F.struct(F.lit("ImageObject").alias("@type"), picture.alias("url"))).alias("primaryImageOfPage")),
        F.struct(
            F.when(video, "VideoObject").otherwise("Article").alias("@type"), own.alias("@id"), title.alias("name"), F.col("id").alias("identifier"), page.alias("url"), F.col("day").alias("datePublished"), stamp.alias("dateModified"), X.source_urls(df).alias("isBasedOn"), cited.alias("citation"),
            of(video, F.col("title_en")).alias("alternateName"), of(video, F.col("day")).alias("uploadDate"), of(video, F.array(picture)).alias("thumbnailUrl"), of(video, player).alias("embedUrl"), of(video, T.iso_duration(F.col("duration"))).alias("duration"),
            of(~video, title).alias("headline"), of(~video, F.col("title_en")).alias("alternativeHeadline"), of(~video & picture.isNotNull(), F.array(picture)).alias("image"),
        ),
    ]
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.concat_ws(",", *[F.to_json(n) for n in nodes]), F.lit("]}"))
    return df.select("n", T.json_ld_safe(graph).alias("json"))


def json_types(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, type): every distinct ``@type`` of JSON documents, at any depth. One pass for each level of nesting."""
    # Documents are dealt anew, so that each is made and parsed once for a level, not once for each use in it.
    level = rows.select(key, F.col(column).alias("_json")).repartition(F.col(key)).select(key, F.try_parse_json("_json").alias("v")).where("v is not null")
    found = None
    while True:
        spark = level.sparkSession
        level.createOrReplaceTempView("_json_level")
        below = spark.sql(f"SELECT l.`{key}`, e.key AS _name, e.value AS v FROM _json_level l, LATERAL variant_explode(l.v) e")
        own = below.where("_name = '@type'")
        many = own.select(key, F.explode(F.try_variant_get("v", "$", "array<string>")).alias("type"))
        part = own.where("schema_of_variant(v) = 'STRING'").select(key, F.try_variant_get("v", "$", "string").alias("type")).unionByName(many).where("type is not null").distinct()
        found = part if found is None else found.unionByName(part)
        level = below.where("schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%'").select(key, "v")
        if level.isEmpty():
            return found.distinct()


def listing_lines(df: DataFrame, place: str, site: str, head: list[str]) -> DataFrame:
    """(section, position, line) of a text listing: head; kinds; all records; translated transcripts. Lines are rows, in order of section and position, so
    a listing of any length is written by as many tasks."""
    title = X.link(X.first_of(F.col("title_zh"), F.col("title_en")), F.concat(F.lit(f"{site}/records/"), "slug", F.lit(".md")))
    said = F.concat_ws(" · ", *[X.line(c) for c in (F.col("day"), X.label(F.col("type"), X.TYPES))], F.when(F.col("org") != "", X.line(F.col("org"))))
    line = F.concat(F.lit("- "), title, F.lit(": "), said, F.lit(" · "), X.link(F.lit("网页版"), X.page_url(F.col("slug"), "records", site)), F.lit(" · English: "), X.line(F.col("title_en")))
    own = F.concat(F.lit("- "), X.link(F.col("title_zh"), F.concat(F.lit(f"{site}/transcripts/"), "slug", F.lit(".md"))), F.lit(": "), F.col("day"), F.lit(" · "), X.label(F.col("type"), X.TYPES))
    spark = df.sparkSession
    top = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate(head)], "section int, position long, line string")
    kinds = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(X.TYPES.items())], "type string, name string, i long")
    present = df.select("type").distinct().join(F.broadcast(kinds), "type")
    out = top.unionByName(spark.createDataFrame([(1, 0, "## 分类档案")], top.schema))
    out = out.unionByName(present.select(F.lit(1).alias("section"), (F.col("i") + 1).alias("position"), F.concat(F.lit("- "), X.link(F.concat("name", F.lit("档案")), F.concat(F.lit(f"{site}/categories/"), "type", F.lit("/")))).alias("line")))
    for section, name, rows, text, what in ((2, "全部档案", df, line, "条"), (3, "中文文字稿", df.where(X.has_translation(F.col("segments"), F.col("kind"))), own, "篇")):
        count = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("position"), F.concat(F.lit(f"## {name}（"), F.col("n").cast("string"), F.lit(f" {what}）")).alias("line"))
        placed = numbered(rows.select(place, text.alias("line")), [], F.col(place), [F.col(place)])
        out = out.unionByName(count).unionByName(placed.select(F.lit(section).alias("section"), F.col("position").cast("long").alias("position"), "line"))
    return out


def announced(addresses: DataFrame, column: str, site: str, most: int = ANNOUNCED) -> DataFrame:
    """The distinct addresses to announce; none, too many, or one of another site is an error."""
    found = addresses.select(column).where(F.col(column).isNotNull()).distinct()
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~(F.startswith(column, F.lit(f"{site}/")) | (F.col(column) == site)), F.col(column))).alias("other")).first()
    if not 1 <= seen["n"] <= most:
        raise ValueError(f"{seen['n']} addresses, 1 to {most} can be announced")
    if seen["other"] is not None:
        raise ValueError(f"an address of another site: {seen['other']}")
    return found


def picture(candidate: Column, player: Column, archive: str) -> Column:
    """A record's picture: its own if it is a web address without a user and not the archive's stand-in, else its player's."""
    bare = F.regexp_replace(F.lower(urls.host(candidate)), r"^www\.", "")
    stand_in = (bare == F.lit(archive)) & (F.lower(urls.path(candidate)) == NO_PICTURE)
    return F.coalesce(F.when(urls.is_web(candidate, False) & ~F.coalesce(stand_in, F.lit(False)), candidate), F.concat(F.lit("https://i.ytimg.com/vi/"), player, F.lit("/hqdefault.jpg")))


def units_of(records: DataFrame, key: str) -> DataFrame:
    """(key, place, unit, kind, text, text_zh, speaker, speaker_zh): title and summary, then segments, each where it has a text to translate."""
    meta = [F.struct(F.lit(f"meta:{c}").alias("unit"), F.lit(c).alias("kind"), F.col(f"{c}_en").alias("text"), F.col(f"{c}_zh").alias("text_zh"), F.lit("").alias("speaker"), F.lit("").alias("speaker_zh")) for c in ("title", "summary")]
    said = F.transform("segments", lambda s: F.struct(F.concat(F.lit("segment:"), s["sid"]).alias("unit"), F.lit("segment").alias("kind"), s["text_en"].alias("text"), s["text_zh"].alias("text_zh"), F.coalesce(s["speaker_en"], F.lit("")).alias("speaker"), F.coalesce(s["speaker_zh"], F.lit("")).alias("speaker_zh")))
    all_units = F.filter(F.concat(F.array(*meta), F.coalesce(said, F.array().cast("array<struct<unit:string,kind:string,text:string,text_zh:string,speaker:string,speaker_zh:string>>"))), lambda u: F.trim(F.coalesce(u["text"], F.lit(""))) != "")
    return records.select(key, F.posexplode(all_units).alias("place", "u")).select(key, "place", "u.*")


def applied_parts(base: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, text_zh, speaker_zh): every base unit with the joined texts of its parts if it has parts and all of them a text, else with its own.

    base: key, unit, text_zh, speaker_zh; parts: key, id, parent (null: the part is the unit), part, text_zh, speaker_zh."""
    given = F.trim(F.coalesce("text_zh", F.lit(""))) != ""
    rows = parts.withColumn("unit", F.coalesce("parent", "id"))
    whole = rows.groupBy(*key, "unit").agg(
        F.bool_and(given).alias("_all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("part", F.lit(0)).alias("p"), F.trim(F.coalesce("text_zh", F.lit(""))).alias("t")))), lambda x: x["t"]), "").alias("_text"),
        F.min(F.when(F.trim(F.coalesce("speaker_zh", F.lit(""))) != "", F.struct(F.coalesce("part", F.lit(0)).alias("p"), F.col("speaker_zh").alias("s")))).alias("_speaker"),
    )
    done = F.coalesce("_all", F.lit(False))
    return base.join(whole, [*key, "unit"], "left").select(*key, "unit", F.when(done, F.col("_text")).otherwise(F.col("text_zh")).alias("text_zh"), F.when(done, F.coalesce("_speaker.s", "speaker_zh")).otherwise(F.col("speaker_zh")).alias("speaker_zh"))


def returned(requested: DataFrame, rows: DataFrame, batch: str, good: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(batch, id, text_zh, speaker_zh, fault): what came back for each batch of requested units, checked.

    requested: batch, id, text, speaker; rows: batch, id, text_zh, speaker_zh. Faults: unexpected, duplicate, omitted, empty, no speaker, numbers. Where one unit
    was asked for and one row came back under an id that wasn't, the row is the unit's."""
    good = good or (lambda source, target: numbers.level(source, F.coalesce(target, F.lit(""))) != "error")
    one = lambda df, name: df.groupBy(batch).agg(F.count(F.lit(1)).alias(f"_n{name}"), F.first("id").alias(f"_id{name}"))
    alone = one(requested, "q").join(one(rows, "r"), batch).where("_nq = 1 and _nr = 1").select(batch, F.col("_idq").alias("_only"))
    named = rows.join(alone, batch, "left").withColumn("id", F.coalesce("_only", "id")).drop("_only")
    again = named.groupBy(batch, "id").agg(F.count(F.lit(1)).alias("_times"), F.first("text_zh").alias("text_zh"), F.first("speaker_zh").alias("speaker_zh"))
    q = requested.select(batch, "id", "text", "speaker", F.lit(True).alias("_asked"))
    a, b = again.alias("a"), q.alias("q")
    met = (F.col(f"a.{batch}") == F.col(f"q.{batch}")) & F.col("a.id").eqNullSafe(F.col("q.id"))
    both = a.join(b, met, "full_outer").select(F.coalesce(f"a.{batch}", f"q.{batch}").alias(batch), F.coalesce("a.id", "q.id").alias("id"), "text", "speaker", "_asked", "_times", "text_zh", "speaker_zh")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fault = F.when(F.col("_asked").isNull(), "unexpected").when(F.col("_times").isNull(), "omitted").when(F.col("_times") > 1, "duplicate").when(blank("text_zh"), "empty").when(~blank("speaker") & blank("speaker_zh"), "no speaker").when(~good(F.col("text"), F.col("text_zh")), "numbers")
    return both.select(batch, "id", F.trim("text_zh").alias("text_zh"), F.trim("speaker_zh").alias("speaker_zh"), fault.alias("fault"))


def with_captions(records: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(fault, and the columns of a record): records whose text is replaced by captions of their player.

    records: the columns of build.RECORD; paragraphs: player, place, start, text. The record becomes a pending article with the captions as segments, the
    player's address as the source of its text, and a new hash. A player that no record has, or without any text, is a row with a fault alone."""
    seg = F.struct(F.col("place"), F.concat(F.lit("s"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("sid"), F.lit(None).cast("string").alias("speaker_en"), F.col("start"), F.col("text").alias("text_en"), F.lit("").alias("text_zh"), F.lit(None).cast("string").alias("speaker_zh"))
    spoken = paragraphs.groupBy("player").agg(F.array_sort(F.collect_list(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", seg))).alias("_x"))
    fields = ("sid", "speaker_en", "start", "text_en", "text_zh", "speaker_zh")
    spoken = spoken.select("player", F.transform("_x", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("_segments"))
    # Of several records with one player the last by id is meant.
    own = records.withColumn("player", urls.parameter(F.col("source_url"), "v")).where("player <> ''")
    last = own.withColumn("_r", F.row_number().over(Window.partitionBy("player").orderBy(F.col("id").desc()))).where("_r = 1").drop("_r")
    met = spoken.join(last, "player", "left")
    fault = F.when(F.col("id").isNull(), F.concat(F.lit("no record for "), "player")).when(F.size("_segments") == 0, F.concat(F.lit("no text for "), "player"))
    new = {"kind": F.lit("article"), "origin": F.lit("captions"), "segments": F.col("_segments"), "status": F.lit("pending"), "model": F.lit(None).cast("string"), "translated_at": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("string"), "transcript_source": F.col("source_url")}
    out = met.withColumn("fault", fault).withColumns(new)
    bare = F.transform("segments", lambda s: F.struct(*[s[f].alias(f) for f in fields[:4]]))
    hashed = ("type", "day", "title_en", "summary_en", "source_url", "embed_url", "kind", "segments", "transcript_source")
    out = out.withColumn("hash", content_hash({"id": F.col("id")} | {c: bare if c == "segments" else F.col(c) for c in hashed}))
    return out.select("fault", *[F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in B.COLUMNS])
