"""Whole documents from records: Markdown, archive JSON, sitemaps, structured data. Every record is a row; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import urls
from scriptorium.operators.related import numbered

# The labels of kinds, contents and states, and the limits of a video sitemap.
TYPES = {"interview": "访谈", "keynote": "主题演讲", "speech": "公开演讲", "earnings": "财报会议", "space": "线上对谈"}
CONTENTS = {"dialogue": "对话实录", "article": "全文", "none": "暂无正文"}
STATES = {"pending": "待翻译", "translated": "已翻译", "reviewed": "已校对", "failed": "翻译异常"}
TITLE, DESCRIPTION, LONGEST = 100, 2048, 28_800


def label(x: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(x == k, v) for k, v in names.items()], x)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty; empty if there is none."""
    return F.coalesce(*[T.present(c) for c in columns], F.lit(""))


def line(x: Column) -> Column:
    """Markdown text on one line."""
    return F.regexp_replace(T.escape_markdown(x), r"\s*\n\s*", " ")


def link(name: Column, url: Column) -> Column:
    return F.concat(F.lit("["), line(name), F.lit("](<"), T.replaced(url, [("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D")]), F.lit(">)"))


def attribute(x: Column) -> Column:
    return T.replaced(x, [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")])


def page_url(slug: Column, folder: str, site: str) -> Column:
    return F.concat(F.lit(f"{site}/{folder}/"), slug, F.lit("/"))


def updated(df: DataFrame) -> Column:
    return first_of(df["reviewed_at"], df["translated_at"], df["fetched_at"])


def transcript_link(df: DataFrame, own: bool = True) -> Column:
    """The transcript's address if it is a web address without a user (own: and none of the record's others), else null."""
    x = F.trim("transcript_source")
    ok = urls.is_web(x, False)
    return F.when(ok & (x != F.col("source_url")) & (x != F.col("archive_url")) if own else ok, x)


def has_translation(segments: Column, kind: Column) -> Column:
    return (kind != "none") & (F.size(segments) > 0) & F.forall(segments, lambda s: F.trim(s["text_zh"]) != "")


def record_markdown(df: DataFrame, site: str) -> Column:
    """A record as a document: title, header, both summaries, and the text in both languages or a note that there is none."""
    page, title = page_url(F.col("slug"), "records", site), first_of(F.col("title_zh"), F.col("title_en"))
    item = lambda name, value: F.concat(F.lit(f"- **{name}:** "), value)
    both = lambda x, names: F.concat(label(x, names), F.lit(" ("), x, F.lit(")"))
    source = transcript_link(df, False)
    head = [
        F.concat(F.lit("# "), line(title)), F.lit(""), F.concat(F.lit("> "), line(F.col("title_en"))), F.lit(""),
        item("Record", F.concat(F.lit("`"), line(F.col("id")), F.lit("`"))), item("Snapshot", F.col("snapshot")), item("Date", F.col("day")), item("Type", both(F.col("type"), TYPES)),
        item("Organization", F.when(F.col("org") == "", "Not specified").otherwise(line(F.col("org")))), item("Duration", F.when(F.col("duration").isNull(), "Not specified").otherwise(T.duration(F.greatest(F.lit(0.0), F.col("duration"))))),
        item("Content", both(F.col("kind"), CONTENTS)), item("Translation", both(F.col("status"), STATES)), item("Updated", updated(df)), item("Page", link(title, page)),
        item("Source", link(first_of(F.col("source_label"), F.col("source_url")), F.col("source_url"))), F.when(source.isNotNull(), item("Transcript", link(source, source))),
        F.lit(""), F.lit("## Summary"), F.lit(""), T.escape_markdown(first_of(F.col("summary_zh"), F.col("summary_en"))), F.lit(""), T.escape_markdown(F.col("summary_en")), F.lit(""),
    ]

    def body(name: str, first: str, second: str, text: Column, mark: str) -> Column:
        def one(s: Column, i: Column) -> Column:
            speaker = first_of(s[f"speaker_{first}"], s[f"speaker_{second}"], F.concat(F.lit("Paragraph "), (i + 1).cast("string")))
            at = F.when(s["start"].isNotNull(), F.concat(F.lit(" · "), T.timestamp(F.greatest(F.lit(0.0), s["start"]))))
            heading = F.concat(F.lit("### "), s["sid"], F.lit(" · "), line(speaker), F.coalesce(at, F.lit("")))
            return F.concat_ws("\n", F.concat(F.lit('<a id="'), attribute(s["sid"]), F.lit(f'{mark}"></a>')), heading, F.lit(""), T.escape_markdown(text(s)), F.lit(""))

        return F.concat_ws("\n", F.lit(f"## {name}"), F.lit(""), F.array_join(F.transform("segments", one), "\n"))

    none = (F.col("kind") == "none") | (F.size("segments") == 0)
    texts = F.concat_ws("\n", body("Chinese", "zh", "en", lambda s: first_of(s["text_zh"], s["text_en"]), ""), body("English", "en", "zh", lambda s: s["text_en"], "-en"))
    return F.concat(F.concat_ws("\n", *head), F.lit("\n"), F.when(none, F.lit("No text is available.\n")).otherwise(F.concat(texts, F.lit("\n"))))


def transcript_markdown(df: DataFrame, site: str) -> Column:
    """The translation alone, never with the source's text in its place."""
    count = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + T.visible_length(s["text_zh"]))
    own = transcript_link(df)

    def one(s: Column, i: Column) -> Column:
        speaker = T.present(first_of(F.trim(s["speaker_zh"]), F.trim(s["speaker_en"])))
        at = F.when(s["start"].isNotNull(), T.timestamp(F.greatest(F.lit(0.0), s["start"])))
        heading = F.concat_ws(" · ", F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 段")), speaker, at)
        return F.concat_ws("\n", F.concat(F.lit("### "), line(heading)), F.lit(""), T.escape_markdown(s["text_zh"]), F.lit(""))

    lines = [
        F.concat(F.lit("# "), line(F.col("title_zh"))), F.concat(F.lit("- "), F.col("day")), F.concat(F.lit("- "), label(F.col("type"), TYPES)), F.concat(F.lit("- "), count.cast("string"), F.lit(" 字, "), T.reading_minutes(count).cast("string"), F.lit(" 分钟")),
        F.when(own.isNotNull(), F.concat(F.lit("- "), link(F.lit("文字记录来源"), own))), F.lit(""), T.escape_markdown(F.col("summary_zh")), F.lit(""), F.array_join(F.transform("segments", one), "\n"),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def archive_item(df: DataFrame, site: str) -> Column:
    """A record of the archive's index as JSON: nested, with keys only where there is something to say."""
    some = lambda c: T.present(F.col(c))
    pair = lambda name: F.struct(some(f"{name}_zh").alias("zh"), some(f"{name}_en").alias("en")).alias(name)
    item = F.struct(
        "id", "type", "day", pair("title"), pair("summary"), some("org").alias("org"), F.when(F.col("duration") >= 0, F.col("duration").cast("long")).alias("duration"),
        F.struct("source_url", some("source_label").alias("label")).alias("source"), F.struct("status", some("translated_at").alias("translatedAt"), some("reviewed_at").alias("reviewedAt")).alias("translation"),
        F.struct(page_url(F.col("slug"), "records", site).alias("html"), F.when(has_translation(F.col("segments"), F.col("kind")), page_url(F.col("slug"), "transcripts", site)).alias("transcript")).alias("links"),
    )
    return F.to_json(item)


def video_sitemap(df: DataFrame, site: str) -> DataFrame:
    """(n, entry): the records that a video sitemap takes; a bad duration is left out, a bad address or date leaves the record out."""
    title, description = T.escape_xml(first_of(F.col("title_zh"), F.col("title_en")), TITLE), T.escape_xml(first_of(F.col("summary_zh"), F.col("summary_en")), DESCRIPTION)
    dated = F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("day", "yyyy-MM-dd").isNotNull()
    ok = urls.is_web(F.col("thumbnail_url"), False) & urls.is_web(F.col("embed_url"), False) & dated & (title != "") & (description != "")
    whole = (F.col("duration") == F.floor("duration")) & F.col("duration").between(1, LONGEST)
    tag = lambda name, value: F.concat(F.lit(f"<video:{name}>"), value, F.lit(f"</video:{name}>"))
    lines = [
        F.concat(F.lit("<url><loc>"), T.escape_xml(page_url(F.col("slug"), "records", site)), F.lit("</loc><video:video>")), tag("thumbnail_loc", T.escape_xml(F.col("thumbnail_url"))), tag("title", title), tag("description", description),
        F.concat(F.lit('<video:player_loc allow_embed="yes">'), T.escape_xml(F.col("embed_url")), F.lit("</video:player_loc>")), tag("publication_date", F.col("day")), F.when(whole, tag("duration", F.col("duration").cast("long").cast("string"))), F.lit("</video:video></url>"),
    ]
    return df.where(ok).select("n", F.concat_ws("\n", *lines).alias("entry"))


def source_urls(df: DataFrame) -> Column:
    """The distinct web addresses of a record's sources, in order."""
    return F.array_distinct(F.filter(F.array("source_url", "archive_url", "transcript_source"), lambda u: urls.is_web(u, False)))


def citations(df: DataFrame) -> Column:
    """struct(name, url) of each source; an address that is several things has the name of the first."""
    name = lambda u: F.when(u == F.col("archive_url"), "Archive").when(u == F.col("source_url"), first_of(F.col("source_label"), F.lit("Source"))).otherwise("Transcript")
    return F.transform(source_urls(df), lambda u: F.struct(name(u).alias("name"), u.alias("url")))


def json_ld(df: DataFrame, site: str) -> Column:
    """A record's structured data, safe inside a script element."""
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("VideoObject").alias("@type"), first_of(F.col("title_zh"), F.col("title_en")).alias("name"), T.truncated(first_of(F.col("summary_zh"), F.col("summary_en"))).alias("description"),
        F.col("day").alias("uploadDate"), F.col("thumbnail_url").alias("thumbnailUrl"), T.iso_duration(F.col("duration")).alias("duration"), page_url(F.col("slug"), "records", site).alias("url"), F.substring(updated(df), 1, 10).alias("dateModified"),
        F.transform(citations(df), lambda c: F.struct(F.lit("CreativeWork").alias("@type"), c["name"].alias("name"), c["url"].alias("url"))).alias("citation"),
    )
    return T.json_ld_safe(F.to_json(node))


def listing_parts(df: DataFrame, by: str, key: str, line: Column, size: int) -> DataFrame:
    """(by, part, lines, listing): the listing of each group in parts of at most size lines, in order of the (numeric) key.

    Positions come by ranges of the key, so a group of any size is split over tasks and no part holds more than its lines."""
    placed = numbered(df.select(by, key, line.alias("_line")), [by], F.col(key), [F.col(key)])
    part = F.floor((F.col("position") - 1) / size).cast("long").alias("part")
    grouped = placed.groupBy(by, part).agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("position", "_line"))).alias("_x"))
    head = F.concat(F.lit("## "), F.col(by), F.lit(" · "), (F.col("part") + 1).cast("string"), F.lit("\n"))
    return grouped.select(by, "part", "lines", F.concat(head, F.array_join(F.transform("_x", lambda r: r["_line"]), "\n")).alias("listing"))
