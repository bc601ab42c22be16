"""Queries over whole records: exports, search records, citations, site maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import urls
from scriptorium.operators import exports as X
from scriptorium.sources.entities import WITH, entries, records, segments
from scriptorium.sources.tables import table

QUERIES, SQL = {}, {}
SITE = "https://archive.example"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def md(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]])', '\\\1', 'g'), E' \n\t\r')"


def one_line(x: str) -> str:
    return rf"regexp_replace({md(x)}, '\s*\n\s*', ' ', 'g')"


def link(name: str, url: str) -> str:
    return f"'[' || {one_line(name)} || '](<' || replace(replace({url}, '<', '%3C'), '>', '%3E') || '>)'"


def first(*xs: str) -> str:
    """The first that is neither null nor empty."""
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def named(x: str, names: dict[str, str]) -> str:
    return f"CASE {x} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} ELSE {x} END"


def clock(s: str) -> str:
    return f"CASE WHEN {s} >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', {s} // 3600, {s} // 60 % 60, {s} % 60) ELSE format('{{:d}}:{{:02d}}', {s} // 60, {s} % 60) END"


def web(x: str) -> str:
    return rf"coalesce(regexp_matches({x}, '^https?://[^\s/?#]+') AND NOT regexp_matches({x}, '^https?://[^/?#]*@'), false)"


def xml(x: str, most: int) -> str:
    return f"replace(replace(replace(replace(replace(left(trim({x}), {most}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


START = "CAST(greatest(0, floor(start)) AS BIGINT)"
TITLE, SUMMARY, UPDATED = first("title_zh", "title_en"), first("summary_zh", "summary_en"), first("reviewed_at", "translated_at", "fetched_at")
PAGE, TRANSLATED = f"'{SITE}/records/' || slug || '/'", "kind <> 'none' AND all_zh"
BODY = f"""
p AS (SELECT n, turn, row_number() OVER (PARTITION BY n ORDER BY turn) AS i, sid, text_zh, text_en, speaker_zh, speaker_en, start, CASE WHEN start IS NULL THEN '' ELSE ' · ' || {clock(START)} END AS clk FROM segs),
b AS (SELECT n, string_agg('<a id="' || sid || '"></a>' || chr(10) || '### ' || sid || ' · ' || {one_line(first("speaker_zh", "speaker_en", "'Paragraph ' || i"))} || clk || chr(10) || chr(10) || {md(first("text_zh", "text_en"))} || chr(10), chr(10) ORDER BY i) AS zh,
  string_agg('<a id="' || sid || '-en"></a>' || chr(10) || '### ' || sid || ' · ' || {one_line(first("speaker_en", "speaker_zh", "'Paragraph ' || i"))} || clk || chr(10) || chr(10) || {md("text_en")} || chr(10), chr(10) ORDER BY i) AS en,
  string_agg('### 第 ' || i || ' 段' || CASE WHEN {first("trim(speaker_zh)", "trim(speaker_en)")} = '' THEN '' ELSE ' · ' || {one_line(first("trim(speaker_zh)", "trim(speaker_en)"))} END || clk || chr(10) || chr(10) || {md("text_zh")} || chr(10), chr(10) ORDER BY i) AS own,
  bool_and(trim(text_zh) <> '') AS all_zh, CAST(sum(length(regexp_replace(text_zh, '\\s', '', 'g'))) AS BIGINT) AS size FROM p GROUP BY n)"""


@query(f"""
WITH {WITH}, {BODY}
SELECT id, concat_ws(chr(10), '# ' || {one_line(TITLE)}, '', '> ' || {one_line("title_en")}, '', '- **Record:** `' || {one_line("id")} || '`', '- **Snapshot:** ' || snapshot, '- **Date:** ' || day,
  '- **Type:** ' || {named("type", X.TYPES)} || ' (' || type || ')', '- **Organization:** ' || CASE WHEN org = '' THEN 'Not specified' ELSE org END, '- **Duration:** ' || CASE WHEN duration IS NULL THEN 'Not specified' ELSE {clock("CAST(greatest(0, duration) AS BIGINT)")} END,
  '- **Content:** ' || {named("kind", X.CONTENTS)} || ' (' || kind || ')', '- **Translation:** ' || {named("status", X.STATES)} || ' (' || status || ')', '- **Updated:** ' || {UPDATED}, '- **Page:** ' || {link(TITLE, PAGE)},
  '- **Source:** ' || {link(first("source_label", "source_url"), "source_url")}, CASE WHEN {web("transcript_source")} THEN '- **Transcript:** ' || {link("transcript_source", "transcript_source")} END,
  '', '## Summary', '', {md(SUMMARY)}, '', {md("summary_en")}, '') || chr(10) ||
  CASE WHEN kind = 'none' THEN 'No text is available.' || chr(10) ELSE '## Chinese' || chr(10) || chr(10) || zh || chr(10) || '## English' || chr(10) || chr(10) || en || chr(10) END AS markdown
FROM records JOIN b USING (n)""")
def record_markdown(spark, sf_dir):
    df = entries(spark, sf_dir)
    return df.select("id", X.record_markdown(df, SITE).alias("markdown"))


@query(f"""
WITH {WITH}, {BODY}
SELECT id, concat_ws(chr(10), '# ' || {one_line("title_zh")}, '- ' || day, '- ' || {named("type", X.TYPES)}, '- ' || size || ' 字, ' || greatest(1, CAST(ceil(size / 400.0) AS BIGINT)) || ' 分钟',
  CASE WHEN {web("transcript_source")} AND transcript_source <> source_url AND transcript_source <> archive_url THEN '- ' || {link("'文字记录来源'", "transcript_source")} END, '', {md("summary_zh")}, '', own) || chr(10) AS markdown
FROM records JOIN b USING (n) WHERE {TRANSLATED}""")
def transcript_markdown(spark, sf_dir):
    df = entries(spark, sf_dir)
    df = df.where(X.has_translation(F.col("segments"), F.col("kind")))
    return df.select("id", X.transcript_markdown(df, SITE).alias("markdown"))


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def key(name: str, x: str) -> str:
    """One key of an object, with a comma behind it, or nothing."""
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE '\"{name}\":' || {js(x)} || ',' END"


def obj(*keys: str) -> str:
    return "'{' || rtrim(" + " || ".join(keys) + ", ',') || '}'"


@query(f"""
WITH {WITH}, b AS (SELECT n, bool_and(trim(text_zh) <> '') AS all_zh FROM segs GROUP BY n)
SELECT id, '{{"id":' || {js("id")} || ',"type":' || {js("type")} || ',"day":' || {js("day")} || ',"title":' || {obj(key("zh", "title_zh"), key("en", "title_en"))} || ',"summary":' || {obj(key("zh", "summary_zh"), key("en", "summary_en"))} || ',' ||
  {key("org", "org")} || CASE WHEN duration >= 0 THEN '"duration":' || CAST(duration AS BIGINT) || ',' ELSE '' END || '"source":' || {obj(key("source_url", "source_url"), key("label", "source_label"))} || ',"translation":' || {obj(key("status", "status"), key("translatedAt", "translated_at"), key("reviewedAt", "reviewed_at"))} ||
  ',"links":' || {obj(key("html", PAGE), f"CASE WHEN {TRANSLATED} THEN {key('transcript', PAGE.replace('/records/', '/transcripts/'))} ELSE '' END")} || '}}' AS item
FROM records JOIN b USING (n)""")
def archive_items(spark, sf_dir):
    df = entries(spark, sf_dir)
    return df.select("id", X.archive_item(df, SITE).alias("item"))


@query(f"""
WITH {WITH} SELECT count(*) AS total, min(day) AS first_day, max(day) AS last_day, string_agg(DISTINCT snapshot, ',' ORDER BY snapshot) AS snapshots,
  (SELECT max(s) FROM (SELECT unnest([reviewed_at, translated_at, fetched_at]) AS s FROM records) WHERE s <> '') AS updated_at FROM records""")
def archive_header(spark, sf_dir):
    df = records(spark, sf_dir)
    stamps = F.array_max(F.filter(F.array("reviewed_at", "translated_at", "fetched_at"), lambda s: s != ""))
    return df.agg(F.count(F.lit(1)).alias("total"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.array_join(F.array_sort(F.collect_set("snapshot")), ",").alias("snapshots"), F.max(stamps).alias("updated_at"))


@query(rf"""
WITH {WITH} SELECT n, '<url><loc>' || {xml(PAGE, 9999)} || '</loc><video:video>' || chr(10) || '<video:thumbnail_loc>' || {xml("thumbnail_url", 9999)} || '</video:thumbnail_loc>' || chr(10) || '<video:title>' || {xml(TITLE, X.TITLE)} || '</video:title>' || chr(10) ||
  '<video:description>' || {xml(SUMMARY, X.DESCRIPTION)} || '</video:description>' || chr(10) || '<video:player_loc allow_embed="yes">' || {xml("embed_url", 9999)} || '</video:player_loc>' || chr(10) || '<video:publication_date>' || day || '</video:publication_date>' || chr(10) ||
  CASE WHEN duration BETWEEN 1 AND {X.LONGEST} THEN '<video:duration>' || CAST(duration AS BIGINT) || '</video:duration>' || chr(10) ELSE '' END || '</video:video></url>' AS entry
FROM records WHERE {web("thumbnail_url")} AND {web("embed_url")} AND try_cast(day AS DATE) IS NOT NULL AND trim({TITLE}) <> '' AND trim({SUMMARY}) <> ''""")
def video_sitemap(spark, sf_dir):
    return X.video_sitemap(records(spark, sf_dir), SITE)


@query(f"""
WITH {WITH}, b AS (SELECT n, bool_and(trim(text_zh) <> '') AS all_zh FROM segs GROUP BY n), r AS (SELECT *, {UPDATED} AS stamp FROM records JOIN b USING (n)),
l AS (SELECT {PAGE} AS loc, stamp FROM r UNION ALL SELECT '{SITE}/transcripts/' || slug || '/', stamp FROM r WHERE {TRANSLATED}
  UNION ALL SELECT '{SITE}/categories/' || type || '/', max(stamp) FROM r GROUP BY type UNION ALL SELECT '{SITE}/', max(stamp) FROM r UNION ALL SELECT '{SITE}/about/', NULL)
SELECT loc, max(stamp) AS lastmod FROM l GROUP BY loc""")
def site_sitemap(spark, sf_dir):
    """The pages of the site with the last change of what each shows: by a left join on the page's kind and key."""
    df = entries(spark, sf_dir)
    rows = df.select("slug", "type", X.updated(df).alias("stamp"), X.has_translation(F.col("segments"), F.col("kind")).alias("zh"))
    of = lambda kind, k, part: part.groupBy(F.lit(kind).alias("kind"), k.alias("k")).agg(F.max("stamp").alias("lastmod"))
    changes = of("records", F.col("slug"), rows).unionByName(of("transcripts", F.col("slug"), rows.where("zh"))).unionByName(of("categories", F.col("type"), rows)).unionByName(of("home", F.lit(""), rows))
    pages = changes.select("kind", "k").unionByName(spark.createDataFrame([("about", "")], "kind string, k string"))
    path = F.when(F.col("kind") == "home", "/").when(F.col("k") == "", F.concat(F.lit("/"), "kind", F.lit("/"))).otherwise(F.concat(F.lit("/"), "kind", F.lit("/"), "k", F.lit("/")))
    found = pages.join(changes, ["kind", "k"], "left").select(F.concat(F.lit(SITE), path).alias("loc"), "lastmod")
    return found.where(urls.in_sitemap(F.col("loc")))


CITED = f"""c AS (SELECT n, i, u, CASE WHEN u = archive_url THEN 'Archive' WHEN u = source_url THEN {first("source_label", "'Source'")} ELSE 'Transcript' END AS name, row_number() OVER (PARTITION BY n, u ORDER BY i) AS seen FROM (
  SELECT *, unnest([source_url, archive_url, transcript_source]) AS u, generate_subscripts([source_url, archive_url, transcript_source], 1) AS i FROM records) WHERE {web("u")})"""


@query(f"WITH {WITH}, {CITED} SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY i) AS INT) AS position, name, u AS url FROM c WHERE seen = 1")
def citations(spark, sf_dir):
    df = records(spark, sf_dir)
    rows = df.select("n", F.posexplode(X.citations(df)).alias("p", "c"))
    return rows.select("n", (F.col("p") + 1).alias("position"), "c.name", "c.url")


@query(f"""
WITH {WITH}, {CITED}, s AS (SELECT n, string_agg('{{"@type":"CreativeWork","name":' || {js("name")} || ',"url":' || {js("u")} || '}}', ',' ORDER BY i) AS l FROM c WHERE seen = 1 GROUP BY n), d AS (SELECT *, CAST(duration AS BIGINT) AS sec FROM records LEFT JOIN s USING (n))
SELECT n, replace(replace(replace('{{"@context":"https://schema.org","@type":"VideoObject","name":' || {js(TITLE)} || ',"description":' || {js(SUMMARY)} || ',"uploadDate":"' || day || '",' || {key("thumbnailUrl", "thumbnail_url")} ||
  CASE WHEN sec > 0 THEN '"duration":"PT' || CASE WHEN sec >= 3600 THEN (sec // 3600) || 'H' ELSE '' END || CASE WHEN sec // 60 % 60 > 0 THEN (sec // 60 % 60) || 'M' ELSE '' END || CASE WHEN sec % 60 > 0 THEN (sec % 60) || 'S' ELSE '' END || '",' ELSE '' END ||
  '"url":"' || {PAGE} || '","dateModified":"' || left({UPDATED}, 10) || '","citation":[' || coalesce(l, '') || ']}}', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS json FROM d""")
def json_ld_graph(spark, sf_dir):
    df = records(spark, sf_dir)
    return df.select("n", X.json_ld(df, SITE).alias("json"))


@query(f"""
WITH {WITH}, b AS (SELECT n, bool_and(trim(text_zh) <> '') AS all_zh, string_agg(text_en, ' ' ORDER BY turn) AS en, string_agg(text_zh, ' ' ORDER BY turn) AS zh FROM segs GROUP BY n),
u AS (SELECT 'records' AS collection, {PAGE} AS url, {TITLE} AS title, md5(en || ' ' || zh) AS body FROM records JOIN b USING (n) UNION ALL SELECT 'transcripts', replace({PAGE}, '/records/', '/transcripts/'), title_zh, md5(zh) FROM records JOIN b USING (n) WHERE {TRANSLATED}
  UNION ALL SELECT 'book', '{SITE}/book/', 'The book', md5('')),
r AS (SELECT *, row_number() OVER (PARTITION BY collection = 'transcripts' ORDER BY title, url, body) AS r FROM u)
SELECT CASE WHEN collection = 'transcripts' THEN 'transcripts' ELSE 'all' END AS scope, CAST((r - 1) // 20 + 1 AS BIGINT) AS page, CAST((r - 1) % 20 + 1 AS BIGINT) AS position, url, body FROM r WHERE r BETWEEN 21 AND 40""")
def search_pages(spark, sf_dir):
    """The second page of results in either scope: the transcripts alone, or all collections without them, since records hold their text.

    Pages are top-k by scope, so no scope is ordered whole."""
    df = entries(spark, sf_dir)
    texts = lambda c: F.array_join(F.transform("segments", lambda s: s[c]), " ")
    page = lambda folder: X.page_url(F.col("slug"), folder, SITE)
    rows = df.select(F.lit("records").alias("collection"), page("records").alias("url"), X.first_of(F.col("title_zh"), F.col("title_en")).alias("title"), F.md5(F.concat_ws(" ", texts("text_en"), texts("text_zh"))).alias("body"))
    own = df.where(X.has_translation(F.col("segments"), F.col("kind"))).select(F.lit("transcripts").alias("collection"), page("transcripts").alias("url"), F.col("title_zh").alias("title"), F.md5(texts("text_zh")).alias("body"))
    book = spark.createDataFrame([("book", f"{SITE}/book/", "The book")], "collection string, url string, title string").withColumn("body", F.md5(F.lit("")))
    out = None
    for scope, part in (("transcripts", own), ("all", rows.unionByName(book))):
        first = part.orderBy("title", "url", "body").limit(40)
        numbered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("title", "url", "body"))).alias("x")).select(F.lit(scope).alias("scope"), F.posexplode("x").alias("r", "x"))  # 40 rows
        shown = numbered.where("r >= 20").select("scope", (F.floor(F.col("r") / 20) + 1).alias("page"), (F.col("r") % 20 + 1).cast("long").alias("position"), "x.url", "x.body")
        out = shown if out is None else out.unionByName(shown)
    return out


@query(rf"""
WITH {WITH}, h AS (SELECT n, sid, turn, text_en AS t, strpos(lower(text_en), 'the') AS pos FROM segs)
SELECT n, turn, '#' || sid AS anchor, CASE WHEN pos > 31 THEN '…' ELSE '' END || substring(t, greatest(1, pos - 30), 120) || CASE WHEN greatest(1, pos - 30) + 120 <= length(t) THEN '…' ELSE '' END AS excerpt FROM (
  SELECT *, row_number() OVER (ORDER BY n, turn, sid) AS r FROM (SELECT *, row_number() OVER (PARTITION BY n, sid ORDER BY turn) AS seen FROM h WHERE pos > 0) WHERE seen = 1) WHERE r <= 50""")
def search_anchors(spark, sf_dir):
    """The first 50 distinct anchors, in order, of the segments that hold a term, with what stands around it."""
    hits = segments(spark, sf_dir).withColumn("at", F.instr(F.lower("text_en"), F.lit("the"))).where("at > 0")
    once = hits.groupBy("n", "sid").agg(F.min_by(F.struct("turn", "text_en", "at"), "turn").alias("h")).select("n", "sid", "h.*").orderBy("n", "turn", "sid").limit(50)
    begin = F.greatest(F.lit(1), F.col("at") - 30)
    excerpt = F.concat(F.when(F.col("at") > 31, "…").otherwise(""), F.substring(F.col("text_en"), begin, F.lit(120)), F.when(begin + 120 <= F.length("text_en"), "…").otherwise(""))
    return once.select("n", "turn", F.concat(F.lit("#"), "sid").alias("anchor"), excerpt.alias("excerpt"))


@query(f"""
WITH {WITH} SELECT slug, left({TITLE}, 60) || ' | Archive' AS title, {SUMMARY} AS description, {PAGE} AS canonical, CASE WHEN kind = 'none' THEN 'noindex' ELSE 'index' END AS robots,
  CASE WHEN {web("transcript_source")} AND transcript_source <> source_url AND transcript_source <> archive_url THEN transcript_source END AS transcript_link FROM records""")
def page_heads(spark, sf_dir):
    df = records(spark, sf_dir)
    title = F.concat(F.substring(X.first_of(F.col("title_zh"), F.col("title_en")), 1, 60), F.lit(" | Archive"))
    return df.select("slug", title.alias("title"), T.truncated(X.first_of(F.col("summary_zh"), F.col("summary_en"))).alias("description"), X.page_url(F.col("slug"), "records", SITE).alias("canonical"), F.when(F.col("kind") == "none", "noindex").otherwise("index").alias("robots"), X.transcript_link(df).alias("transcript_link"))


@query(f"WITH {WITH} SELECT DISTINCT u AS url FROM (SELECT unnest(['{SITE}/records/' || slug || '/', '{SITE}/categories/' || type || '/', source_url]) AS u FROM records) WHERE starts_with(u, '{SITE}/')")
def changed_urls(spark, sf_dir):
    """The distinct addresses to announce: those of this site only."""
    df = records(spark, sf_dir)
    found = df.select(F.explode(F.array(X.page_url(F.col("slug"), "records", SITE), X.page_url(F.col("type"), "categories", SITE), F.col("source_url"))).alias("url"))
    return found.where(F.startswith("url", F.lit(f"{SITE}/"))).distinct()


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), ' on[a-z]+="[^"]*"', '', 'g'), '<h1([ >])', '<h2\1', 'g'), '</h1>', '</h2>', 'g')) AS html,
  md5(coalesce(regexp_extract(html, '<h1>([^<：]*)', 1), '')) AS heading FROM pages""")
def book_html(spark, sf_dir):
    """Pages as parts of a book: no scripts, styles or event attributes, headings one level down, the heading up to its colon."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""), ' on[a-z]+="[^"]*"', "")
    down = F.regexp_replace(F.regexp_replace(bare, "<h1([ >])", "<h2$1"), "</h1>", "</h2>")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(down).alias("html"), F.md5(F.regexp_extract("html", "<h1>([^<：]*)", 1)).alias("heading"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
a AS (SELECT *, CASE WHEN length(line) > 0 AND length(line) < 60 THEN 'a' || i END AS own FROM l)
SELECT doc_id, i, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'top') AS anchor FROM a""")
def anchor_resolution(spark, sf_dir):
    """Each line's anchor: that of the nearest line before it that has one (short lines do), else the top. A fold inside the row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    from pyspark.sql import Window

    own = F.when(F.length("line").between(1, 59), F.concat(F.lit("a"), (F.col("p") + 1).cast("string")))
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("top")).alias("anchor"))
