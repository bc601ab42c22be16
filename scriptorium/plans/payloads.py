"""Queries of ingestion: payloads, captions, built and merged records, addresses of players, small text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import urls
from scriptorium.operators import build as B
from scriptorium.operators import ingest as I
from scriptorium.sources.entities import WITH, records, segments
from scriptorium.sources.tables import table

QUERIES, SQL = {}, {}
#: Entries of an index payload, odd ones among them; read by both engines.
ENTRY = {
    "id": "CASE WHEN n % 25 = 24 THEN 'bad id' WHEN n % 17 = 16 THEN 'c-' || CAST(n - 1 AS STRING) ELSE 'c-' || CAST(n AS STRING) END",
    "type": "type", "date": "CASE WHEN n % 23 = 5 THEN '24-1-1' ELSE day END", "title": "title_en",
    "url": "CASE WHEN n % 29 = 3 THEN 'archive.example' ELSE archive_url END", "source": "source_url", "durationSec": "duration",
}
GROUP = "CAST(floor(n / 50) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"""
WITH {WITH}, e AS (SELECT {GROUP} AS g, n, {", ".join(f"{x} AS {c}" for c, x in ENTRY.items())} FROM records),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS place, count(*) OVER (PARTITION BY g) AS size, count(*) OVER (PARTITION BY id) AS times FROM e)
SELECT CAST(place AS INT) AS place, id, type, date, title, url, CASE WHEN durationSec >= 0 THEN durationSec END AS duration,
  CASE WHEN g = 1 THEN 'total' WHEN NOT regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9._-]*$') THEN 'id' WHEN times > 1 THEN 'duplicate' WHEN type = 'other' THEN 'type' WHEN NOT regexp_matches(date, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN 'date'
    WHEN trim(title) = '' THEN 'title' WHEN NOT regexp_matches(url, '^https?://[^\s/?#]+') THEN 'url' WHEN NOT regexp_matches(source, '^https?://[^\s/?#]+') THEN 'source' END AS fault FROM f""")
def index_payload(spark, sf_dir):
    rows = records(spark, sf_dir).select(F.expr(GROUP).alias("g"), "n", *[F.expr(x).alias(c) for c, x in ENTRY.items()])
    grouped = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", *ENTRY))).alias("x"))  # 50 entries
    payload = F.to_json(F.struct((F.size("x") + F.when(F.col("g") == 1, 1).otherwise(0)).alias("total"), F.transform("x", lambda e: F.struct(*[e[c].alias(c) for c in ENTRY])).alias("entries")))
    return I.index_entries(grouped.select(payload.alias("p")), "p")


@query(r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
d AS (SELECT conv_id AS id, count(*) FILTER (trim(text) <> '') AS parts, md5(string_agg(trim(text), '|' ORDER BY turn) FILTER (trim(text) <> '')) AS body, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole FROM c GROUP BY conv_id),
e AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(whole, E' \n'), '\n\s*\n+'), lambda x: trim(x, E' \n')), lambda x: x <> '') AS ps FROM d)
SELECT id, CASE WHEN id % 5 = 3 THEN 'gone' END AS error, CASE id % 5 WHEN 0 THEN 'T' || id WHEN 1 THEN 'E' || id END AS title, CASE id % 5 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'article' WHEN 2 THEN 'article' ELSE 'failed' END AS kind,
  CASE WHEN id % 5 = 0 THEN parts WHEN id % 5 < 3 THEN len(ps) ELSE 0 END AS segments, md5(CASE WHEN id % 5 = 0 THEN body WHEN id % 5 < 3 THEN md5(array_to_string(ps, '|')) ELSE md5('') END) AS body FROM e""")
def transcript_payload(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    n = F.col("conv_id")
    whole = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    groups = F.transform("t", lambda x: F.struct(x["role"].alias("speaker"), F.when(x["turn"] % 2 == 0, F.array(F.struct(x["text"].alias("text"), (x["turn"] * 2.0).alias("t")))).alias("paras"), F.when(x["turn"] % 2 == 1, F.array(F.struct(x["text"].alias("content"), (x["turn"] * 2.0).alias("start")))).alias("paragraphs")))
    made = (
        F.when(n % 5 == 0, F.to_json(F.struct(F.concat(F.lit(" T"), n).alias("title"), groups.alias("dialogue"), F.lit("other").alias("text"))))
        .when(n % 5 == 1, F.to_json(F.struct(F.create_map(F.lit("en"), F.concat(F.lit("E"), n)).alias("titles"), whole.alias("text"))))
        .when(n % 5 == 2, F.to_json(F.struct(F.create_map(F.lit("en"), whole).alias("textByLang"))))
        .when(n % 5 == 3, F.lit('{"error":"gone"}'))
        .otherwise('{"text":')
    )
    found = I.transcript_parts(turns.select(n.alias("id"), made.alias("p")), "id", "p")
    failed = F.col("kind") == "failed"
    texts = F.coalesce(F.array_join(F.transform("segments", lambda s: s["text"]), "|"), F.lit(""))
    return found.select("id", "error", "title", "kind", F.when(failed, 0).otherwise(F.size("segments")).cast("long").alias("segments"), F.md5(F.md5(F.when(failed, "").otherwise(texts))).alias("body"))


@query("""
SELECT user_id, round(event_id * 1502 / 1000.0, 2) AS start, trim(event_type || ' ' || CASE WHEN event_id % 2 = 0 THEN 'even' ELSE '' END) AS text FROM events WHERE event_id % 7 <> 3 AND event_id % 11 <> 5 AND event_id % 13 <> 6""")
def caption_cues(spark, sf_dir):
    n = F.col("event_id")
    words = F.array(F.struct(F.when(n % 13 == 6, "​").otherwise(F.concat(F.lit("​ "), "event_type")).alias("utf8")), F.struct(F.lit(" \n ").alias("utf8")), F.struct(F.when((n % 2 == 0) & (n % 13 != 6), "even").alias("utf8")))
    event = F.struct(F.when(n % 7 != 3, n * 1502.0).alias("tStartMs"), F.when(n % 11 != 5, words).alias("segs"))
    files = table(spark, sf_dir, "events").select("user_id", F.to_json(F.struct(F.array(event).alias("events"))).alias("p"))
    return I.cues(files, "user_id", "p").select("user_id", "start", "text")


@query(rf"""
WITH {WITH}, f AS (SELECT CASE WHEN n % 4 = 3 THEN 'none' || n ELSE 'abc' || lpad(CAST(n - n % 2 AS VARCHAR), 6, '0') END AS player, n AS o FROM records), r AS (SELECT id, 'abc' || lpad(CAST(n AS VARCHAR), 6, '0') AS player FROM records WHERE n % 9 NOT IN (2, 4))
SELECT player, id FROM (SELECT player, max(o) AS o FROM f GROUP BY player) LEFT JOIN r USING (player)""")
def caption_match(spark, sf_dir):
    rows = records(spark, sf_dir)
    n = F.col("n")
    files = rows.select(F.when(n % 4 == 3, F.concat(F.lit("none"), n)).otherwise(F.concat(F.lit("abc"), F.lpad((n - n % 2).cast("string"), 6, "0"))).alias("player"), n.alias("o"))
    return I.caption_matches(files, rows.select("id", urls.player_id(F.col("source_url")).alias("player")).where("player is not null"), "o")


@query("""
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN nullif(d.text, '') END, CASE WHEN l.quality = 1 THEN 'detail ' || d.doc_id END, b.text) AS text, coalesce(nullif(d.source, ''), 'detail', 'extra') AS source,
  CASE WHEN d.doc_id % 3 = 0 AND d.text <> '' THEN 'transcript' WHEN l.quality = 1 THEN 'detail' WHEN b.text <> '' THEN 'supplement' ELSE 'none' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def built_records(spark, sf_dir):
    docs, labels, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    new = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), "source")
    detail = labels.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("detail "), F.col("doc_id").cast("string"))).otherwise("").alias("text"), F.lit("detail").alias("source"))
    return I.built(new, detail, items.select(F.col("item_id").alias("doc_id"), "text", F.lit("extra").alias("source")), "doc_id", ["text", "source"])


@query(f"""
WITH {WITH}, o AS (SELECT id, '2020-01-01' AS snapshot, CASE WHEN n % 3 = 0 THEN title_en || ' old' ELSE title_en END AS title_en, CASE WHEN n % 5 = 1 THEN '' ELSE summary_en END AS summary_en, title_zh, summary_zh, status FROM records WHERE n % 11 <> 0)
SELECT r.id, coalesce(o.snapshot, r.snapshot) AS snapshot, CASE WHEN r.title_en = o.title_en THEN o.title_zh ELSE '' END AS title_zh, CASE WHEN r.summary_en = o.summary_en THEN o.summary_zh ELSE '' END AS summary_zh,
  CASE WHEN r.title_en = o.title_en AND r.summary_en = o.summary_en THEN o.status ELSE 'pending' END AS status, CASE WHEN o.id IS NOT NULL THEN 'm1' END AS model FROM records r LEFT JOIN o USING (id)""")
def merged_records(spark, sf_dir):
    rows, n = records(spark, sf_dir), F.col("n")
    old = rows.where(n % 11 != 0).withColumns({"snapshot": F.lit("2020-01-01"), "title_en": F.when(n % 3 == 0, F.concat("title_en", F.lit(" old"))).otherwise(F.col("title_en")), "summary_en": F.when(n % 5 == 1, "").otherwise(F.col("summary_en")), "model": F.lit("m1")})
    return I.merged_records(rows, old, "id")


@query(rf"""
WITH {WITH}, p AS (SELECT *, CASE WHEN n % 9 IN (2, 4) THEN NULL ELSE 'abc' || lpad(CAST(n AS VARCHAR), 6, '0') END AS player FROM records)
SELECT id, kind = 'none' OR n % 16 = 3 OR summary_zh = '' OR (embed_url IS NULL AND player IS NULL) AS page_needed,
  n % 2 = 0 AND n % 8 <> 2 AND kind = 'none' AND n % 7 <> 5 AND player IS NOT NULL AS captions_stay FROM p""")
def record_flags(spark, sf_dir):
    n = F.col("n")
    rows = records(spark, sf_dir).select("id", "kind", F.when(n % 16 == 3, 0).otherwise(4).alias("parts"), F.col("summary_zh").alias("summary"), F.col("embed_url").alias("embed"), F.col("source_url").alias("source"), n)
    player = urls.player_id(F.col("source"))
    rows = rows.withColumns({"player": player, "old_player": player, "old_id": F.when(n % 7 == 5, "x").otherwise(F.col("id")), "old_origin": F.when(n % 2 == 0, "captions").otherwise("text"), "old_parts": F.when(n % 8 == 2, 0).otherwise(3)})
    return rows.select("id", I.needs_page(rows).alias("page_needed"), I.reuses_captions(rows).alias("captions_stay"))


@query(rf"""
WITH {WITH}, p AS (SELECT id, n, thumbnail_url, CASE WHEN n % 9 IN (2, 4) THEN NULL ELSE 'abc' || lpad(CAST(n AS VARCHAR), 6, '0') END AS player, regexp_extract(embed_url, '/embed/(.*)$', 1) AS embedded FROM records)
SELECT id, player, nullif(embedded, '') AS embedded, 'https://www.youtube-nocookie.com/embed/' || nullif(embedded, '') || '?enablejsapi=1&rel=0' AS embed, coalesce(thumbnail_url, 'https://i.ytimg.com/vi/' || player || '/hqdefault.jpg') AS thumbnail FROM p""")
def shown_players(spark, sf_dir):
    rows = records(spark, sf_dir)
    player, embedded = I.shown_player(F.col("source_url")), I.shown_player(F.col("embed_url"))
    return rows.select("id", player.alias("player"), embedded.alias("embedded"), I.embed_address(embedded).alias("embed"), I.thumbnail(F.col("thumbnail_url"), player).alias("thumbnail"))


@query(rf"""
WITH {WITH} SELECT id, CASE WHEN try_cast(day AS DATE) IS NULL THEN day ELSE CAST(year(CAST(day AS DATE)) AS VARCHAR) || '年' || month(CAST(day AS DATE)) || '月' || day(CAST(day AS DATE)) || '日' END AS shown, nullif(trim(title_en), '') AS title, replace(replace(replace(replace(replace(replace(replace(title_en, ' ', '%20'), '[', '%5B'), ']', '%5D'), '<', '%3C'), '>', '%3E'), '&', '%26'), '*', '*') AS encoded,
  try_cast(CASE n % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE '-3' END AS DOUBLE) AS number, regexp_replace(slug || '/' || org, '[^A-Za-z0-9._-]', '_', 'g') || '.json' AS file, '{{"a":"' || id || '"}}' AS fenced, 'Talk "' || n || '"' || chr(10) AS field,
  CAST(length('{{"id":"' || id || '","title_en":"' || title_en || '"}}') AS INT) AS size, n % 2 = 0 AS kept FROM records""")
def text_forms(spark, sf_dir):
    n = F.col("n")
    number = F.element_at(F.array(F.lit("12.5"), F.lit("x"), F.lit(None).cast("string"), F.lit("-3")), (n % 4 + 1).cast("int"))
    fenced = F.concat(F.lit('```json\n{"a":"'), "id", F.lit('"}\n```'))
    script = F.concat(F.lit('x,{"title": "Talk \\"'), n.cast("string"), F.lit('\\"\\n","b":1}'))
    return records(spark, sf_dir).select(
        "id", I.date_zh(F.col("day")).alias("shown"), I.non_empty(F.col("title_en")).alias("title"), I.encoded(F.col("title_en")).alias("encoded"), I.finite(number).alias("number"), I.file_name(F.concat_ws("/", "slug", "org")).alias("file"),
        I.unfenced(fenced).alias("fenced"), I.string_field(script, "title").alias("field"), I.unit_size("id", "title_en").alias("size"), I.keeps_name(F.when(n % 2 == 0, "Jane O'Neil").otherwise("jane doe"), F.lit("JANE ONEIL")).alias("kept"),
    )


@query("""
WITH p AS (SELECT 'd-' || doc_id AS id, source, string_split(text, chr(10)) AS ps FROM documents), r AS (SELECT id, source, len(ps) AS n, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM p)
SELECT CASE WHEN n > 1 THEN id || '::part:' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INT), '0') ELSE id END AS id, CASE WHEN n > 1 THEN id END AS parent, md5(text) AS text, CASE WHEN i = 1 THEN source ELSE '' END AS speaker FROM r""")
def part_rows(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("id"), "source", F.split("text", "\n").alias("parts"))
    return I.part_rows(units, ["id"], "parts", "source").withColumn("text", F.md5("text"))


@query(f"""
WITH {WITH}, c AS (SELECT n, p, turn, CASE WHEN (n + p) % 3 = 0 OR turn > 0 THEN text_en ELSE text_en || '!' END AS text FROM segs, (VALUES (1), (2), (3), (4)) v(p) WHERE NOT (n % 7 = 1 AND turn = 1)),
m AS (SELECT c.n, c.p, count(*) AS m, bool_and(coalesce(c.text = s.text_en, false)) AS ok FROM c LEFT JOIN segs s ON s.n = c.n AND s.turn = c.turn GROUP BY c.n, c.p), g AS (SELECT n, count(*) AS k FROM segs GROUP BY n)
SELECT g.n, min(CASE WHEN ok AND m = k THEN p END) AS priority FROM g LEFT JOIN m USING (n) GROUP BY g.n""")
def part_alignment(spark, sf_dir):
    parts = segments(spark, sf_dir).select("n", F.col("turn").alias("part"), F.col("text_en").alias("text"))
    tried = parts.where("not (n % 7 = 1 and part = 1)").withColumn("priority", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3, 4)])))
    tried = tried.withColumn("text", F.when(((F.col("n") + F.col("priority")) % 3 == 0) | (F.col("part") > 0), F.col("text")).otherwise(F.concat("text", F.lit("!"))))
    return I.first_alignment(parts, tried, "n")


@query(f"""
WITH {WITH}, r AS (SELECT id, n, n % 2 = 0 AS existing, source_missing FROM records WHERE n % 2 = 1 OR source_missing)
SELECT id, CAST(row_number() OVER (ORDER BY n) AS INT) AS place FROM r QUALIFY row_number() OVER (ORDER BY n) <= 12""")
def resumed_limit(spark, sf_dir):
    """What a resumed run fetches: new records and those marked missing, the first twelve in source order."""
    todo = records(spark, sf_dir).withColumn("existing", F.col("n") % 2 == 0).where("not existing or source_missing")
    return I.in_source_order(todo, [F.col("n").asc()], 12).select("id", "place")


@query("SELECT DISTINCT loc AS id FROM (SELECT 'https://archive.example/' || page_id AS loc FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'https://archive.example/' || page_id FROM pages WHERE page_id % 3 = 0)")
def manifest_ids(spark, sf_dir):
    """Ids of a manifest and locations of sitemaps, as one distinct set."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://archive.example/"), F.col("page_id").cast("string")).alias("loc"))
    listed = I.manifest(rows.where("page_id % 2 = 0").select(F.to_json(F.array("loc", F.lit(None).cast("string"))).alias("p")), "p")
    mapped = I.sitemap_locations(rows.where("page_id % 3 = 0").select(F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc></url><url><loc>"), "loc", F.lit("</loc></url>")).alias("t")), "t")
    return listed.unionByName(mapped.withColumnRenamed("loc", "id")).distinct()


#: Index payloads of a record's turns, in twelve shapes.
_ENTRY = """'{"id":"' || lower(role) || '-' || turn || '","type":"speech","date":"2024-01-0' || (1 + turn % 9) || '","title":"T","url":"https://a.example/' || turn || '","source":"https://b.example/"}'"""
INDEXES = """CASE n % 12 WHEN 0 THEN 'no json' WHEN 1 THEN '[]' WHEN 2 THEN '[' || es || ']' WHEN 3 THEN '{}' WHEN 4 THEN '{"entries":"x"}' WHEN 5 THEN '' WHEN 6 THEN '{"total":99,"entries":[' || es || ']}' WHEN 7 THEN '{"total":"2","entries":[' || es || ']}'
WHEN 8 THEN '{"entries":[' || es || ',' || es || ']}' WHEN 9 THEN NULL WHEN 10 THEN '{"entries":[null,{"id":"A b"},{"id":"a","type":"x"},{"id":"b","type":"speech","date":"soon"},{"id":"c","type":"speech","date":"2024-01-01","title":" ","url":"https://a.example","source":"https://b.example"},{"id":"d","type":"speech","date":"2024-01-01","title":"t","url":"ftp://a","source":"https://b.example"}]}'
ELSE '{"total":' || c || ',"entries":[' || es || ']}' END"""


@query(f"""
WITH p AS (SELECT conv_id AS n, count(*) AS c FROM conversations GROUP BY conv_id), e AS (SELECT conv_id AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, lower(role) || '-' || turn AS id FROM conversations)
SELECT n, CAST(NULL AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS id, CASE WHEN n % 12 IN (0, 1, 2, 5, 9) THEN 'unreadable' WHEN n % 12 IN (3, 4) THEN 'no entries' WHEN n % 12 = 6 THEN 'total' ELSE 'too few' END AS fault
  FROM p WHERE n % 12 IN (0, 1, 2, 3, 4, 5, 6, 9) OR n % 12 IN (7, 11) AND c < 3 OR n % 12 = 8 AND 2 * c < 3
UNION ALL SELECT n, CAST(place AS INTEGER), id, NULL FROM e WHERE n % 12 IN (6, 7, 8, 11)
UNION ALL SELECT e.n, CAST(e.place + p.c AS INTEGER), id, 'duplicate' FROM e JOIN p USING (n) WHERE n % 12 = 8
UNION ALL SELECT n, CAST(v.place AS INTEGER), v.id, v.fault FROM p, (VALUES (0, NULL, 'not an object'), (1, 'A b', 'id'), (2, 'a', 'type'), (3, 'b', 'date'), (4, 'c', 'address or title'), (5, 'd', 'address or title')) v(place, id, fault) WHERE n % 12 = 10""")
def index_faults(spark, sf_dir):
    """Index payloads of every shape: the entries of the good ones, and what is wrong with the others."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "turn", F.expr(_ENTRY).alias("e"))
    rows = turns.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.array_sort(F.collect_list(F.struct("turn", "e"))).alias("x")).select("n", "c", F.array_join("x.e", ",").alias("es"))
    return I.index_report(rows.select("n", F.expr(INDEXES).alias("body")), "n", "body", 3)


#: A conversation as a record: what was fetched now, and the snapshot before, in which turns, speakers, titles and days differ by turns.
_NOW = "CASE WHEN n % 5 = 1 THEN 'none' WHEN n % 3 = 0 THEN 'article' ELSE 'dialogue' END"
_DAY, _OLD_TITLE, _OLD_TEXT, _OLD_ROLE = "CASE WHEN n % 7 = 2 THEN '2024-02-02' ELSE '2024-01-01' END", "CASE WHEN n % 4 = 1 THEN 'Old ' ELSE 'Talk ' END || CAST(n AS STRING)", "CASE WHEN (n + turn) % 6 = 5 THEN upper(text) ELSE text END", "CASE WHEN (n + turn) % 9 = 4 THEN 'other' ELSE role END"


@query(f"""
WITH c AS (SELECT conv_id AS n, turn, role, text FROM conversations),
now AS (SELECT n, turn, 's' || turn AS sid, role, text FROM c WHERE NOT (n % 5 = 1) AND NOT (n % 11 = 3 AND turn = 0)), old AS (SELECT n, turn, 's' || turn AS sid, {_OLD_ROLE} AS role, {_OLD_TEXT} AS text, '译' || turn AS zh FROM c WHERE n % 8 <> 7),
ids AS (SELECT DISTINCT n FROM c), r AS (SELECT n, n % 10 <> 9 AS listed, n % 8 <> 7 AS known, n % 30 = 19 AS marked, {_NOW} AS kind, {_DAY} AS day, {_OLD_TITLE} AS old_title, 'Talk ' || n AS title FROM ids),
m AS (SELECT coalesce(a.n, b.n) AS n, bool_and(a.sid IS NOT NULL AND b.sid IS NOT NULL AND a.role = b.role AND a.text = b.text) AS same, count(a.sid) AS segments, count(*) FILTER (a.sid IS NOT NULL AND b.sid IS NOT NULL AND a.role = b.role AND a.text = b.text) AS kept FROM now a FULL JOIN old b ON a.n = b.n AND a.sid = b.sid GROUP BY ALL),
x AS (SELECT r.*, coalesce(m.same, true) AS same, coalesce(m.segments, 0) AS segments, coalesce(m.kept, 0) AS kept, (SELECT count(*) FROM old o WHERE o.n = r.n) AS before FROM r LEFT JOIN m USING (n)),
y AS (SELECT *, CASE WHEN NOT listed AND NOT known THEN NULL WHEN NOT listed AND marked THEN 'gone' WHEN NOT listed THEN 'missing' WHEN known AND same AND title = old_title AND day = '2024-01-01' AND kind = 'dialogue' AND NOT marked THEN 'unchanged' ELSE 'written' END AS outcome FROM x)
SELECT 'r-' || n AS id, outcome, CASE WHEN outcome = 'written' THEN CASE WHEN known AND same AND title = old_title THEN 'reviewed' ELSE 'pending' END ELSE 'reviewed' END AS status,
  CASE WHEN outcome = 'written' THEN CASE WHEN known AND title = old_title THEN '题' ELSE '' END ELSE '题' END AS title_zh, CASE WHEN outcome = 'written' AND NOT known THEN 's2' ELSE 's1' END AS snapshot,
  CAST(CASE WHEN outcome = 'written' THEN segments ELSE before END AS INTEGER) AS segments, CAST(CASE WHEN outcome = 'written' THEN kept ELSE before END AS INTEGER) AS kept, outcome IN ('missing', 'gone') AS source_missing FROM y WHERE outcome IS NOT NULL""")
def built_records(spark, sf_dir):
    """Records built from what was fetched and merged into the snapshot before, with segments, states and outcomes."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "turn", "role", "text")
    gather = lambda df, fields: df.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", *[e.alias(k) for k, e in fields.items()]))), lambda s: F.struct(*[s[k].alias(k) for k in fields])).alias("segments"))
    sid, start = F.concat(F.lit("s"), "turn"), (F.col("turn") * 10).cast("double")
    ids = c.select("n").distinct()
    now = gather(c.where("not (n % 11 = 3 and turn = 0)"), {"sid": sid, "speaker_en": F.col("role"), "start": start, "text_en": F.col("text")})
    name, day = F.concat(F.lit("r-"), "n").alias("id"), F.expr(_DAY)
    title = F.concat(F.lit("Talk "), "n")
    index = ids.where("n % 10 <> 9").select(name, F.lit("speech").alias("type"), day.alias("day"), F.lit("unused").alias("title"), F.concat(F.lit("https://x.example/"), "n").alias("source_url"))
    parts = ids.join(now, "n", "left").select(name, title.alias("title"), F.lit("About").alias("summary"), F.lit(None).cast("string").alias("embed_url"), F.expr(_NOW).alias("kind"), "segments", F.lit(None).cast("string").alias("transcript_source"), "n")
    transcripts, details = parts.where("n % 2 = 0").drop("n"), parts.where("n % 2 = 1").drop("n")
    old = gather(c.where("n % 8 <> 7"), {"sid": sid, "speaker_en": F.expr(_OLD_ROLE), "start": start, "text_en": F.expr(_OLD_TEXT), "text_zh": F.concat(F.lit("译"), "turn"), "speaker_zh": F.lit("人")})
    # The snapshot before was itself built, from the older texts, so that its hashes are those of a build.
    empty = spark.createDataFrame([], B.RECORD)
    older = old.select(name, F.expr(_OLD_TITLE).alias("title"), F.lit("About").alias("summary"), F.lit(None).cast("string").alias("embed_url"), F.lit("dialogue").alias("kind"), F.expr("transform(segments, s -> struct(s.sid as sid, s.speaker_en as speaker_en, s.start as start, s.text_en as text_en))").alias("segments"), F.lit(None).cast("string").alias("transcript_source"))
    listed = ids.where("n % 8 <> 7").select(name, F.lit("speech").alias("type"), F.lit("2024-01-01").alias("day"), F.lit("unused").alias("title"), F.concat(F.lit("https://x.example/"), "n").alias("source_url"))
    first = B.build(listed, older, older.limit(0), empty, "s1", "then").drop("outcome", "segments", "title_zh", "summary_zh", "status", "source_missing")
    before = first.join(old.select(name, "segments", (F.col("n") % 30 == 19).alias("source_missing")), "id").withColumns({"title_zh": F.lit("题"), "summary_zh": F.lit("要"), "status": F.lit("reviewed")}).select(*B.COLUMNS)
    out = B.build(index, transcripts, details, before, "s2", "now")
    kept = F.size(F.filter("segments", lambda s: s["text_zh"] != ""))
    return out.select("id", "outcome", "status", "title_zh", "snapshot", F.size("segments").alias("segments"), kept.alias("kept"), "source_missing")
