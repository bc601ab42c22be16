"""Queries of published listings and structured data, runs over records, and what comes back into records."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from scriptorium.operators import build as B
from scriptorium.operators import exports as X
from scriptorium.operators import site as S
from scriptorium.operators import translate as R
from scriptorium.plans.archive import PAGE, SITE, TITLE, UPDATED, link, one_line, web
from scriptorium.sources.entities import WITH, entries, records
from scriptorium.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def field(path: str):
    return F.get_json_object("json", path)


@query(f"""
WITH {WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n) AS p, count(*) OVER (PARTITION BY type) AS total, max(greatest(nullif(reviewed_at, ''), nullif(translated_at, ''), nullif(fetched_at, ''))) OVER (PARTITION BY type) AS last, {TITLE} AS title FROM records)
SELECT type, CAST((p - 1) // 24 + 1 AS BIGINT) AS page, CAST(max(total) AS BIGINT) AS total, max(last) AS modified, CAST(count(*) AS BIGINT) AS items, min_by('{SITE}/records/' || slug || '/', p) AS first_url, min_by(title, p) AS first_name, CAST(max(p) AS BIGINT) AS last_position FROM r GROUP BY type, page""")
def collection_pages(spark, sf_dir):
    """Structured data of every page of every listing, read back from its JSON."""
    rows = S.collection_json_ld(records(spark, sf_dir), "type", "n", SITE)
    items = F.from_json(field("$['@graph'][1].itemListElement"), "array<struct<position:bigint,url:string,name:string>>")
    return rows.select("type", F.col("page").cast("long").alias("page"), field("$['@graph'][1].numberOfItems").cast("long").alias("total"), field("$['@graph'][0].dateModified").alias("modified"), items.alias("i")).select(
        "type", "page", "total", "modified", F.size("i").cast("long").alias("items"), F.get("i.url", 0).alias("first_url"), F.get("i.name", 0).alias("first_name"), F.array_max("i.position").alias("last_position")
    )


VIDEO = f"({web('embed_url')} AND {web('thumbnail_url')})"


@query(f"""
WITH {WITH} SELECT n, CASE WHEN {VIDEO} THEN 'VideoObject' ELSE 'Article' END AS medium, {TITLE} AS title, {PAGE} AS url, {UPDATED} AS modified, CASE WHEN {VIDEO} THEN embed_url END AS player, CASE WHEN {web('thumbnail_url')} THEN thumbnail_url END AS picture, CASE WHEN NOT {VIDEO} THEN {TITLE} END AS headline FROM records""")
def detail_graphs(spark, sf_dir):
    """Structured data of every record's page, read back from its JSON."""
    rows = S.detail_json_ld(records(spark, sf_dir), SITE)
    own = "$['@graph'][2]"
    return rows.select(
        "n", field(f"{own}['@type']").alias("medium"), field("$['@graph'][1].name").alias("title"), field("$['@graph'][0].itemListElement[1].item").alias("url"), field("$['@graph'][1].dateModified").alias("modified"), field(f"{own}.embedUrl").alias("player"),
        field("$['@graph'][1].primaryImageOfPage.url").alias("picture"), field(f"{own}.headline").alias("headline"),
    )


_KIND = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TYPES.items()) + " ELSE type END"


@query(f"""
WITH {WITH}, b AS (SELECT n, bool_and(trim(text_zh) <> '') AS all_zh FROM segs GROUP BY n), r AS (SELECT * FROM records JOIN b USING (n)), t AS (SELECT * FROM r WHERE all_zh AND kind <> 'none')
SELECT 0 AS section, CAST(1 AS BIGINT) AS position, '# Archive' AS line UNION ALL SELECT 1, 0, '## 分类档案'
UNION ALL SELECT 1, CAST(i AS BIGINT), '- ' || {link("k || '档案'", f"'{SITE}/categories/' || v.type || '/'")} FROM (VALUES {", ".join(f"({i + 1}, '{k}', '{v}')" for i, (k, v) in enumerate(X.TYPES.items()))}) v(i, type, k) WHERE v.type IN (SELECT type FROM r)
UNION ALL SELECT 2, 0, '## 全部档案（' || count(*) || ' 条）' FROM r UNION ALL SELECT 3, 0, '## 中文文字稿（' || count(*) || ' 篇）' FROM t
UNION ALL SELECT 2, row_number() OVER (ORDER BY n), '- ' || {link(TITLE, f"'{SITE}/records/' || slug || '.md'")} || ': ' || day || ' · ' || {_KIND} || CASE WHEN org <> '' THEN ' · ' || {one_line('org')} ELSE '' END || ' · ' || {link("'网页版'", PAGE)} || ' · English: ' || {one_line('title_en')} FROM r
UNION ALL SELECT 3, row_number() OVER (ORDER BY n), '- ' || {link('title_zh', f"'{SITE}/transcripts/' || slug || '.md'")} || ': ' || day || ' · ' || {_KIND} FROM t""")
def listing_sections(spark, sf_dir):
    """The lines of a text listing of the whole archive, in all its sections."""
    return S.listing_lines(entries(spark, sf_dir), "n", SITE, ["# Archive"])


@query(f"""
WITH {WITH}, u AS (SELECT n, 'meta:title' AS unit, title_en AS text, 0 AS p FROM records UNION ALL SELECT n, 'meta:summary', summary_en, 1 FROM records UNION ALL SELECT n, 'segment:' || sid, text_en, 2 + turn FROM segs)
SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY p) AS BIGINT) AS place, unit, md5(text) AS text FROM u WHERE trim(text) <> ''""")
def translation_units(spark, sf_dir):
    """Every record's units: title, summary and segments that have a text."""
    rows = S.units_of(entries(spark, sf_dir), "n")
    return rows.select("n", (F.col("place") + 1).cast("long").alias("place"), "unit", F.md5("text").alias("text"))


@query("""
WITH p AS (SELECT conv_id AS n, turn, CASE WHEN turn % 3 = 2 AND conv_id % 4 = 1 THEN '' ELSE trim(text) END AS zh, CASE WHEN turn % 2 = 1 THEN role ELSE '' END AS sp FROM conversations)
SELECT n, CASE WHEN n % 5 = 4 THEN 'own' WHEN bool_and(zh <> '') THEN md5(string_agg(zh, '' ORDER BY turn)) ELSE 'own' END AS text_zh, CASE WHEN n % 5 <> 4 AND bool_and(zh <> '') THEN coalesce(min_by(sp, turn) FILTER (sp <> ''), 'O') ELSE 'O' END AS speaker_zh FROM p GROUP BY n""")
def parts_applied(spark, sf_dir):
    """Base units with the texts of their parts, where all of them have one."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("u"), "conv_id")
    base = c.select(F.col("conv_id").alias("n"), name.alias("unit")).distinct().select("n", "unit", F.lit("own").alias("text_zh"), F.lit("O").alias("speaker_zh"))
    zh = F.when((F.col("turn") % 3 == 2) & (F.col("conv_id") % 4 == 1), " ").otherwise(F.concat(F.lit(" "), "text"))
    parts = c.where("conv_id % 5 <> 4").select(F.col("conv_id").alias("n"), F.concat(name, F.lit("::part:"), "turn").alias("id"), name.alias("parent"), F.col("turn").cast("int").alias("part"), zh.alias("text_zh"), F.when(F.col("turn") % 2 == 1, F.col("role")).otherwise("").alias("speaker_zh"))
    out = S.applied_parts(base, parts, ["n"])
    return out.select("n", F.when(F.col("text_zh") == "own", "own").otherwise(F.md5("text_zh")).alias("text_zh"), "speaker_zh")


@query("""
WITH o AS (SELECT b, l, count(*) OVER (PARTITION BY b) AS c FROM (SELECT DISTINCT l_orderkey AS b, l_linenumber AS l FROM lineitem)), x AS (SELECT *, CASE WHEN c = 1 THEN 'alone' WHEN (b + l) % 7 = 1 THEN 'omitted' WHEN (b + l) % 7 = 2 THEN 'duplicate' WHEN (b + l) % 7 = 3 THEN 'empty' WHEN (b + l) % 7 = 4 THEN 'no speaker' WHEN (b + l) % 7 = 5 THEN 'numbers' ELSE 'good' END AS fate FROM o),
y AS (SELECT *, count(*) FILTER (fate <> 'omitted') OVER (PARTITION BY b) AS came FROM x)
SELECT b, 'u' || l AS id, CASE WHEN fate IN ('good', 'alone') THEN NULL ELSE fate END AS fault FROM y UNION ALL SELECT b, 'extra', 'unexpected' FROM (SELECT DISTINCT b FROM o WHERE c > 1 AND b % 3 = 0)""")
def returned_units(spark, sf_dir):
    """What came back for batches of units: lines of orders, with every fault that a batch can have."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_linenumber").alias("l")).distinct()
    rows = rows.join(rows.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "b").withColumn("id", F.concat(F.lit("u"), "l"))
    fate = F.when(F.col("c") == 1, -1).otherwise((F.col("b") + F.col("l")) % 7)
    rows = rows.withColumn("fate", fate)
    asked = rows.select("b", "id", F.concat(F.lit("costs "), "l").alias("text"), F.lit("Ann").alias("speaker"))
    came = rows.where("fate <> 1").select("b", F.when(F.col("fate") == -1, "misnamed").otherwise(F.col("id")).alias("id"), F.when(F.col("fate") == 3, " ").when(F.col("fate") == 5, F.concat(F.lit("价"), F.col("l") + 10)).otherwise(F.concat(F.lit("价"), "l")).alias("text_zh"), F.when(F.col("fate") == 4, "").otherwise("安").alias("speaker_zh"))
    again = came.join(rows.where("fate = 2").select("b", "id"), ["b", "id"], "left_semi")
    extra = rows.where("c > 1 and b % 3 = 0").select("b").distinct().select("b", F.lit("extra").alias("id"), F.lit("多").alias("text_zh"), F.lit("安").alias("speaker_zh"))
    return S.returned(asked, came.unionByName(again).unionByName(extra), "b").select("b", "id", "fault")


@query("""
WITH c AS (SELECT conv_id AS n, count(*) AS lines, count(*) FILTER (NOT (conv_id % 6 = 5)) AS said FROM conversations GROUP BY conv_id)
SELECT CASE WHEN n % 7 = 3 THEN 'no record for player' || lpad(CAST(n AS VARCHAR), 6, '0') WHEN n % 6 = 5 THEN 'no text for player' || lpad(CAST(n AS VARCHAR), 6, '0') END AS fault, CASE WHEN n % 7 <> 3 AND n % 6 <> 5 THEN 'r-' || n END AS id,
  CASE WHEN n % 7 <> 3 AND n % 6 <> 5 THEN 'pending' END AS status, CASE WHEN n % 7 <> 3 AND n % 6 <> 5 THEN CAST(lines AS INTEGER) END AS segments, CASE WHEN n % 7 <> 3 AND n % 6 <> 5 THEN true END AS hashed FROM c""")
def captions_applied(spark, sf_dir):
    """Captions that replace the text of the record of their player, and those that can't."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "turn", "text")
    player = F.concat(F.lit("player"), F.lpad(F.col("n").cast("string"), 6, "0"))
    index = c.where("n % 7 <> 3").select("n").distinct().select(F.concat(F.lit("r-"), "n").alias("id"), F.lit("speech").alias("type"), F.lit("2024-01-01").alias("day"), F.lit("T").alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), player).alias("source_url"))
    empty = lambda s: spark.createDataFrame([], s)
    old = B.build(index, empty(B.FETCHED), empty(B.FETCHED), empty(B.RECORD), "s1", "now").drop("outcome")
    said = c.select(player.alias("player"), (F.col("turn") + 1).cast("int").alias("place"), F.col("turn").cast("double").alias("start"), F.when(F.col("n") % 6 == 5, " ").otherwise(F.concat(F.lit("x"), "text")).alias("text"))
    out = S.with_captions(old, said).join(old.select("id", F.col("hash").alias("_before")), "id", "left")
    return out.select("fault", "id", "status", F.when(F.col("id").isNotNull(), F.size("segments")).alias("segments"), F.when(F.col("id").isNotNull(), F.col("hash") != F.col("_before")).alias("hashed"))


@query("""
SELECT 'd-' || doc_id AS id, CASE WHEN quality = 1 THEN 'reviewed' WHEN trim(coalesce(text, '')) = '' THEN 'failed' ELSE 'translated' END AS status, quality IS DISTINCT FROM 1 AND (toxic IS DISTINCT FROM 1 OR trim(coalesce(text, '')) = '') AS asked,
  CASE WHEN quality = 1 THEN 'old' WHEN trim(coalesce(text, '')) = '' THEN '' ELSE md5('译' || text) END AS shown FROM documents LEFT JOIN labels USING (doc_id)""")
def translation_run(spark, sf_dir):
    """A resumed run over records: reviewed ones are skipped or stamped, stored units are taken over, the others are asked for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    name = F.concat(F.lit("d-"), "doc_id").alias("id")
    null = F.lit(None).cast("string")
    rows = docs.select(name, F.md5(F.coalesce("text", F.lit(""))).alias("source_hash"), F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "failed").otherwise("pending").alias("status"), null.alias("model"), null.alias("translated_at"), null.alias("reviewed_at"), null.alias("last_error"))
    units = docs.select(name, F.lit("body").alias("unit"), "text", null.alias("speaker"), F.when(F.col("quality") == 1, "old").otherwise("").alias("text_zh"))
    saved = docs.where("toxic = 1").select(name, F.lit("body").alias("unit"), F.sha2(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"), F.lit("").alias("s"))), 256).alias("unit_hash"), F.lit("earlier").alias("source_hash"), F.concat(F.lit("译"), "text").alias("result"), F.lit(False).alias("forced"))
    fine = lambda source, target: F.lit(True)
    planned = R.plan(rows, units, saved, good=fine)
    pending = planned.where("pending")
    # The outcomes are kept: a unit is asked for once, however often they are read.
    results = R.in_waves(pending, lambda texts: ["译" + t if t.strip(" ") else t for t in texts], lambda df: df.persist(StorageLevel.DISK_ONLY))
    out, shown, _ = R.finish(rows, planned, results, saved, "m", "now", good=fine)
    text = F.when(F.col("text_zh").isin("", "old"), F.col("text_zh")).otherwise(F.md5("text_zh"))
    return out.select("id", "status").join(shown.select("id", text.alias("shown")), "id").join(pending.select("id", F.lit(True).alias("asked")), "id", "left").select("id", "status", F.coalesce("asked", F.lit(False)).alias("asked"), "shown")
