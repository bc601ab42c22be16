"""Queries of ingestion and merging: snapshots, selections, returned work, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import packing, snapshots
from scriptorium.sources.tables import bounded_batches, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def snapshots_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A new snapshot, the documents, and an earlier one: labelled documents, those of low quality with another text, the toxic
    ones marked as missing, and the benchmark's items, which are gone by now."""
    docs, labels, items = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    new = docs.select(F.concat(F.lit("d-"), "doc_id").alias("id"), "text", "source")
    old = docs.join(labels, "doc_id").select(F.concat(F.lit("d-"), "doc_id").alias("id"), F.when(F.col("quality") == 0, F.concat("text", F.lit(" earlier"))).otherwise(F.col("text")).alias("text"), "source", (F.col("toxic") == 1).alias("missing"))
    gone = items.select(F.concat(F.lit("b-"), "item_id").alias("id"), "text", F.lit("bench").alias("source"), F.lit(False).alias("missing"))
    hashed = lambda df: df.withColumn("hash", snapshots.content_hash({"id": F.col("id"), "textEn": F.col("text"), "source": F.col("source")}))
    return hashed(new), hashed(old.unionByName(gone))


SNAPSHOTS = """
WITH new AS (SELECT 'd-' || doc_id AS id, text, source FROM documents),
old AS (SELECT 'd-' || d.doc_id AS id, CASE WHEN quality = 0 THEN text || ' earlier' ELSE text END AS text, source, toxic = 1 AS missing FROM documents d JOIN labels l USING (doc_id)
  UNION ALL SELECT 'b-' || item_id, text, 'bench', false FROM benchmark)"""


@query("SELECT doc_id, sha256(text) AS text_hash, sha256('segment' || chr(0) || text || chr(0) || source) AS unit_hash FROM documents")
def content_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.sha2(F.concat_ws(chr(0), F.lit("segment"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))), 256).alias("unit_hash"))


@query(SNAPSHOTS + """
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL AND missing THEN 'gone' WHEN n.id IS NULL THEN 'missing'
  WHEN n.text = o.text AND n.source = o.source AND NOT missing THEN 'unchanged' ELSE 'written' END AS outcome
FROM new n FULL JOIN old o ON n.id = o.id""")
def snapshot_diff(spark, sf_dir):
    return snapshots.diff(*snapshots_of(spark, sf_dir), "id")


@query(SNAPSHOTS + """
SELECT CASE WHEN n.id IS NULL THEN 'missing' WHEN n.text = o.text AND NOT missing THEN 'unchanged' ELSE 'written' END AS outcome, count(*) AS n
FROM new n FULL JOIN old o ON n.id = o.id GROUP BY ALL""")
def snapshot_outcomes(spark, sf_dir):
    return snapshots.diff(*snapshots_of(spark, sf_dir), "id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS is_new FROM documents d LEFT JOIN labels l USING (doc_id)")
def existing_left_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "quality", F.col("known").isNull().alias("is_new"))


@query(SNAPSHOTS + "SELECT id FROM old WHERE NOT missing AND id NOT IN (SELECT id FROM new)")
def mark_missing(spark, sf_dir):
    new, old = snapshots_of(spark, sf_dir)
    return old.where(~F.col("missing")).join(new, "id", "left_anti").select("id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def baseline_missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def selection_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("""
WITH new AS (SELECT conv_id, turn, text, role FROM conversations),
old AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN upper(text) ELSE text END AS text, role, '<' || text || '>' AS zh FROM conversations WHERE turn > 0)
SELECT n.conv_id, n.turn, coalesce(CASE WHEN n.text = o.text AND n.role IS NOT DISTINCT FROM o.role THEN o.zh END, '') AS text_zh
FROM new n LEFT JOIN old o ON n.conv_id = o.conv_id AND n.turn = o.turn""")
def segment_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("text_en"), F.col("role").alias("speaker_en"))
    old = rows.where("turn > 0").select("conv_id", "turn", F.when(F.col("speaker_en") == "user", F.upper("text_en")).otherwise(F.col("text_en")).alias("text_en"), "speaker_en", F.concat(F.lit("<"), "text_en", F.lit(">")).alias("text_zh"), F.lit("zh").alias("speaker_zh"))
    return snapshots.merge_segments(rows, old, ["conv_id", "turn"]).select("conv_id", "turn", "text_zh")


@query("""
SELECT coalesce(o_orderkey, l_orderkey) AS id, CASE WHEN o_orderkey IS NULL THEN 'unexpected' WHEN l_orderkey IS NULL THEN 'omitted' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS verdict
FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey""")
def returned_ids_check(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("asked"))
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "omitted").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return asked.join(got, "id", "full_outer").select("id", verdict.alias("verdict"))


@query("""
SELECT conv_id, string_agg(trim(text), '' ORDER BY turn) AS text, bool_and(trim(text) <> '') AS complete FROM conversations GROUP BY ALL""")
def parts_join_concat(spark, sf_dir):
    part = F.struct("turn", F.trim("text").alias("t"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.bool_and(F.trim("text") != "").alias("complete"))
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), "complete")


@query("""
WITH RECURSIVE r AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n, l_linenumber FROM lineitem),
f(l_orderkey, n, l_linenumber, q, chunk, s) AS (SELECT l_orderkey, n, l_linenumber, q, 0, q FROM r WHERE n = 1
  UNION ALL SELECT r.l_orderkey, r.n, r.l_linenumber, r.q, CASE WHEN f.s > 0 AND f.s + r.q > 60 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.s > 0 AND f.s + r.q > 60 THEN r.q ELSE f.s + r.q END
  FROM f JOIN r ON r.l_orderkey = f.l_orderkey AND r.n = f.n + 1)
SELECT l_orderkey, l_linenumber, q AS l_quantity, CAST(chunk AS INT) AS chunk FROM f""")
def greedy_chunks(spark, sf_dir):
    return packing.greedy_chunks(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 60)


@query("""
WITH RECURSIVE c AS (SELECT user_id, epoch(ts) AS t, event_type || ' ' || value || CASE WHEN value > 50 THEN '.' ELSE '' END AS x FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, x) AS i FROM c),
f(user_id, i, paragraph, start, text, over) AS (SELECT user_id, i, 0, t, x, length(x) >= 40 AND regexp_matches(x, '[.!?]$') FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, CASE WHEN f.over OR length(f.text || ' ' || r.x) > 80 OR r.t - f.start > 86400 THEN f.paragraph + 1 ELSE f.paragraph END, CASE WHEN f.over OR length(f.text || ' ' || r.x) > 80 OR r.t - f.start > 86400 THEN r.t ELSE f.start END,
    CASE WHEN f.over OR length(f.text || ' ' || r.x) > 80 OR r.t - f.start > 86400 THEN r.x ELSE f.text || ' ' || r.x END,
    CASE WHEN f.over THEN length(r.x) >= 40 AND regexp_matches(r.x, '[.!?]$') WHEN length(f.text || ' ' || r.x) > 80 OR r.t - f.start > 86400 THEN false ELSE length(f.text || ' ' || r.x) >= 40 AND regexp_matches(r.x, '[.!?]$') END
  FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, paragraph, min(start) AS start, arg_max(text, i) AS text FROM f GROUP BY user_id, paragraph""")
def caption_windows(spark, sf_dir):
    cues = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("start"), F.concat("event_type", F.lit(" "), F.col("value").cast("string"), F.when(F.col("value") > 50, ".").otherwise("")).alias("text"))
    return packing.paragraph_windows(cues, "user_id", "start", "text", 40, 80, 86_400.0)


@query("""
WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f(o_custkey, i, o_orderkey, size, used, batch) AS (SELECT o_custkey, i, o_orderkey, size, [size], 1 FROM r WHERE i = 1
  UNION ALL SELECT s.o_custkey, s.i, s.o_orderkey, s.size, CASE WHEN s.spot IS NULL OR s.spot = 0 THEN list_append(s.used, s.size) ELSE list_transform(s.used, lambda x, k: CASE WHEN k = s.spot THEN x + s.size ELSE x END) END, CASE WHEN s.spot IS NULL OR s.spot = 0 THEN len(s.used) + 1 ELSE s.spot END
  FROM (SELECT r.o_custkey, r.i, r.o_orderkey, r.size, f.used, list_position(list_transform(f.used, lambda x: x + r.size <= 300000), true) AS spot FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.i = f.i + 1) s)
SELECT o_custkey, o_orderkey, size, CAST(batch - 1 AS INT) AS batch FROM f""")
def first_fit_batches(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("long").alias("size"))
    return packing.first_fit(items, "o_custkey", "o_orderkey", "size", 300_000)


@query()
def unit_parts(spark, sf_dir):
    bounded_batches(spark)
    parts = packing.unit_parts(table(spark, sf_dir, "documents"), ["doc_id"], "text", 2300)
    return parts.select("doc_id", "part", F.length("text").alias("size"), F.sha2("text", 256).alias("part_hash"))


@query("""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS INT) AS unit, kind, text FROM (
  SELECT 'p-' || page_id AS id, 0 AS p, 'title' AS kind, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS text FROM pages
  UNION ALL SELECT 'p-' || page_id, 1, 'summary', url FROM pages) WHERE text <> ''""")
def unit_explode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p-"), "page_id").alias("id"), F.trim(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"), "url")
    unit = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    units = F.filter(F.array(unit("title", F.col("title")), unit("summary", F.col("url"))), lambda u: u["text"] != "")
    return pages.select("id", F.posexplode(units).alias("unit", "u")).select("id", "unit", "u.kind", "u.text")
