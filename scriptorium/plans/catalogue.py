"""Queries of the catalogue over the test tables: facets, pages, neighbours, related records, time stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import catalog, related
from scriptorium.sources.tables import table

QUERIES, SQL = {}, {}
#: The kinds of events that a facet shows even where none exist.
KINDS = ("click", "view", "purchase", "signup", "login", "none")
SQL_KINDS = ", ".join(f"('{k}')" for k in KINDS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated records: the day as string, as the archive has it."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""
SELECT CAST(position AS INT) AS position, event_id, day, user_id FROM (
  SELECT row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id) AS position, event_id, strftime(ts, '%Y-%m-%d') AS day, user_id
  FROM events WHERE event_type = 'click') WHERE position BETWEEN 25 AND 48""")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.facet_filter(dated(spark, sf_dir), event_type="click")
    return catalog.page_of(rows, [F.col("day").desc(), F.col("event_id").asc()], catalog.Page(2)).select("position", "event_id", "day", "user_id")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def facet_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k.kind, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES {SQL_KINDS}) k(kind) LEFT JOIN events e ON e.event_type = k.kind GROUP BY ALL")
def facet_counts_zero_filled(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    found = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(kinds), "kind", "right").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT DISTINCT substr(strftime(ts, '%Y-%m-%d'), 1, 4) AS year, event_type FROM events")
def facet_values(spark, sf_dir):
    return dated(spark, sf_dir).select(F.substring("day", 1, 4).alias("year"), "event_type").distinct()


@query("""
SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'token')""")
def catalog_text_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(catalog.all_terms_in(F.lower("text"), " the  TOKEN ")).select("doc_id", "source")


@query("SELECT event_type, count(*) AS n, CAST(ceil(count(*) / 24.0) AS BIGINT) AS pages FROM events GROUP BY ALL")
def page_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("pages", F.ceil(F.col("n") / catalog.PAGE_SIZE).cast("long"))


@query("SELECT event_type, min(strftime(ts, '%Y-%m-%d')) AS first_day, max(strftime(ts, '%Y-%m-%d')) AS last_day, count(*) AS n FROM events GROUP BY ALL")
def category_range(spark, sf_dir):
    return dated(spark, sf_dir).groupBy("event_type").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, arg_max(event_id, ts) AS last_id, max(strftime(ts, '%Y-%m-%d')) AS last_day FROM events GROUP BY ALL")
def category_lastmod(spark, sf_dir):
    return dated(spark, sf_dir).groupBy("event_type").agg(F.max_by("event_id", "ts").alias("last_id"), F.max("day").alias("last_day"))


@query("SELECT max(d) AS updated_at FROM (SELECT unnest([strftime(ts, '%Y-%m-%d'), event_type]) AS d FROM events) WHERE d <> '' AND regexp_matches(d, '^[0-9]')")
def collection_lastmod(spark, sf_dir):
    stamps = dated(spark, sf_dir).select(F.explode(F.array("day", "event_type")).alias("d"))
    return stamps.where((F.col("d") != "") & F.col("d").rlike("^[0-9]")).agg(F.max("d").alias("updated_at"))


@query(r"""
SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS characters,
  greatest(1, CAST(ceil(length(regexp_replace(text, '\s', '', 'g')) / 400.0) AS BIGINT)) AS minutes FROM documents""")
def transcript_stats(spark, sf_dir):
    n = T.visible_length(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("characters"), T.reading_minutes(n).alias("minutes"))


@query("""
SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id)""")
def neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    rank = F.col("event_id") - F.unix_date("day") * F.lit(1 << 36)
    return related.beside(rows, "event_id", ["user_id"], rank, [F.col("day").desc(), F.col("event_id").asc()]).select("event_id", "previous", "next")


@query("""
SELECT c_custkey, related, CAST(position AS INT) AS position FROM (
  SELECT a.c_custkey, b.c_custkey AS related, row_number() OVER (PARTITION BY a.c_custkey
    ORDER BY (a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment) DESC, b.c_acctbal DESC, b.c_custkey) AS position
  FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey) WHERE position <= 4""")
def related_top4(spark, sf_dir):
    return related.top_related(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("""
SELECT conv_id, turn FROM (SELECT conv_id, turn, role, trim(text) AS t, lag(trim(text)) OVER w AS before, lag(role) OVER w AS role_before
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE t = before AND length(t) >= 30 AND role <> role_before""")
def lag_duplicate_text(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.trim("text"))
    rows = rows.withColumn("before", F.lag("t").over(w)).withColumn("role_before", F.lag("role").over(w))
    return rows.where((F.col("t") == F.col("before")) & (F.length("t") >= 30) & (F.col("role") != F.col("role_before"))).select("conv_id", "turn")


@query("""
SELECT event_id, before FROM (SELECT event_id, value, coalesce(last_value(CASE WHEN value >= 0 THEN value END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS before FROM events) WHERE value >= 0 AND value < before""")
def monotonic_violations(spark, sf_dir):
    return related.drops(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], F.col("event_id"), [F.col("event_id").asc()], F.col("value")).select("event_id", "before")


@query("SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id)")
def archive_neighbours(spark, sf_dir):
    """The records before and after in one order of the whole archive, split into ranges of it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    rank = F.col("event_id") - F.unix_date("day") * F.lit(1 << 36)
    return related.beside(rows, "event_id", [], rank, [F.col("day").desc(), F.col("event_id").asc()]).select("event_id", "previous", "next")


@query("""
SELECT event_id, event_type, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next, b AS before FROM (SELECT *, coalesce(last_value(CASE WHEN value >= 10 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) AS b FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def kind_neighbours(spark, sf_dir):
    """Neighbours within few large groups, and the last value of 10 and more before each row."""
    rows, order = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), [F.col("event_id").asc()]
    known = related.carried(rows, ["event_type"], F.col("event_id"), order, F.when(F.col("value") >= 10, F.col("value")), "before")
    return related.beside(known, "event_id", ["event_type"], F.col("event_id"), order).select("event_id", "event_type", "previous", "next", F.coalesce("before", F.lit(-1.0)).alias("before"))


@query("""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
a AS (SELECT doc_id, n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS top FROM l), q AS (SELECT doc_id, quality * 400 + toxic * 90 + doc_id % 50 AS place FROM labels)
SELECT q.doc_id, CAST(q.place AS BIGINT) AS place, CAST(max(a.n) AS BIGINT) AS line FROM q LEFT JOIN a ON a.doc_id = q.doc_id AND a.top <= q.place GROUP BY q.doc_id, q.place""")
def reading_positions(spark, sf_dir):
    """The line that a reader at some offset of a text is in: the last one that begins at or before it."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("n", "line")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), (F.length("line") + 1).cast("long").alias("size"))
    w = Window.partitionBy("doc_id").orderBy("n")
    anchors = rows.select("doc_id", (F.sum("size").over(w) - F.col("size")).alias("place"), F.col("n").alias("line"))
    asked = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 400 + F.col("toxic") * 90 + F.col("doc_id") % 50).cast("long").alias("place"), F.col("doc_id").alias("asked"))
    return related.last_before(anchors, asked, ["doc_id"], "place", "line", "asked").select("doc_id", "place", "line")


@query("SELECT text, doc_id, CAST(n AS INT) AS occurrence FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def duplicate_texts(spark, sf_dir):
    return related.repeats_of(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, CASE WHEN text = '' THEN 'none' ELSE 'available' END AS body, upper(lang) || ' ' || source AS card FROM documents")
def card_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.when(F.col("text") == "", "none").otherwise("available").alias("body"), F.concat_ws(" ", F.upper("lang"), F.coalesce(T.present(F.col("source")), F.lit(""))).alias("card"))


@query("""
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id) AS position FROM events""")
def archive_index(spark, sf_dir):
    rows, day = dated(spark, sf_dir), F.unix_date(F.to_date("ts"))
    found = related.numbered(rows.select("event_id", "event_type", "day", "ts"), ["event_type"], -day, [F.col("day").desc(), F.col("event_id")])
    return found.select("event_id", "event_type", F.col("position").cast("long").alias("position"))


@query("SELECT user_id, string_agg(DISTINCT strftime(ts, '%Y-%m'), ',' ORDER BY strftime(ts, '%Y-%m')) AS snapshots FROM events GROUP BY ALL")
def snapshot_ids(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.date_format("ts", "yyyy-MM")).alias("s"))
    return days.select("user_id", F.array_join(F.array_sort("s"), ",").alias("snapshots"))
