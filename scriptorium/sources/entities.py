"""Archive records made from the test tables: one a conversation, its turns as segments.

The derived fields are expressions that Spark and other SQL engines read alike, so a query and the SQL it is held against start from
the same records. They cover the odd cases: empty translations, bad addresses and dates, missing stamps, steps back in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.tables import table

N = "CAST(n AS STRING)"
RECORD = {
    "id": f"'c-' || lpad({N}, 6, '0')",
    "slug": "'talk-' || CAST(CASE WHEN n % 17 = 16 THEN n - 1 ELSE n END AS STRING)",
    "snapshot": "CASE WHEN n % 7 = 3 THEN '2024-01-01' ELSE '2024-02-02' END",
    "type": "CASE n % 6 WHEN 0 THEN 'interview' WHEN 1 THEN 'keynote' WHEN 2 THEN 'speech' WHEN 3 THEN 'earnings' WHEN 4 THEN 'space' ELSE 'other' END",
    "day": "CASE WHEN n % 13 = 5 THEN '2023-02-30' ELSE '20' || CAST(10 + n % 15 AS STRING) || '-' || lpad(CAST(1 + n % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + n % 28 AS STRING), 2, '0') END",
    "title_en": f"CASE WHEN n % 19 = 7 THEN ' ' ELSE 'Talk *' || {N} || '* <on> [things] & more' END",
    "title_zh": f"CASE WHEN n % 4 = 0 THEN '' ELSE '谈话_' || {N} || '_' END",
    "summary_en": f"'About ' || {N} || ' things'",
    "summary_zh": "CASE WHEN n % 5 = 0 THEN '' ELSE '关于`事物`' END",
    "source_url": f"CASE n % 9 WHEN 2 THEN 'ftp://x.example/' || {N} WHEN 4 THEN 'https://user@x.example/a' WHEN 6 THEN 'https://youtu.be/abc' || lpad({N}, 6, '0') ELSE 'https://www.youtube.com/watch?v=abc' || lpad({N}, 6, '0') END",
    "source_label": f"CASE WHEN n % 3 = 0 THEN NULL ELSE 'Label ' || {N} END",
    "archive_url": f"CASE WHEN n % 14 = 9 THEN 'https://other.example/items/' ELSE 'https://archive.example/items/' END || {N}",
    "transcript_source": f"CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://archive.example/items/' || {N} WHEN 2 THEN 'https://t.example/<' || {N} || '>' ELSE 'no address' END",
    "embed_url": f"CASE n % 5 WHEN 1 THEN NULL WHEN 3 THEN 'https://www.youtube.com/embed/abc' || lpad({N}, 6, '0') ELSE 'https://www.youtube-nocookie.com/embed/abc' || lpad({N}, 6, '0') END",
    "thumbnail_url": f"CASE n % 6 WHEN 1 THEN NULL WHEN 4 THEN 'data:x' ELSE 'https://i.ytimg.com/vi/abc' || lpad({N}, 6, '0') || '/a.jpg' END",
    "org": "CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'Acme' ELSE '示例' END",
    "duration": "CAST(CASE n % 8 WHEN 3 THEN -5 WHEN 5 THEN 40000 WHEN 6 THEN NULL ELSE n * 7 + 60 END AS DOUBLE)",
    "kind": "CASE WHEN n % 10 = 9 THEN 'none' WHEN n % 10 = 7 THEN 'poem' WHEN n % 2 = 0 THEN 'dialogue' ELSE 'article' END",
    "status": "CASE n % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'translated' WHEN 2 THEN 'reviewed' ELSE 'failed' END",
    "translated_at": "CASE WHEN n % 4 = 0 THEN '' ELSE '2024-03-0' || CAST(1 + n % 9 AS STRING) || 'T00:00:00Z' END",
    "reviewed_at": "CASE WHEN n % 8 = 2 THEN '2024-04-01T00:00:00Z' ELSE '' END",
    "fetched_at": "CASE WHEN n % 21 = 20 THEN 'yesterday' ELSE '2024-01-02T03:04:05Z' END",
    "source_missing": "n % 12 = 7",
}
SEGMENT = {
    "sid": "CASE WHEN n % 15 = 8 AND turn = 1 THEN 's-0001' ELSE 's-' || lpad(CAST(turn + 1 AS STRING), 4, '0') END",
    "speaker_en": "upper(role)",
    "speaker_zh": "CASE WHEN turn % 3 = 0 THEN '' ELSE '讲者' END",
    "start": "CAST(CASE WHEN turn % 5 = 4 THEN NULL WHEN n % 6 = 1 AND turn = 3 THEN 1 WHEN n % 20 = 3 AND turn = 0 THEN -1 ELSE turn * 31 END AS DOUBLE)",
    "text_en": "CASE WHEN n % 18 = 4 AND turn = 0 THEN ' ' ELSE text END",
    "text_zh": "CASE WHEN (n + turn) % 9 = 8 THEN '' WHEN (n + turn) % 31 = 5 THEN 'only English words are in this line' ELSE '译文：' || substr(text, 1, 40) END",
}


#: Records and segments for the audit: nulls, repeated ids, addresses of other records, texts that break each rule.
AUDIT_RECORD = {
    "id": f"CASE n % 23 WHEN 5 THEN NULL WHEN 6 THEN ' ' WHEN 9 THEN 'r-' || CAST(n - 1 AS STRING) WHEN 10 THEN 'r-' || CAST(n - 2 AS STRING) ELSE 'r-' || {N} END",
    "slug": f"CASE n % 29 WHEN 3 THEN NULL WHEN 8 THEN 'shared' ELSE 't-' || {N} END",
    "snapshot": "CASE n % 31 WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN 'older' ELSE 's1' END",
    "type": "CASE n % 37 WHEN 1 THEN NULL WHEN 2 THEN 'other' ELSE 'speech' END",
    "kind": "CASE n % 19 WHEN 1 THEN NULL WHEN 2 THEN 'none' WHEN 3 THEN 'poem' ELSE 'dialogue' END",
    "day": "CASE n % 41 WHEN 1 THEN NULL WHEN 2 THEN '2023-02-30' WHEN 3 THEN '2023-2-3' ELSE '2023-02-03' END",
    "title_en": "CASE n % 17 WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'A talk about rivers' END",
    "title_zh": "CASE n % 13 WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'about rivers' ELSE '关于河流的谈话' END",
    "summary_en": "CASE n % 11 WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'It cost 12 dollars' END",
    "summary_zh": "CASE n % 7 WHEN 1 THEN NULL WHEN 2 THEN '价格是13美元' ELSE '价格是12美元' END",
    "source_url": f"CASE n % 43 WHEN 1 THEN NULL WHEN 2 THEN 'ftp://x.example/a' ELSE 'https://x.example/' || {N} END",
    "archive_url": f"CASE n % 47 WHEN 1 THEN NULL WHEN 2 THEN 'no address' WHEN 3 THEN 'https://archive.example/items/r-0' WHEN 4 THEN 'https://other.example/items/r-' || {N} ELSE 'https://archive.example/items/r-' || {N} || CASE WHEN n % 2 = 0 THEN '/' ELSE '' END END",
    "embed_url": "CASE n % 15 WHEN 1 THEN 'https://youtube-nocookie.com/embed/a' WHEN 2 THEN 'https://www.youtube.com/embed/a' WHEN 3 THEN 'data:x' WHEN 4 THEN 'https://www.youtube-nocookie.com/embed/a' END",
    "thumbnail_url": "CASE n % 14 WHEN 1 THEN 'data:x' WHEN 2 THEN 'https://i.example/a.jpg' END",
    "duration": "CAST(CASE n % 16 WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE 60 END AS DOUBLE)",
    "fetched_at": "CASE n % 18 WHEN 1 THEN NULL WHEN 2 THEN 'soon' ELSE '2024-01-02T03:04:05Z' END",
    "status": "CASE n % 9 WHEN 1 THEN NULL WHEN 2 THEN 'lost' WHEN 3 THEN 'translated' ELSE 'reviewed' END",
    "reviewed_at": "CASE n % 10 WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE '2024-04-01T00:00:00Z' END",
    "model": "CASE n % 12 WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'm1' END",
    "source_missing": "CASE n % 20 WHEN 1 THEN NULL WHEN 2 THEN true ELSE false END",
    "hash": "CASE n % 21 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'x' ELSE 'h1' END",
    "has_segments": "CASE n % 22 WHEN 1 THEN NULL WHEN 2 THEN false ELSE true END",
}
AUDIT_SEGMENT = {
    "sid": "CASE (n + turn) % 11 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'same' WHEN 4 THEN 'same' ELSE 's' || CAST(turn AS STRING) END",
    "speaker_en": "CASE (n + turn) % 13 WHEN 1 THEN NULL WHEN 2 THEN 'ADA Lovelace (host)' WHEN 3 THEN 'Grace' WHEN 4 THEN 'Twenty and a half' ELSE 'Ada Lovelace' END",
    "speaker_zh": "CASE (n + turn) % 5 WHEN 1 THEN NULL WHEN 2 THEN 'Ada Lovelace' ELSE '埃达' END",
    "start": "CAST(CASE (n + turn) % 12 WHEN 1 THEN NULL WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE turn * 10 END AS DOUBLE)",
    "text_en": "CASE (n + turn) % 9 WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'The river runs by the old town and people walk along it every day of the year.' WHEN 4 THEN 'The Falcon Heavy and NASA Ames' WHEN 5 THEN 'See https://x.example/a and example.com' WHEN 6 THEN 'Seven of them came' ELSE 'Boats pass by the old bridge' END",
    "text_zh": "CASE (n + turn * 2) % 9 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '河' WHEN 4 THEN 'the boats that pass by here are old' WHEN 5 THEN 'Falcon Heavy NASA Ames 一 see the other of the boats' ELSE '船从古老的桥下驶过，人们沿着河边散步，每天都能看见同样的景色，年年如此，从不改变，直到今天。' END",
}


def _list(fields: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in fields.items())


#: The same for SQL: ``records`` (one row each) and ``segs`` (n, turn and the segment's fields).
WITH = f"""records AS (SELECT n, {_list(RECORD)} FROM (SELECT DISTINCT conv_id AS n FROM conversations)),
segs AS (SELECT n, turn, {_list(SEGMENT)} FROM (SELECT conv_id AS n, turn, role, text FROM conversations))"""


AUDIT_WITH = f"""r AS (SELECT n AS place, {_list(AUDIT_RECORD)} FROM (SELECT DISTINCT conv_id AS n FROM conversations)),
s AS (SELECT n AS place, turn, {_list(AUDIT_SEGMENT)} FROM (SELECT conv_id AS n, turn FROM conversations))"""


def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, segments) of the audit."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "turn")
    pick = lambda fields: [F.expr(sql).alias(name) for name, sql in fields.items()]
    return turns.select("n").distinct().select(F.col("n").alias("place"), *pick(AUDIT_RECORD)), turns.select(F.col("n").alias("place"), "turn", *pick(AUDIT_SEGMENT))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n")).distinct()
    return ids.select("n", *[F.expr(sql).alias(name) for name, sql in RECORD.items()])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("n"), "turn", "role", "text")
    return turns.select("n", "turn", *[F.expr(sql).alias(name) for name, sql in SEGMENT.items()])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their segments in order; an array holds one record's."""
    rows = segments(spark, sf_dir).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("turn", *SEGMENT))).alias("segments"))
    return records(spark, sf_dir).join(rows, "n")
