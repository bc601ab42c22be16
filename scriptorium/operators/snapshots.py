"""Snapshots of records: content hashes, change classes, merges that keep earlier work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as compact JSON in the given order; null fields are left out, whole numbers have no fraction."""
    text = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.sha2(F.regexp_replace(text, r"(:-?\d+)\.0([,}\]])", "$1$2"), 256)


def diff(new: DataFrame, old: DataFrame, key: str, hash_col: str = "hash", missing: str = "missing") -> DataFrame:
    """(key, outcome) of a full comparison: written, unchanged, missing (newly gone) or gone (marked before).

    A record that comes back after it was marked is written."""
    n, o = new.select(key, F.col(hash_col).alias("new_hash")), old.select(key, F.col(hash_col).alias("old_hash"), F.col(missing).alias("was_missing"))
    outcome = (
        F.when(F.col("new_hash").isNull() & F.coalesce("was_missing", F.lit(False)), "gone")
        .when(F.col("new_hash").isNull(), "missing")
        .when((F.col("new_hash") == F.col("old_hash")) & ~F.coalesce("was_missing", F.lit(False)), "unchanged")
        .otherwise("written")
    )
    return n.join(o, key, "full_outer").select(key, outcome.alias("outcome"))


def merge_segments(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Carries the translations of segments whose source text and speaker are unchanged (null equals null).

    new: keys, text_en, speaker_en. old: the same with text_zh and speaker_zh."""
    o = old.select(*keys, F.col("text_en").alias("_text"), F.col("speaker_en").alias("_speaker"), "text_zh", "speaker_zh").dropDuplicates(keys)
    same = (F.col("text_en") == F.col("_text")) & F.col("speaker_en").eqNullSafe(F.col("_speaker"))
    kept = {c: F.coalesce(F.when(same, F.col(c)), F.lit("")) for c in ("text_zh", "speaker_zh")}
    return new.join(o, keys, "left").select(*keys, "text_en", "speaker_en", *[v.alias(c) for c, v in kept.items()])
