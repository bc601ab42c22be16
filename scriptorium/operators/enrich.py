"""Enrichment of work units with checkpoints: only units without a valid checkpoint are sent to the given function.

The function is injected (``Callable[[list[str]], list[str]]``, a batch of texts to a batch of results); a failed batch is run in halves, so one
bad unit doesn't fail the others. The checkpoint is a table (id, unit, source_hash, result, error)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.packing import bisected

CHECKPOINT = "id string, unit string, source_hash string, result string, error string"


def unit_hash(kind: str, text: str, speaker: str):
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (kind, text, speaker)]
    return F.sha2(F.concat_ws(chr(0), *parts), 256)


def pending(units: DataFrame, checkpoint: DataFrame, force: bool = False) -> DataFrame:
    """Units without a checkpoint of the same source hash and a non-blank result."""
    if force:
        return units
    done = checkpoint.where(F.coalesce(F.trim("result"), F.lit("")) != "").select("id", "unit", "source_hash")
    return units.join(done, ["id", "unit", "source_hash"], "left_anti")


def enrich(units: DataFrame, run: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """Checkpoint rows of the units (id, unit, source_hash, text)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part["text"].fillna("").tolist()
                outcome = list(bisected(list(range(len(texts))), lambda ids: run([texts[i] for i in ids])))  # noqa: B023
                yield part.assign(result=[r for _, r, _ in outcome], error=[str(e) if e else None for _, _, e in outcome])[["id", "unit", "source_hash", "result", "error"]]

    return units.select("id", "unit", "source_hash", "text").mapInPandas(work, CHECKPOINT)


def resume(units: DataFrame, checkpoint: DataFrame, run: Callable[[list[str]], list[str]], force: bool = False) -> DataFrame:
    """The new checkpoint: results of valid earlier units and of the pending ones."""
    fresh = enrich(pending(units, checkpoint, force), run)
    kept = checkpoint.join(units.select("id", "unit", "source_hash"), ["id", "unit", "source_hash"], "left_semi") if not force else checkpoint.limit(0)
    kept = kept.where(F.coalesce(F.trim("result"), F.lit("")) != "")
    return kept.select("id", "unit", "source_hash", "result", "error").unionByName(fresh)


def states(units: DataFrame, checkpoint: DataFrame, before: DataFrame) -> DataFrame:
    """(id, status, last_error) of each entity: translated if every unit has a result, else failed; reviewed ones without new work stay."""
    u = units.select("id", "unit", "source_hash").join(checkpoint, ["id", "unit", "source_hash"], "left")
    ok = F.coalesce(F.trim("result"), F.lit("")) != ""
    grouped = u.groupBy("id").agg(F.bool_and(ok).alias("complete"), F.min("error").alias("last_error"))
    joined = grouped.join(before.select("id", F.col("status").alias("before")), "id", "left")
    status = F.when(F.col("complete") & (F.col("before") == "reviewed"), "reviewed").when(F.col("complete"), "translated").otherwise("failed")
    return joined.select("id", status.alias("status"), "last_error")
