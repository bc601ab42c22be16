"""A stream of fetched payloads merged into published snapshots, exactly once.

A micro-batch holds rows (id, type, day, title, source_url, part, payload): part ``index`` alone, or with a fetched ``transcript`` or ``detail``. Of
several rows of a record and part the one that was fetched last counts, so the runs of one micro-batch are coalesced. The new version is published with the
number of its micro-batch; a batch that is run again after a crash finds its number and leaves the version as it is. A version is a snapshot of
all records (copy on write), so large micro-batches cost less than many small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators import build as B
from scriptorium.operators.published import Store

PAYLOAD = "struct<" + ", ".join(x.replace(" ", ":", 1) for x in B.FETCHED.split(", ")[1:]) + ">"
ROWS = f"id string, type string, day string, title string, source_url string, part string, fetched bigint, payload {PAYLOAD}"


def merged(batch: DataFrame, before: DataFrame, snapshot: str, at: str) -> DataFrame:
    """The snapshot after a micro-batch (with outcomes); records that it doesn't name stay."""
    last = batch.where("id is not null").groupBy("id", "part").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("id", "part")]), "fetched").alias("r")).select("id", "part", "r.*")
    index = last.groupBy("id").agg(*[F.max_by(c, "fetched").alias(c) for c in ("type", "day", "title", "source_url")])
    part = lambda name: last.where(F.col("part") == name).select("id", "payload.*")
    return B.build(index, part("transcript"), part("detail"), before, snapshot, at, whole=False)


def stream_records(spark: SparkSession, source: str, store: Store, checkpoint: str, snapshot: str, files: int = 1) -> StreamingQuery:
    """Reads new Parquet files of a folder until there are none."""

    def publish(batch: DataFrame, number: int) -> None:
        if store.facts().get("batch", -1) >= number:
            return
        before = store.read()
        before = spark.createDataFrame([], B.RECORD) if before is None else before
        store.write(merged(batch, before, snapshot, f"batch {number}").drop("outcome"), batch=number)

    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
