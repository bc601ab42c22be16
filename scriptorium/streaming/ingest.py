"""Incremental ingestion of payload files as a stream: every micro-batch is merged into a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scriptorium.operators.snapshots import content_hash


def stream_ingest(spark: SparkSession, source: str, schema: StructType, key: str, order: str, snapshot: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of a folder and appends the changed records of each micro-batch as a version of the snapshot.

    A batch that is run again writes its own version anew (the version is the batch's number), so every record counts once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        hashed = latest.withColumn("hash", content_hash({c: F.col(c) for c in batch.columns}))
        hashed.write.mode("overwrite").parquet(f"{snapshot}/version={number:010d}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, snapshot: str, key: str, order: str) -> DataFrame:
    """The latest version of each record."""
    rows = spark.read.parquet(snapshot)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, "version")).alias("r"))
    return latest.select("r.*").drop("version")


def windowed_counts(rows: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window with a watermark for late rows; works on streams and tables alike."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
