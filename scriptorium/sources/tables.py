"""Parquet tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 8 << 20, rows: int = 2_000) -> None:
    """Session setting for whole texts in Python: Arrow batches are bounded in bytes and rows, so that a worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
