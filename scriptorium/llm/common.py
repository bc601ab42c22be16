"""What the training-data operators share: table access, the shared folder, sizes that are checked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Bytes of an Arrow batch, so that very long texts don't fill a Python worker.
BATCH_BYTES = 8 << 20


#: Bytes of a row group that a writer holds in memory.
ROW_GROUP = 16 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about so many characters of a text column (one text may be longer)."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // chars)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings for jobs with Python workers: Arrow batches are bounded in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    Where the session has none, a folder of this machine serves a local master (as in tests); on a cluster this raises."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (top or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it.

    This cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.pop("_folder", None):
            remove(df.sparkSession, path)


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Joins with a broadcast if the small side has at most BROADCAST_ROWS rows, else by a shuffle
    (adaptive execution then splits skewed keys of the big side)."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, how)


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
