"""Training-order materialisation of token sequences.

1. Texts are encoded and cut into sequences of ``LENGTH`` ids (two bytes each while the vocabulary allows, little endian, the last one
   of a text filled up with the first id after the vocabulary), and written to the shared folder.
2. A sequence's index is its row in that table: its place in its file plus the rows of the files before (one number a file).
3. A keyed Feistel network over the next power of four permutes the indices; an index that leaves the range walks its cycle until it
   is back. That gives every sequence one global slot, without a sort and without state.
4. Slots are range partitioned by bounds that are known beforehand: shard ``slot // SHARD_ROWS``, whole shards to a task, rows in slot order, records of a fixed stride. A reader finds slot s at
   row ``s % SHARD_ROWS`` of its shard and can resume anywhere (:func:`read_from`). :func:`write_raw` writes the
   same records as bare bytes.

The order depends on the seed and on the table's files, which follow the input's splits. Slots are spread evenly whatever the
documents are, so no shard is hot. A task holds one Arrow batch and the ids of one text.

Results for odd rows: a null or empty text has no sequence; very long texts have as many sequences as they need; null keys are kept;
repeated rows give sequences of their own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.llm.bpe import vocabulary
from scriptorium.llm.common import ROW_GROUP, dropped, join_sized, new_dir, pieces, table, tune, written

LENGTH, SHARD_ROWS, ROUNDS, SEED = 512, 16_384, 6, 20_240_101
#: Characters that are encoded at once.
PIECE_CHARS = 1_000_000


def feistel(index: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """A keyed permutation of 0..n-1, applied to indices."""
    half = 1
    while 1 << 2 * half < n:
        half += 1
    mask, todo = np.uint64((1 << half) - 1), np.arange(len(index))
    out = index.astype(np.uint64)
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for r in range(ROUNDS):
                x = (right + np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
            out[todo] = left << np.uint64(half) | right
            todo = todo[out[todo] >= n]  # cycle walking
    return out.astype(np.int64)


def sequences(docs: DataFrame, key: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, seq_no, n_tokens, record): the texts' ids in records of one stride."""
    ranks, pattern = vocabulary(path, pattern)
    pad = max(ranks.values(), default=-1) + 1
    kind = "<u2" if pad < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the size of the vocabulary

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in pieces(batches, 1, PIECE_CHARS):
            rows, numbers, counts, records = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = own.encode_ordinary(text or "")
                ids = np.fromiter(found, kind, len(found))
                n = -(-len(ids) // length)
                raw = np.concatenate([ids, np.full(n * length - len(ids), pad, kind)]).astype(kind).tobytes()
                stride = length * ids.itemsize
                rows += [i] * n
                numbers += range(n)
                counts += [min(length, len(ids) - k * length) for k in range(n)]
                records += [raw[k * stride : (k + 1) * stride] for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(records, pa.binary())], names=[key, "seq_no", "n_tokens", "record"])

    return docs.select(key, text_col).mapInArrow(emit, f"{key} {docs.schema[key].dataType.simpleString()}, seq_no int, n_tokens int, record binary")


def with_slots(table_of_sequences: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds the global slot to a written table."""
    rows = table_of_sequences.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    files = rows.groupBy("_file").count()
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = written(files.select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), "count"), "order-files")
    n = starts.agg(F.sum("count")).first()[0] or 0
    placed = join_sized(rows, starts.drop("count"), ["_file"], "inner").withColumn("slot", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pa.array(feistel(batch.column("slot").to_numpy(), n, seed))
            yield batch.set_column(batch.schema.get_field_index("slot"), "slot", slots)

    return placed.mapInArrow(permute, placed.schema)


def write_shards(docs: DataFrame, path: str, shard_rows: int = SHARD_ROWS, seed: int = SEED, **options) -> StructType:
    """Writes the sequences in training order, one file a shard, rows in slot order; the shards' schema."""
    rows = written(sequences(docs, **options), "order-sequences")
    slots = with_slots(rows, seed)
    shards = slots.withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("long"))
    # Ranges of whole shards: slots are dense, so the bounds need no sample.
    last = rows.count() - 1
    parts = min(max(1, last // shard_rows + 1), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor(F.col("shard") * parts / (max(0, last) // shard_rows + 1)).cast("int")
    shards.repartitionById(parts, part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    dropped(rows)
    return shards.schema


def read_from(spark: SparkSession, path: str, schema: StructType, slot: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The sequences from a slot on; shards before it aren't opened."""
    return spark.read.schema(schema).parquet(path).where((F.col("shard") >= slot // shard_rows) & (F.col("slot") >= slot))


def write_raw(spark: SparkSession, shards: str, path: str) -> None:
    """Writes the shards' records as bare bytes, each ended by one newline byte: slot s stands at
    ``(s % shard_rows) * (stride + 1)`` of its shard's file."""
    rows = spark.read.parquet(shards).repartition("shard").sortWithinPartitions("shard", "slot")
    rows.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    path = new_dir(spark, "order-shards")
    docs = table(spark, sf_dir, "documents")
    rows = read_from(spark, path, write_shards(docs, path))
    return rows.select("slot", F.col("shard").cast("long").alias("shard"), F.pmod("slot", F.lit(SHARD_ROWS)).cast("int").alias("shard_row"), "doc_id", "seq_no", "n_tokens", F.length("record").alias("stride"), F.sha2("record", 256).alias("record_sha256"))


QUERIES = {"op4_training_order": op4_training_order}
SQL: dict[str, str] = {}
