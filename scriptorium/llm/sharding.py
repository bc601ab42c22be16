"""K-d tree partitioning of documents into shards of near equal bytes, in DataFrame functions only.

A node of the tree is split along its widest metadata dimension at the distributed weighted median, until
a leaf is one shard. A dimension is a number in [0, 2**20): log size, source, language and arrival order,
each scaled over the whole table. The median is found on the coordinate ``dimension * 2**40 + hash of
(doc_id, text)``, so that ties along a dimension are split too. It is found digit by digit: each pass sums
the bytes by node and digit (partial sums, at most nodes x 4096 rows reach the driver), takes the digit in which
the wanted byte falls and refines that digit only. All nodes of a level go together, so the passes are few and
don't grow with the data. The texts are read once; the passes read a narrow table in the shared folder.

Law ``bytes``: the leaves' bytes differ by about the rows of one last digit.

Results for odd rows: a null text weighs 1 byte like an empty one and has the checksum of no bytes; null
metadata is a value of its own (the lowest); rows that agree in doc_id and text have one coordinate and stay in one
shard, with slots of their own; an empty table gives an empty result; other columns are ignored. Equal texts
under other ids may go to different shards: the law asks for equal bytes, and a group of copies may be a third of
all bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import table, written

DIMENSION_BITS, HASH_BITS, DIGIT_BITS = 20, 40, 12
SHARDS = 8
#: A shard's slots are numbered by buckets of about this many rows.
BUCKET_ROWS = 20_000


def scaled(value: Column, low: float, high: float) -> Column:
    top = (1 << DIMENSION_BITS) - 1
    return F.floor((value - F.lit(low)) / F.lit(max(high - low, 1e-9)) * top).cast("long")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot) for a number of shards, or for shards of about target_bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The hash of a category is its coordinate: a code that needs no pass over the values.
    named = [F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("double").alias(f"d{i + 2}") for i, c in enumerate(categories) if c in docs.columns]
    narrow = written(
        docs.select(
            F.col(key),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.log2(F.octet_length(text) + 1.0).alias("d0"),
            F.coalesce(F.col(key).cast("double"), F.lit(-1.0)).alias("d1"),
            *named,
            F.xxhash64(F.col(key), text).alias("tie"),
        ),
        "kd-rows",
    )
    dims = [f"d{i}" for i in range(len(named) + 2)]
    span = narrow.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = span["bytes"] or 0
    shards = shards or max(1, -(-total // max(1, target_bytes or total)))
    rows = narrow.select(
        key, "size", "text_crc32", *[scaled(F.col(d), span[f"lo_{d}"] or 0.0, span[f"hi_{d}"] or 0.0).alias(d) for d in dims],
        F.pmod(F.col("tie"), F.lit(1 << HASH_BITS)).alias("tie"),
    )
    tree = _grow(rows, dims, shards) if total else {}
    placed = rows.withColumn("shard", _walk(tree, dims, (0, shards)).cast("int"))
    return _slots(placed, key, max(1, (span["rows"] or 0) // shards // BUCKET_ROWS)).select(key, "size", "text_crc32", "shard", "slot")


def _coordinate(dim: str) -> Column:
    return F.shiftleft(F.col(dim), HASH_BITS) + F.col("tie")


def _walk(tree: dict, dims: list[str], node: tuple[int, int]) -> Column:
    """The first shard of the node a row is in; node: first shard and number of shards."""
    if node not in tree:
        return F.lit(node[0])
    dim, cut, left = tree[node]
    return F.when(_coordinate(dim) < F.lit(cut), _walk(tree, dims, (node[0], left))).otherwise(_walk(tree, dims, (node[0] + left, node[1] - left)))


def _grow(rows: DataFrame, dims: list[str], shards: int) -> dict[tuple[int, int], tuple[str, int, int]]:
    """The tree: node -> (dimension, first coordinate of the right side, shards of the left side)."""
    tree: dict = {}
    level = [(0, shards)]
    while level := [n for n in level if n[1] > 1]:
        node = _walk(tree, dims, (0, shards))
        widths = rows.groupBy(node.alias("node")).agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims])
        seen = {r["node"]: r for r in widths.collect()}  # one row a node
        open_nodes = {}
        for n in level:
            r = seen.get(n[0])
            if r is None:  # no rows at all: both sides are empty
                tree[n] = (dims[0], 0, n[1] // 2)
                continue
            dim = max(dims, key=lambda d: (r[d], d))
            open_nodes[n] = {"dim": dim, "left": n[1] // 2, "want": r["bytes"] * (n[1] // 2) / n[1], "below": 0, "prefix": 0, "bytes": r["bytes"]}
        for shift in range(DIMENSION_BITS + HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
            todo = {n: x for n, x in open_nodes.items() if "cut" not in x}
            if not todo:
                break
            digit = F.lit(None).cast("long")
            for n, x in todo.items():
                here = (node == F.lit(n[0])) & (F.shiftright(_coordinate(x["dim"]), shift + DIGIT_BITS) == F.lit(x["prefix"]))
                digit = F.when(here, F.shiftright(_coordinate(x["dim"]), shift)).otherwise(digit)
            sums = rows.select(node.alias("node"), digit.alias("digit"), "size").where("digit is not null").groupBy("node", "digit").agg(F.sum("size").alias("bytes"))
            by: dict = {}
            for r in sums.collect():  # at most 4096 a node
                by.setdefault(r["node"], []).append((r["digit"], r["bytes"]))
            for n, x in todo.items():
                for digit_value, size in sorted(by[n[0]]):
                    if x["below"] + size >= x["want"]:
                        break
                    x["below"] += size
                x["prefix"] = digit_value
                # The digit's rows go to the side that is nearer; a digit that hardly counts ends the search.
                if size <= max(1e-5 * x["bytes"], 1) or shift < DIGIT_BITS:
                    over = x["below"] + size - x["want"] < x["want"] - x["below"]
                    x["cut"] = (digit_value + over) << shift
        for n, x in open_nodes.items():
            tree[n] = (x["dim"], x["cut"], x["left"])
        level = [m for n in level for m in ((n[0], tree[n][2]), (n[0] + tree[n][2], n[1] - tree[n][2]))]
    return tree


def _slots(placed: DataFrame, key: str, buckets: int) -> DataFrame:
    """Gapless slots: rows are numbered within hash buckets of a shard, and the buckets' counts are summed up."""
    rows = placed.withColumn("bucket", F.pmod(F.col("tie"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "bucket").orderBy("tie", key)
    numbered = rows.withColumn("n", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("n") - 1).cast("long"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_kd_sharding": op7_kd_sharding}
SQL: dict[str, str] = {}
