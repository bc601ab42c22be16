"""Near-duplicate classes by BagMinHash over word shingles.

A document is the bag (multiset) of its runs of ``SHINGLE`` words, in lower case, split at white space; two documents are near
duplicates if their bags' weighted Jaccard similarity is at least ``SIMILARITY``. A class is a connected component of these links.

1. Signatures. The weights (counts) are discretised into unit levels. Every dyadic interval of levels [0,1), [1,2), [2,4), ... of a
   shingle carries a Poisson process with the interval's width as rate; a point falls into one of ``M`` components and, by the low bits of a
   hash (as many as halve the interval down to one level), onto a level of its interval. It counts if the weight reaches that level.
   Component k's value is the first counting point, so two bags agree on k with the probability of their weighted Jaccard
   similarity. Only points before a time that leaves no component empty (as a rule) are generated, so a signature costs one draw a
   shingle and about M log M points.
2. Exact copies (equal word sequences) become one node, by a hash with partial aggregation.
3. Bands. ``ROWS`` components form a bucket key, ``BANDS`` times; nodes with a common bucket are candidates. At similarity 0.8 a link is
   missed with a probability of (1 - 0.8**4)**24 = 3e-6.
4. Verification by hubs. In every bucket the first node (the hub, found by a ``min`` aggregate) meets the others by the overlap of their
   bags (sets of 32-bit hashes; two different elements agree with a probability of 2**-32). Verified links are contracted to components;
   hubs go, and so do buckets whose nodes are all of one component. The first round's join makes at most one row for each (bucket, node), the
   second's at most ``HUBS``: there a bucket has ``HUBS`` hubs, and one of no more nodes is done with, as all its pairs meet.
   A large group of copies falls into one component after a round or two.
5. What is left after ``HUB_ROUNDS`` rounds are nodes that share buckets without being alike, as texts around a common passage.
   Their links are found by the prefix filter: two similar bags share one of the rarest elements of each (by the counts of slots of a
   sketch of fixed size, which only bears on the work, not on the result; the prefix is as long as the threshold leaves free), so the bags are dealt anew by these elements
   and the rounds go on. Bounds by position in the prefix, by size and by class counts keep pairs that can't be similar out of the join's
   output. A round then has as many hubs a bucket (one for each slot of a hash, or every node of a bucket that has no more nodes) as
   ``MEETINGS`` allows for all its rows, and four times the last round's at least, so every pair of different components meets and no link is lost.
   Usually that is one round: what a round costs is its shuffles, since few rows are left by then.
6. Components by least labels with pointer jumping; every round is written to the shared folder, and its tables are removed when the next
   one is written. Tables of at most BROADCAST_ROWS rows are broadcast there, larger ones shuffled.

Bags are counted by ``CLASSES`` classes of elements, without those that no other node of a bucket over ``CROWD`` nodes has. Two nodes share at
most the sum of the lesser counts. The node with the fewest elements of its own, the middle of its group, is the first hub. Nothing grows on the
driver; hot buckets and hubs are only join keys of narrow rows, which partial aggregation and adaptive skew joins split.

Results for odd rows: a null or empty text, or one of spaces only, is the empty bag; all empty bags are one class; a text of fewer than SHINGLE words has
one shingle, the whole; very long texts are read whole; repeated rows repeat with one class; a null key takes part but never names a class unless all its keys are null (then
the class is null); an empty table gives an empty result; other columns pass through :func:`keep_first`, which keeps one row
of each class: that with the least key, of rows that repeat this key that with the least hash of its text, of equal rows one; rows with a null key
all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import BROADCAST_ROWS, dropped, join_sized, pieces, table, tune, written

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 24
M = ROWS * BANDS
#: Nodes of a bucket from which on their own shingles are counted.
CROWD = 4
#: Classes of shingles that bags are counted by.
CLASSES = 16
#: Rounds of hubs before the bags left are dealt by their rarest elements.
HUB_ROUNDS = 2
#: Hubs of a bucket in those after the first.
HUBS = 16
#: Times that rows are held against a hub in one round after those: so many a row, or so many in all if that is more.
MEETINGS, ALL_MEETINGS = 64, 1 << 23
#: Slots of the sketch that orders elements by frequency, and those of one row of it.
SLOTS, SLOT_BLOCK = 1 << 18, 1 << 12
#: Bits of the filter that keeps the bags of other nodes out of a round's shuffle.
FILTER_BITS = 1 << 23
#: Words a task remembers the hashes of; beyond that it starts anew.
MEMO = 200_000
#: Characters that are worked on at once.
PIECE_CHARS = 1_000_000
G, P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
LEAST_KEY = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def bags(texts: list[str | None], memo: WordHashes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's content hash, and (text, shingle hash, count) of all bags, ordered."""
    nodes, ids = [], []
    for text in texts:
        words = (text or "").lower().split()
        nodes.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
        ids.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
        if len(memo) > MEMO:
            memo.clear()
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *ids])
    if len(flat) >= SHINGLE:
        h = flat[: len(flat) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            h = h * P + flat[k : len(flat) - SHINGLE + 1 + k]
    else:
        h = np.zeros(0, np.uint64)
    doc, ends = np.repeat(np.arange(len(ids)), sizes), np.cumsum(sizes)
    whole = np.arange(len(h)) + SHINGLE <= ends[doc[: len(h)]]
    doc, h = doc[: len(h)][whole], mix(h[whole])
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        own = np.array([np.uint64(xxhash.xxh3_64_intdigest(ids[i].tobytes())) for i in short], np.uint64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, own])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return nodes, doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(n: int, doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """BagMinHash signatures (n x M, 32 bits) of n bags."""
    with np.errstate(over="ignore"):
        # A process for each dyadic interval that starts below the count: exponent 0 is [0,1), a > 0 is [2**(a-1), 2**a).
        deep = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1, 1)
        row = np.repeat(np.arange(len(h)), deep)
        a = np.arange(len(row)) - np.repeat(np.cumsum(deep) - deep, deep)
        low = np.where(a > 0, 1 << np.maximum(a - 1, 0), 0)
        rate = np.where(a > 0, low, 1).astype(np.float64)
        seed, owner, weight = mix(h[row] + (a.astype(np.uint64) + np.uint64(1)) * G), doc[row], count[row]
        total = np.bincount(owner, weights=rate, minlength=n)
        best = np.full((n, M), np.inf)
        limit, done = M * (np.log(M) + 4) / np.maximum(total, 1), total == 0
        while not done.all():
            active = np.flatnonzero(~done[owner])
            time, step = np.zeros(len(active)), 0
            flat = best.reshape(-1)
            while len(active):
                step += 1
                draw = mix(seed[active] + np.uint64(step) * G)
                time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[active]
                live = time <= limit[owner[active]]
                active, time, draw = active[live], time[live], draw[live]
                if not len(active):
                    break
                spot = mix(draw ^ G)
                component = (spot % np.uint64(M)).astype(np.int64)
                # The level: rates are powers of two, so the low bits of a second draw halve the interval down to one level.
                level = low[active] + (mix(spot) % rate[active].astype(np.uint64)).astype(np.int64)
                counts = level < weight[active]
                np.minimum.at(flat, owner[active[counts]] * M + component[counts], time[counts])
            done = done | np.isfinite(best).all(axis=1)
            limit = np.where(done, limit, limit * 2)
        bits = mix(best.view(np.uint64))
    return (bits >> np.uint64(32)).astype(np.uint32)


def expanded(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A bag as a sorted set: the j-th occurrence of a shingle is an element of its own."""
    row = np.repeat(np.arange(len(h)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort((mix(h[row] + j.astype(np.uint64) * G) >> np.uint64(32)).astype(np.uint32))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two expanded bags (1 for two empty ones)."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def buckets_of(sigs: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of each signature."""
    rows = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * G, rows.shape[:2])
        for r in range(ROWS):
            keys = mix(keys + rows[:, :, r] + G)
    return keys.view(np.int64)


def sketches(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(k, t, node, size, buckets, bag) of each row, in the shared folder. k: the key with null as LEAST_KEY; t: a hash of the text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in pieces(batches, 2, PIECE_CHARS):
            nodes, doc, h, count = bags(part.column(2).to_pylist(), memo)
            n = part.num_rows
            keys = buckets_of(signatures(n, doc, h, count))
            cuts = np.searchsorted(doc, np.arange(n + 1))
            sets = [expanded(h[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), lists, pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["k", "t", "node", "size", "buckets", "bag"],
            )

    rows = docs.select(*identity(key, text_col), text_col)
    return written(rows.mapInArrow(emit, "k long, t long, node binary, size long, buckets array<long>, bag binary"), "neardup-sketches")


def identity(key: str, text_col: str) -> list[Column]:
    """The columns k and t of a row."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(LEAST_KEY)).alias("k"), F.xxhash64(text_col).alias("t")]


def exploded(sets: DataFrame) -> DataFrame:
    """(element, node): the elements of the bags."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bag in enumerate(batch.column(0).to_pylist()):
                elements = np.frombuffer(bag, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(elements), batch.column(1).take(pa.array(np.full(len(elements), i)))], names=["element", "node"])

    return sets.select("bag", "node").mapInArrow(emit, "element int, node binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many elements of its bag, by class, no other of the nodes has."""
    alone = exploded(sets).groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    kind = F.pmod("element", F.lit(CLASSES))
    return written(alone.groupBy("node").agg(F.array(*[F.sum((kind == c).cast("int")).cast("int") for c in range(CLASSES)]).alias("own")), "neardup-own")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How often the elements of each of SLOTS slots occur: a sketch of the elements' frequencies, of a fixed size."""
    kinds = "block int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(slot_of(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)), minlength=SLOTS)
        rows = total.reshape(-1, SLOT_BLOCK)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOT_BLOCK, np.int64)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                total += np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.int64)
    for row in sets.select("bag").mapInArrow(count, kinds).groupBy("block").applyInArrow(add, kinds).collect():  # SLOTS numbers at most
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def slot_of(elements: np.ndarray) -> np.ndarray:
    return (mix(elements.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def prefixes(sets: DataFrame, often: np.ndarray, least: float) -> DataFrame:
    """(bucket, node, root, before): the elements that two similar bags share one of. They are the first of each bag in one order of all elements, by the
    count of their slot, then by their number; before: the element's place. Any such order finds all links; one by frequency makes few rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bag in enumerate(batch.column(0).to_pylist()):
                elements = np.frombuffer(bag, np.uint32)
                free = len(elements) - int(np.ceil(least * len(elements) - 1e-9))
                first = elements[np.lexsort((elements, often[slot_of(elements)]))[: free + 1]]
                at = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), *[c.take(at) for c in batch.columns[1:]], pa.array(np.arange(len(first)))], names=["bucket", "node", "root", "before"])

    return sets.select("bag", "node", "root").mapInArrow(emit, "bucket long, node binary, root binary, before long")


def rarest(state: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(bucket, node, place, size, most, counts, before): the nodes by the elements of their prefix, those that several components have."""
    nodes = written(state.select("node", "root", "place", "size", "most", "counts").dropDuplicates(["node"]), "neardup-crowd")
    bags = written(sets.select("node", "bag").join(nodes.select("node", "root"), "node"), "neardup-crowd-bags")
    first = written(prefixes(bags, slot_counts(bags), least), "neardup-elements")
    dropped(bags)
    several = first.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    rows = written(first.join(several, "bucket").drop("root").join(nodes.drop("root"), "node"), "neardup-prefixes")
    dropped(first, nodes)
    # A node stays in a bucket if it could share enough with the smallest and with the least advanced of it.
    best = rows.groupBy("bucket").agg(F.min("size").alias("smallest"), F.max(F.col("size") - F.col("before")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    may = F.least(F.col("size") - F.col("before"), F.col("best")) >= least / (1 + least) * (F.col("size") + F.greatest(F.col("smallest"), least * F.col("size"))) - 1e-6
    out = written(rows.join(best, "bucket").where(may).select("bucket", "node", "place", "size", "most", "counts", "before"), "neardup-buckets")
    dropped(rows)
    return out


def counted(sets: DataFrame) -> DataFrame:
    """(node, size, counts): the elements of each bag by class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(np.frombuffer(bag, np.uint32) % CLASSES, minlength=CLASSES) for bag in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.list_(pa.int32()))], names=["node", "size", "counts"])

    return sets.select("node", "size", "bag").mapInArrow(emit, "node binary, size long, counts array<int>")


def bags_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, bag) of the pairs' nodes, and of few others: bags that no pair needs are left out before anything is shuffled.

    Few nodes are broadcast; of many a bitmap of FILTER_BITS is, which lets some others through."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return sets.join(F.broadcast(ends), "node", "left_semi").select("node", "bag")
    slot = f"pmod(xxhash64(node), {FILTER_BITS})"
    words = ends.groupBy(F.expr(f"{slot} div 64").alias("id")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int)))").alias("bits"))
    every = ends.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    bitmap = every.agg(F.array_sort(F.collect_list("w"))["bits"].alias("_bits"))  # one row
    met = F.expr(f"(shiftright(get(_bits, cast({slot} div 64 as int)), cast({slot} % 64 as int)) & 1L) = 1")
    return sets.join(F.broadcast(bitmap), met, "left_semi").select("node", "bag")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b, ...), which are read twice, whose bags overlap enough."""
    kept, sets = pairs.schema, bags_of(pairs, sets)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist())]
            yield batch.select(kept.names).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select(*kept.names, "bag_a", "bag_b").mapInArrow(check, kept)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of the links (a, b), by least labels with pointer jumping."""
    both = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-links")
    # No table here has more rows than this one.
    small = F.broadcast if both.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    labels = base = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "neardup-labels")
    while True:
        lowest = both.join(small(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = labels.join(small(lowest), "node").select("node", F.least("root", "low").alias("next"), "root")
        onward = labels.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        moved = written(hooked.join(small(onward), "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("next"), "root"), "neardup-labels")
        dropped(base)
        base, labels = moved, moved.select("node", F.col("next").alias("root"))
        if moved.where("next <> root").limit(1).count() == 0:
            dropped(both)
            return labels


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels (node, root) after some roots, and nodes that had no label, were merged."""
    onward = merged.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = join_sized(labels, onward, ["root"]).select("node", F.coalesce("next", "root").alias("root"))
    return written(moved.unionAll(join_sized(merged, labels, ["node"], "left_anti").select("node", "root")), "neardup-labels")


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components, with their root and the bucket's number of rows (n)."""
    if labels is None:
        state = rows.withColumn("root", F.col("node"))
    else:
        state = written(join_sized(rows, labels, ["node"]).withColumn("root", F.coalesce("root", "node")), "neardup-rooted")
    several = state.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("bucket", "n")
    out = written(join_sized(state, several, ["bucket"], "inner"), "neardup-state")
    dropped(state, rows)
    return out


def crowding(state: DataFrame) -> tuple[int, int]:
    """The rows of the largest bucket (0 if there is none), and how many hubs a bucket may have in one round."""
    steps = [4**k for k in range(11)]
    row = state.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("largest"), *[F.sum(F.least("n", F.lit(s))).alias(f"s{s}") for s in steps]).first()
    most = max(MEETINGS * row["rows"], ALL_MEETINGS)
    return row["largest"] or 0, max(s for s in steps if (row[f"s{s}"] or 0) <= most)


def meet(state: DataFrame, slots: int, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Lets the hubs of each bucket (one for each slot of a hash; all nodes, if they are no more than slots) meet its other nodes: the links that
    hold, and the rows that are left."""
    first = F.min(F.struct("place", "node", "root", "size", "counts", "before")).alias("h")
    whole = F.col("n") <= slots
    slot = F.when(whole, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(slots)).cast("string").cast("binary")).alias("slot")
    hubs = written(state.groupBy("bucket", slot).agg(first).select("bucket", "h.*").select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "counts", "before")]), "neardup-hubs")
    # What two similar bags share at least; what they share at most from their first shared element on, and by class counts.
    need = F.lit(least / (1 + least)) * (F.col("size") + F.col("size_a")) - 1e-6
    rest = F.least(F.col("size") - F.col("before"), F.col("size_a") - F.col("before_a"))
    shared = sum((F.least(F.col("counts")[c], F.col("counts_a")[c]) for c in range(CLASSES)), F.lit(0))
    may = (F.col("root") != F.col("root_a")) & (~whole | (F.col("node") > F.col("node_a"))) & (rest >= need) & (shared >= need)
    few = hubs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = state.join(F.broadcast(hubs) if few else hubs, (state["bucket"] == hubs["bucket"]) & may)
    turned = F.col("node") > F.col("node_a")
    end = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    pairs = written(both.select(end("node_a", "node").alias("a"), end("node", "node_a").alias("b"), end("root_a", "root").alias("root_a"), end("root", "root_a").alias("root_b")).distinct(), "neardup-pairs")
    found = written(similar(pairs, sets, least), "neardup-found")
    dropped(pairs)
    left = written(join_sized(state.drop("root", "n"), hubs.select("bucket", F.col("node_a").alias("node")), ["bucket", "node"], "left_anti"), "neardup-buckets")
    dropped(hubs)
    return found, left


def rooted(docs: DataFrame, key: str, text_col: str, least: float) -> DataFrame:
    """(k, t, root): each row's key, hash of its text, and the component it is in."""
    sketch = sketches(docs, key, text_col)
    nodes = written(sketch.groupBy("node").agg(F.min("k").alias("k"), F.first("size").alias("size"), F.first("buckets").alias("buckets")), "neardup-nodes")
    bands = nodes.where("size > 0").select("node", F.explode("buckets").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", (F.col("n") > CROWD).alias("crowd"))
    # Shuffled at any size: the buckets grow with the nodes.
    candidates = written(bands.join(shared.hint("merge"), "bucket"), "neardup-candidates")
    # The bags of candidates only, one row a node.
    wanted = candidates.groupBy("node").agg(F.max("crowd").alias("crowd")).join(nodes.select("node", "k"), "node")
    sets = written(join_sized(sketch.select("node", "k", "size", "bag"), wanted, ["node", "k"], "inner").dropDuplicates(["node"]), "neardup-bags")
    # Only the names of the rows are needed from here on.
    names = written(sketch.select("k", "t", "node"), "neardup-rows")
    dropped(sketch, nodes)
    own = own_shingles(sets.where("crowd"))
    sizes = counted(sets).join(own, "node", "left")
    # place: the order of hubs in a bucket; counts: what the node can share with another of the bucket, by class.
    less = F.when(F.col("crowd") & F.col("own").isNotNull(), F.zip_with("counts", "own", lambda a, b: a - b)).otherwise(F.col("counts"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    counts = candidates.join(sizes, "node").select("bucket", "node", "size", less.alias("counts")).withColumn("most", total("counts"))
    rows = written(counts.select("bucket", "node", F.struct((F.col("size") - F.col("most")).alias("own"), "node").alias("place"), "size", "most", "counts", F.lit(0).cast("long").alias("before")), "neardup-buckets")
    dropped(candidates, own)
    # A node that can't share enough with the smallest of its bucket shares enough with none.
    smallest = rows.groupBy("bucket").agg(F.min("size").alias("smallest"))
    rest = rows.join(smallest, "bucket").where(F.col("most") >= least * (F.col("size") + F.greatest("smallest", "most") - F.col("most"))).drop("smallest")
    labels, turn, slots = None, 0, 1
    while True:
        state = labelled(rest, labels)
        dropped(rows)
        largest, afforded = crowding(state)
        if largest and turn == HUB_ROUNDS:
            rest = rarest(state, sets, least)
            dropped(state)
            state = labelled(rest, labels)
            largest, afforded = crowding(state)
        if not largest:
            dropped(state)
            break
        if turn >= HUB_ROUNDS:
            slots = max(afforded, slots * 4)
        found, rest = meet(state, slots, sets, least)
        dropped(state)
        if found.limit(1).count():
            merged = components(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
            labels = merged if labels is None else relabelled(labels, merged)
        dropped(found)
        if largest <= slots:
            dropped(rest)
            break
        turn += 1
        if turn < HUB_ROUNDS:
            slots = HUBS
    dropped(sets)
    if labels is None:
        labels = names.select("node", F.col("node").alias("root")).limit(0)
    # Written, so that later joins read plain exchanges, of which adaptive execution can split those of a large class.
    rows = written(names.join(labels, "node", "left").select("k", "t", F.coalesce("root", "node").alias("root")), "neardup-roots")
    dropped(names)
    return rows


def classes(docs: DataFrame, key: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, class_id): the least key of each document's class."""
    rows = rooted(docs, key, text_col, least)
    # The sentinel of null keys is left out unless there is no other key.
    names = written(rows.groupBy("root").agg(F.min(F.when(F.col("k") != LEAST_KEY, F.col("k"))).alias("class_id")), "neardup-names")
    return rows.join(names, "root").select(F.when(F.col("k") != LEAST_KEY, F.col("k")).alias(key), "class_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: that with the least key. Rows with a null key stay."""
    rows = rooted(docs, key, text_col, least)
    place = F.struct(F.col("k") == LEAST_KEY, "k", "t")
    names = written(rows.groupBy("root").agg(F.min(place).alias("first")), "neardup-names")
    decided = written(rows.join(names, "root").groupBy("k", "t").agg(F.min((place == F.col("first")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n")), "neardup-decided")
    others = decided.where((F.col("stays") == 0) & (F.col("k") != LEAST_KEY)).select(F.col("k").alias("_k"), F.col("t").alias("_t"))
    twice = decided.where((F.col("stays") == 1) & (F.col("n") > 1) & (F.col("k") != LEAST_KEY)).select(F.col("k").alias("_k"), F.col("t").alias("_t"))
    k, t = identity(key, text_col)
    named = docs.select(k.alias("_k"), t.alias("_t"), F.struct(*docs.columns).alias("_row"))
    kept = join_sized(named, others, ["_k", "_t"], "left_anti")
    if twice.limit(1).count():
        once = join_sized(kept, twice, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"])
        kept = join_sized(kept, twice, ["_k", "_t"], "left_anti").unionAll(once)
    return kept.select("_row.*")


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bagminhash": op1_bagminhash}
SQL: dict[str, str] = {}
