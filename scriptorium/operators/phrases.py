"""Runs of words that occur once in the corpus, by packed stretches.

1. Every run of n words belongs to one bucket: by that of its pairs of adjacent words with the least hash, so that neighbouring runs mostly share theirs. Pairs that are
   frequent (by the counts of slots of a sketch of fixed size) lead no run; a run of frequent pairs only goes by the hash of the whole run. So no pair, however common,
   fills a bucket.
2. Consecutive runs of one bucket travel as one stretch of text, about 2.5 words a run instead of n. A task drops the stretches that it has
   already seen, keeping those met twice apart, and packs the others by bucket.
3. A bucket holds all copies of its runs. It numbers words, then runs, exactly (no hash decides), and gives out those that it has once.

A bucket has about BUCKET_RUNS runs, whatever the size of the input; the driver sees the sketch alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of a bucket, slots of the sketch of pairs, and those of one row of it.
BUCKET_RUNS, SLOTS, SLOT_BLOCK = 1 << 19, 1 << 16, 1 << 12
#: Characters that are worked on at once, rows given out at once, and words a task remembers the hashes of.
PIECE_CHARS, ROWS, MEMO = 8_000_000, 50_000, 200_000
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        return h


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts in parts of about PIECE_CHARS characters, across batches (one text may be longer)."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (size + np.cumsum(sizes) - sizes) // PIECE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.column(0).slice(a, b - a))
            size += int(sizes[a:b].sum())
            if size >= PIECE_CHARS:
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def split(texts: pa.Array, memo: WordHashes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(word, hash, text) of all words, which stand between spaces and line ends."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    words, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, text = words.filter(full), text.filter(full).to_numpy()
    kinds = words.dictionary_encode()
    hashes = np.fromiter(map(memo.__getitem__, kinds.dictionary.to_pylist()), np.uint64, len(kinds.dictionary))
    if len(memo) > MEMO:
        memo.clear()
    return words, hashes[kinds.indices.to_numpy()], text


def pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next."""
    return mix(hashes[:-1] * np.uint64(0x100000001B3) + hashes[1:])


def run_starts(text: np.ndarray, n: int) -> np.ndarray:
    """The places at which n words of one text begin."""
    if len(text) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])


def sketched(texts: DataFrame) -> np.ndarray:
    """How many pairs each of SLOTS slots has."""
    kinds = "block int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(SLOTS, np.int64), WordHashes()
        for part in pieces(batches):
            _, hashes, text = split(part, memo)
            total += np.bincount((pairs(hashes)[run_starts(text, 2)] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
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
    for row in texts.mapInArrow(count, kinds).groupBy("block").applyInArrow(add, kinds).collect():  # SLOTS numbers at most
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def buckets_of(hashes: np.ndarray, starts: np.ndarray, n: int, often: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each run of n words, which its words alone decide."""
    led = np.full(len(starts), LAST)
    if n > 1 and len(starts):
        value = pairs(hashes)
        value[often[(value % np.uint64(SLOTS)).astype(np.int64)]] = LAST
        for k in range(n - 1):
            led = np.minimum(led, value[starts + k])
    alone = np.flatnonzero(led == LAST)
    whole = np.zeros(len(alone), np.uint64)
    for k in range(n):
        whole = mix(whole * np.uint64(0x100000001B3) + hashes[starts[alone] + k])
    led[alone] = whole
    return (mix(led) % np.uint64(buckets)).astype(np.int64)


def joined(words: pa.Array, begin: np.ndarray, length: np.ndarray, between: str) -> pa.Array:
    """Stretches of an array of strings, each as one string."""
    ends = np.cumsum(length)
    at = np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words.take(pa.array(at))), between)


def packed(texts: DataFrame, n: int, often: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, again, size, stretches): the distinct stretches of a part of the texts, those met several times apart."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in pieces(batches):
            words, hashes, text = split(part, memo)
            starts = run_starts(text, n)
            if not len(starts):
                continue
            bucket = buckets_of(hashes, starts, n, often, buckets)
            new = np.append(True, (np.diff(starts) != 1) | (np.diff(bucket) != 0))
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(starts))) + n - 1
            kinds = joined(words, starts[first], length, " ").dictionary_encode()
            _, at, times = np.unique(kinds.indices.to_numpy(), return_index=True, return_counts=True)
            group = bucket[first][at] * 2 + (times > 1)
            order = np.argsort(group, kind="stable")
            group = group[order]
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(group) != 0)), len(group))
            blocks = joined(kinds.dictionary.take(pa.array(order)), cuts[:-1], np.diff(cuts), "\n")
            raw = [x.as_buffer() for x in blocks.cast(pa.binary())]
            name = group[cuts[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name // 2, pa.int32()), pa.array(name % 2 == 1), pa.array([x.size for x in raw], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())],
                names=["bucket", "again", "size", "stretches"],
            )

    return texts.mapInArrow(emit, "bucket int, again boolean, size int, stretches binary")


def unique_phrases(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Runs of n words that occur once in the corpus; words are in lower case and stand between spaces and line ends."""

    def judge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, again = [], []
        for batch in batches:
            for flag, size, data in zip(*[batch.column(c).to_pylist() for c in ("again", "size", "stretches")]):
                block = pc.list_flatten(pc.split_pattern(pa.array([pa.decompress(data, size, "zstd", asbytes=True).decode()]), "\n"))
                blocks.append(block)
                again.append(np.full(len(block), flag))
        lists = pc.split_pattern(pa.concat_arrays(blocks), " ")
        words, stretch = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        kinds = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        starts = run_starts(stretch, n)
        run = kinds[starts]
        for k in range(1, n):
            run = np.unique(run << 32 | kinds[starts + k], return_inverse=True)[1]
        once = starts[(np.bincount(run)[run] == 1) & ~np.concatenate(again)[stretch[starts]]]
        for at in range(0, len(once), ROWS):
            part = once[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([joined(words, part, np.full(len(part), n), " ")], names=["phrase"])

    texts = docs.select(F.lower(text).alias("text"))
    counts = sketched(texts)
    buckets = max(1, int(counts.sum()) // BUCKET_RUNS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = counts > max(1, int(counts.sum())) // (4 * buckets)
    return packed(texts, n, often, buckets).groupBy("bucket").applyInArrow(judge, "phrase string")
