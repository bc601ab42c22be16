"""Byte-level BPE by a global distinct-word shuffle.

1. Every task pre-tokenises its texts in blocks of about ``BLOCK_CHARS`` characters. A block keeps, for each text,
   the positions as a sequence of local word numbers, and lists each distinct word (pre-token) once.
2. A block's words are dealt into buckets by their hash, shuffled and sorted by bucket, packed. All rows of a word stand
   together in one task, which holds the distinct words of one bucket at a time and encodes each once.
3. The ids go back by block, where they meet the block's texts and are set in by position.
4. Decoding joins ids with the table of token bytes by broadcast: it has the size of the vocabulary, and as ids are dense it is a list
   (:func:`decode` is the same join for arrays of ids that are given).

A word occurs once a block at most, so no word is hot: the commonest counts as often as there are blocks, and
blocks and buckets are dealt out by hashes. A block's key is a hash over its word list and its place in the input (partition and
number), so both sides of step 3 agree, other rows on a second reading are noticed, and each block is a group of its own
even if all lists are equal. Nothing is collected; a task holds one block.

Results for odd rows: a null or empty text has no ids (sha of no bytes); texts of any length are encoded whole (one
text may be a block larger than BLOCK_CHARS); repeated rows repeat; null keys are kept; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table, tune

BLOCK_CHARS = 6_000_000
#: Buckets of words for each shuffle partition.
BUCKETS = 8


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks by token bytes, and the pattern that splits texts, of a public tokenizer's rank file."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern or public_tokenizers.PATTERN


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Splitter:
    """Pre-tokens of a text by the tokenizer's pattern."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall

    def block(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words in order of appearance, all texts as numbers of words, and each text's words."""
        numbers = Numbers()
        number, found = numbers.__getitem__, []
        for text in texts:
            words = self.find(text or "")
            found.append(np.fromiter(map(number, words), np.uint32, len(words)))
        return list(numbers), np.concatenate(found), np.array([len(x) for x in found], np.uint32)


def blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(keys, texts) of about so many characters; cut within a batch, so that a block depends on its batch alone."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // chars
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(sizes)) + 1) if len(keys) else []:
            at, n = int(part[0]), len(part)
            yield keys.slice(at, n), texts.slice(at, n).to_pylist()


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of low to high bytes, compressed: small numbers take little room."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    return pack(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress("".join(words).encode(), 3)


def unpack_words(sizes: bytes, joined: bytes) -> list[str]:
    text, ends = zstandard.decompress(joined).decode(), np.cumsum(unpack(sizes)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def partition() -> int:
    """The number of the partition that this task reads."""
    return TaskContext.get().partitionId()


def layout(words: list[str], buckets: int, place: tuple[int, int]) -> tuple[int, np.ndarray]:
    """The block's key, from its word list and place in the input, and each word's bucket."""
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    h = xxhash.xxh3_64("".join(words).encode())
    h.update(sizes.tobytes())
    h.update(np.array(place, np.int64).tobytes())
    return h.intdigest() - (1 << 63), np.fromiter((crc32(w.encode()) % buckets for w in words), np.uint32, len(words))


def word_rows(docs: DataFrame, key: str, text_col: str, pattern: str, chars: int, buckets: int) -> DataFrame:
    """(block, bucket, sizes, words): the distinct words of each block by bucket, packed."""

    def emit(batches):
        split, own = Splitter(pattern), partition()
        for n, (_, texts) in enumerate(blocks(batches, chars)):
            words, _, _ = split.block(texts)
            block, bucket = layout(words, buckets, (own, n))
            order = np.argsort(bucket, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
            packed = [pack_words([words[i] for i in part.tolist()]) for part in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(parts), pa.int64()), pa.array([int(bucket[x[0]]) for x in parts], pa.int32()), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())],
                names=["block", "bucket", "sizes", "words"],
            )

    return docs.select(key, text_col).mapInArrow(emit, "block long, bucket int, sizes binary, words binary")


def text_rows(docs: DataFrame, key: str, text_col: str, pattern: str, chars: int, buckets: int) -> DataFrame:
    """(block, keys, counts, sequence, buckets): a block's texts as packed numbers of words, and the words' buckets."""

    def emit(batches):
        split, own = Splitter(pattern), partition()
        for n, (keys, texts) in enumerate(blocks(batches, chars)):
            words, sequence, counts = split.block(texts)
            block, bucket = layout(words, buckets, (own, n))
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            packed = [pa.array([pack(x)], pa.binary()) for x in (counts, sequence, bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), lists, *packed], names=["block", "keys", "counts", "sequence", "buckets"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(emit, f"block long, keys array<{kind}>, counts binary, sequence binary, buckets binary")


def encoded_rows(words: DataFrame, ranks) -> DataFrame:
    """(block, bucket, sizes, ids): the words' ids. Rows are dealt and sorted by bucket: a task remembers the words of one bucket
    at a time, and each distinct word is encoded once."""

    def emit(batches):
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        memo: dict[str, list[int]] = {}
        last = None
        for batch in batches:
            sizes, out = [], []
            for bucket, size, joined in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = []
                if bucket != last:
                    memo, last = {}, bucket
                for w in unpack_words(size, joined):
                    ids = memo.get(w)
                    if ids is None:
                        ids = memo[w] = own.encode_ordinary(w)
                    found.append(ids)
                sizes.append(pack(np.fromiter(map(len, found), np.uint32, len(found))))
                out.append(pack(np.fromiter(chain.from_iterable(found), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(out, pa.binary())], names=["block", "bucket", "sizes", "ids"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(emit, "block long, bucket int, sizes binary, ids binary")


def encode(docs: DataFrame, tokens_of, schema: str, key: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, chars: int = BLOCK_CHARS) -> DataFrame:
    """Applies ``tokens_of(keys, list of id arrays) -> list of columns`` to the encoded texts of each block.

    docs has to give the same rows when read twice (as files do); if it doesn't, this raises."""
    ranks, pattern = vocabulary(path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the size of the vocabulary
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = encoded_rows(word_rows(docs, key, text_col, pattern, chars, buckets), shared)
    texts = text_rows(docs, key, text_col, pattern, chars, buckets)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        other = ValueError("words and texts of a block don't match: the input gave other rows when read again")
        if left.num_rows != 1:
            raise other
        rows = dict(zip(right["bucket"].to_pylist(), zip(right["sizes"].to_pylist(), right["ids"].to_pylist())))
        bucket = unpack(left["buckets"][0].as_py())
        numbers = np.argsort(bucket, kind="stable")
        if set(rows) != set(np.unique(bucket).tolist()):
            raise other
        parts = [rows[b] for b in sorted(rows)]
        sizes = np.concatenate([np.zeros(0, np.int64), *[unpack(x).astype(np.int64) for x, _ in parts]])
        flat = np.concatenate([np.zeros(0, np.uint32), *[unpack(x) for _, x in parts]])
        if len(sizes) != len(numbers):
            raise other
        size_of, start_of = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        size_of[numbers], start_of[numbers] = sizes, np.cumsum(sizes) - sizes
        keys, encoded = [], []
        for row in left.to_batches():
            for own, counts, sequence in zip(row.column("keys"), row.column("counts").to_pylist(), row.column("sequence").to_pylist()):
                keys.append(own.values)
                for at in np.split(unpack(sequence), np.cumsum(unpack(counts))[:-1].astype(np.int64)):
                    size = size_of[at]
                    ends = np.cumsum(size)
                    # Token k of the text stands at its word's start plus its place in the word.
                    encoded.append(flat[np.repeat(start_of[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)])
        return pa.table(tokens_of(pa.concat_arrays(keys), encoded), names=names)

    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(assemble, schema)


def digests(docs: DataFrame, key: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text; the decoded bytes come from the ids alone."""
    ranks, _ = vocabulary(path, pattern)
    bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        bytes_of[i] = token
    lookup = docs.sparkSession.sparkContext.broadcast(([str(i).encode() for i in range(len(bytes_of))], bytes_of))

    def columns(keys, encoded):
        names, tokens = lookup.value
        ids = [x.tolist() for x in encoded]
        return [
            keys, pa.array(map(len, ids), pa.int64()),
            pa.array([hashlib.sha256(b",".join([names[i] for i in x])).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(b"".join([tokens[i] for i in x])).hexdigest() for x in ids], pa.string()),
        ]

    return encode(docs, columns, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", key, text_col, path, pattern, chars)


def decode(ids: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the column decoded (binary) to rows with arrays of ids, by a join with the token-byte table per array."""
    ranks, _ = vocabulary(path)
    rows = [(i, token) for token, i in ranks.items()]
    tokens = ids.sparkSession.createDataFrame(rows, "id int, token binary")
    by_id = tokens.agg(F.map_from_entries(F.collect_list(F.struct("id", "token"))).alias("_tokens"))  # one row, the size of the vocabulary
    return ids.join(F.broadcast(by_id)).withColumn("decoded", F.expr(f"aggregate({ids_col}, cast('' as binary), (a, i) -> a || _tokens[i])")).drop("_tokens")


def op6_word_shuffle_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_word_shuffle_bpe": op6_word_shuffle_bpe}
SQL: dict[str, str] = {}
