"""Ranked lexical search by Block-Max WAND over an index that is partitioned by documents.

Index. A task gathers documents up to about SEGMENT_CHARS characters into a segment, documents by ascending id. Each term of a segment
has its postings in blocks of BLOCK, as gaps and occurrences in variable bytes. A block's row holds, beside these bytes, its first and last document and
the skyline of its (occurrences, document length) pairs: the pairs that no other one beats in both. An impact rises with the occurrences and
falls with the length, so the largest impact of a block is that of a skyline pair, exactly, whatever the collection's size and mean length come to
be. A segment's row for the term "" lists its documents and their lengths.

Search. The items' terms meet the index by term, so a search reads only the blocks of its terms; the numbers of documents and tokens and the terms' document
frequencies are sums over the block rows, without their bytes. Blocks are dealt by segment, segments pass a task one after another, and every item keeps
its best documents from one to the next. In a segment, an item's lists are moved by block bounds alone (shallow moves): the bounds of all lists divide the
documents into stretches, the sum of the largest impacts over a stretch is what a document of it can reach, and stretches that stay below the item's
threshold are passed by with their blocks still packed. The stretch with the highest sum comes first, so that the threshold is high from the start. In the
live stretches the lists are taken by falling bound; once what the lists left may add stays below the threshold, only documents that have been met are pivots, and a list's
blocks are unpacked only where a pivot can still pass. Tasks give k rows an item, the best k of which remain.

Scale. Postings aren't shuffled one by one: blocks are made where the texts are read. A segment is bounded in characters (or is one
document), so no term, source or group of copies is hot; items are asked in batches of about BATCH_TERMS terms, each of which
reads the index once. No posting list is cut short.

Results for odd rows: a null or empty text and one without terms has no postings and counts nowhere; an item without terms, or whose terms nothing holds, has no
rows; repeated documents are documents of their own; items repeated in id and text are asked once, items with one id and several texts once a text;
null ids are kept and rank last among equal scores; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import dropped, join_sized, table, tune, written

SEGMENT_CHARS, BLOCK, BATCH_TERMS, TASK_SEGMENTS, TOP = 16_000_000, 128, 100_000, 64, 10
#: Terms are runs of digits, letters of ASCII (lower-cased) and bytes beyond ASCII; all else separates them.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX_SCHEMA = "segment long, term string, first int, last int, postings int, tokens long, tops array<int>, packed binary"
LAST_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def var_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in groups of seven bits, low ones first, the last one below 128; and where each value ends."""
    width = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        own = width > k
        out[ends[own] - width[own] + k] = (values[own] >> 7 * k & 127) | np.where(width[own] > k + 1, 128, 0)
    return out, ends


def from_var_bytes(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Segment:
    """Documents that are gathered in a task, until they are given out as rows of blocks."""

    def __init__(self) -> None:
        self.numbers = Numbers()
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.chars = 0

    def add(self, key: int | None, text: str | None) -> None:
        found = terms_of(text)
        if found:
            self.ids.append(key)
            self.words.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
            self.chars += len(text)

    def rows(self, segment: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        ids = np.array([LAST_ID if self.ids[i] is None else self.ids[i] for i in order], np.int64)
        known = np.array([self.ids[i] is not None for i in order])
        lengths = np.array([len(self.words[i]) for i in order], np.int64)
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[np.fromiter((self.numbers[w] for w in names), np.int64, len(names))] = np.arange(len(names))
        pairs = rank[np.concatenate([self.words[i] for i in order])] * len(ids) + np.repeat(np.arange(len(ids)), lengths)
        pairs, times = np.unique(pairs, return_counts=True)
        term, doc = np.divmod(pairs, len(ids))

        lists = np.flatnonzero(np.diff(term, prepend=-1))
        place = np.arange(len(term)) - np.repeat(lists, np.diff(lists, append=len(term)))
        heads = np.flatnonzero(place % BLOCK == 0)
        counts = np.diff(heads, append=len(term))
        block = np.repeat(np.arange(len(heads)), counts)
        gaps = np.diff(doc, prepend=0)
        gaps[heads] = 0
        packed, ends = var_bytes(np.column_stack([gaps, times]).reshape(-1))
        cuts = np.concatenate([[0], ends[2 * (heads + counts) - 1]])

        # A pair is on the skyline if all pairs of its block with more occurrences are longer.
        length = lengths[doc]
        wide, tall = int(lengths.max()) + 1, int(times.max()) + 1
        by = np.argsort((block * tall + (tall - times)) * wide + length) if len(heads) * tall * wide < 1 << 62 else np.lexsort((length, -times, block))
        falling = length[by] - block[by] * wide
        least = np.minimum.accumulate(falling)
        top = by[np.diff(least, prepend=least[0] + 1) < 0]
        tops = np.column_stack([times[top], length[top]]).reshape(-1)
        at = np.concatenate([[0], np.cumsum(2 * np.bincount(block[top], minlength=len(heads)))])

        listing = ids.tobytes() + lengths.tobytes() + known.tobytes()
        sizes = np.concatenate([[0, len(listing)], len(listing) + cuts[1:]]).astype(np.int32)
        column = lambda first, rest, kind: pa.array(np.concatenate([[first], rest]), kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(heads) + 1, segment), pa.int64()),
                pa.concat_arrays([pa.array([b""]), pa.array(names, pa.binary()).take(pa.array(term[heads]))]).cast(pa.string()),
                column(0, doc[heads], pa.int32()),
                column(len(ids) - 1, doc[heads + counts - 1], pa.int32()),
                column(len(ids), counts, pa.int32()),
                column(lengths.sum(), np.zeros(len(heads), np.int64), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]), pa.int32()), pa.array(tops, pa.int32())),
                pa.Array.from_buffers(pa.binary(), len(heads) + 1, [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(listing + packed.tobytes())]),
            ],
            names=[x.split(" ")[0] for x in INDEX_SCHEMA.split(", ")],
        )


def index(docs: DataFrame, key: str = "doc_id", text_col: str = "text", chars: int = SEGMENT_CHARS) -> DataFrame:
    """The block rows of all documents and all terms, in the shared folder."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, held = TaskContext.get().partitionId(), 0, Segment()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.add(own, text.as_py())
                if held.chars >= chars:
                    yield held.rows(place << 32 | n)
                    n, held = n + 1, Segment()
        if held.ids:
            yield held.rows(place << 32 | n)

    return written(docs.select(F.col(key).cast("long"), text_col).mapInArrow(emit, INDEX_SCHEMA), "search-index")


def item_terms(items: DataFrame, item: str, text_col: str) -> DataFrame:
    """(item, own, term, times): the terms of each item; own tells the texts of one id apart."""
    kind = items.schema[item].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                found: dict[bytes, int] = {}
                for w in terms_of(text):
                    found[w] = found.get(w, 0) + 1
                same = pa.array([i] * len(found), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=[item, "own", "term", "times"])

    asked = items.select(F.col(item), F.xxhash64(text_col).alias("own"), F.col(text_col)).distinct()
    return asked.mapInArrow(emit, f"{item} {kind}, own long, term string, times long")


class Best:
    """The k best documents of an item so far: scores falling, equal scores by id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = 1, LAST_ID

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least, self.last = int(self.scores[-1]), int(self.ids[-1])

    def open_to(self, bound: int, first_id: int) -> bool:
        """Whether a score of at most bound can enter, from documents whose ids begin at first_id."""
        return bound > self.least or bound == self.least and first_id <= self.last


class Lists:
    """The block rows of one segment, unpacked as far as searches need it."""

    def __init__(self, rows: pa.RecordBatch, documents: int, tokens: int) -> None:
        if rows.column("term")[0].as_py() != "":
            raise ValueError("a segment's rows begin with the list of its documents")
        self.documents, self.tokens = documents, tokens
        n, raw = rows.column("postings")[0].as_py(), rows.column("packed")[0].as_buffer()
        self.ids, lengths = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n)
        self.known = np.frombuffer(raw, bool, n, 16 * n)
        self.rest = self.share(lengths)
        blocks = rows.slice(1)
        self.first, self.last, self.count = (blocks.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "postings"))
        self.packed = blocks.column("packed")
        tops = blocks.column("tops")
        ends = tops.value_lengths().to_numpy(zero_copy_only=False).cumsum()
        pairs = tops.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
        self.most = np.maximum.reduceat(self.impact(pairs[:, 0], self.share(pairs[:, 1])), np.concatenate([[0], ends[:-1] // 2])) if len(ends) else np.zeros(0, np.int64)
        names = blocks.column("term").to_pylist()
        heads = [i for i, w in enumerate(names) if not i or names[i - 1] != w]
        self.of = {names[a]: (a, b) for a, b in zip(heads, [*heads[1:], len(names)])}
        #: By list: unpacked documents and impacts, and which blocks are.
        self.open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def share(self, lengths: np.ndarray) -> np.ndarray:
        return 8 * (25 + 75 * lengths * self.documents // self.tokens)

    @staticmethod
    def impact(times: np.ndarray, share: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * times // (1000 * times + share)

    def postings(self, a: int, b: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of blocks i to before j of the list that has the block rows a to b."""
        if a not in self.open:
            n = int(self.count[a:b].sum())
            self.open[a] = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(b - a, bool)
        docs, impacts, done = self.open[a]
        if not done[i:j].all():
            raw = b"".join(x.as_py() for x in self.packed[a + i : a + j])
            gaps, times = from_var_bytes(np.frombuffer(raw, np.uint8)).reshape(-1, 2).T
            counts = self.count[a + i : a + j]
            heads = np.cumsum(counts) - counts
            walked = np.cumsum(gaps)
            at = slice(i * BLOCK, i * BLOCK + len(gaps))
            docs[at] = walked - np.repeat(walked[heads] - self.first[a + i : a + j], counts)
            impacts[at] = self.impact(times, self.rest[docs[at]])
            done[i:j] = True
        at = slice(i * BLOCK, min(j * BLOCK, len(docs)))
        return docs[at], impacts[at]

    def search(self, query: list[tuple[str, int]], best: Best) -> None:
        """Brings the segment's documents for weighted terms into best."""
        lists = [(weight, *self.of[term]) for term, weight in query if term in self.of]
        if not lists:
            return
        rows = np.concatenate([np.arange(a, b) for _, a, b in lists])
        caps = np.concatenate([weight * self.most[a:b] for weight, a, b in lists])
        edges, at = np.unique(np.concatenate([self.first[rows], self.last[rows] + 1]), return_inverse=True)
        steps = np.zeros(len(edges), np.int64)
        np.add.at(steps, at, np.concatenate([caps, -caps]))
        bounds = np.cumsum(steps)[:-1]
        highest = int(np.argmax(bounds))
        if best.open_to(int(bounds[highest]), int(self.ids[edges[highest]])):
            self.score(lists, edges[highest : highest + 1], edges[highest + 1 : highest + 2], best)
            bounds[highest] = 0
            live = np.flatnonzero(bounds >= best.least)
            if len(live):
                # Neighbouring live stretches go together.
                cut = np.flatnonzero(np.diff(live) > 1)
                self.score(lists, edges[live[np.concatenate([[0], cut + 1])]], edges[live[np.concatenate([cut, [len(live) - 1]])] + 1], best)

    def score(self, lists: list[tuple[int, int, int]], lows: np.ndarray, highs: np.ndarray, best: Best) -> None:
        """Scores the documents of the stretches from lows to before highs that can enter."""
        here = []
        for weight, a, b in lists:
            # A block is wanted if the first stretch that ends behind its first document begins before its end.
            near = np.searchsorted(highs, self.first[a:b], "right")
            wanted = (near < len(highs)) & (lows[np.minimum(near, len(lows) - 1)] <= self.last[a:b])
            if wanted.any():
                here.append((weight * int(self.most[a:b][wanted].max()), weight, a, b, wanted))
        here.sort(key=lambda x: -x[0])
        more = sum(x[0] for x in here)
        low, high, first_id = int(lows[0]), int(highs[-1]), int(self.ids[lows[0]])
        scores, pivots, least = np.zeros(high - low, np.int64), None, best.least
        for cap, weight, a, b, wanted in here:
            if best.k < len(scores) and more < int(scores.max()):
                # What documents have so far is below what they will have, so the k-th of it is a threshold too.
                least = max(least, int(np.partition(scores, -best.k)[-best.k]))
            if more < least or not best.open_to(more, first_id):  # from here on, no document is a pivot that isn't one already
                if pivots is None:
                    pivots = self.inside(np.flatnonzero(scores), lows - low, highs - low)
                pivots = pivots[scores[pivots] + more >= least]
                if not len(pivots):
                    return
                near = np.searchsorted(self.last[a:b], pivots + low)
                near = near[near < b - a]
                wanted = np.zeros(b - a, bool)
                wanted[near[self.first[a:b][near] <= pivots[: len(near)] + low]] = True
            blocks = np.flatnonzero(wanted)
            cuts = np.flatnonzero(np.diff(blocks) > 1) if len(blocks) and blocks[-1] - blocks[0] >= len(blocks) else ()
            for i, j in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(blocks)]) if len(blocks) else ():
                docs, impacts = self.postings(a, b, int(blocks[i]), int(blocks[j - 1]) + 1)
                p, q = docs.searchsorted((low, high))
                scores[docs[p:q] - low] += weight * impacts[p:q]
            more -= cap
        found = self.inside(np.flatnonzero(scores), lows - low, highs - low) if pivots is None else pivots
        found = found[scores[found] >= least]
        best.add(scores[found], self.ids[low + found])

    @staticmethod
    def inside(docs: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """The documents within the stretches."""
        return docs[docs >= lows[np.minimum(np.searchsorted(highs, docs, "right"), len(lows) - 1)]]


def by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each segment as one batch, from rows that are sorted by segment."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column("segment").to_numpy()
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
            if held and b > a and held[0].column("segment")[0].as_py() != numbers[a]:
                yield pa.concat_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def ranked(blocks: DataFrame, items: DataFrame, item: str = "item_id", text_col: str = "text", k: int = TOP, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item, own, rank, doc_id, score): the k best documents of each item, from the block rows of :func:`index`."""
    spark = blocks.sparkSession
    size = blocks.where("term = ''").agg(F.sum("postings"), F.sum("tokens"), F.count(F.lit(1))).first()
    documents, tokens = int(size[0] or 0), int(size[1] or 0)
    # Many segments a task share their thresholds; a task has TASK_SEGMENTS at most, about.
    tasks = max(1, min(size[2], max(int(spark.conf.get("spark.sql.shuffle.partitions")), size[2] // TASK_SEGMENTS)))
    asked = written(item_terms(items, item, text_col), "search-items")
    held = join_sized(blocks.select("term", "postings").where("term != ''"), asked.select("term").distinct(), ["term"], "left_semi").groupBy("term").agg(F.sum("postings").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weighted = written(join_sized(asked, held, ["term"], "inner").select(item, "own", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "search-weights")
    batches = max(1, math.ceil(weighted.count() / batch_terms))
    kind = items.schema[item].dataType.simpleString()
    found = None
    for n in range(batches):
        part = weighted.where(F.pmod(F.xxhash64(item, "own"), F.lit(batches)) == n)
        queries: dict = {}
        for r in part.collect():  # about batch_terms rows, or those of one item
            queries.setdefault((r[item], r["own"]), []).append((r["term"], r["weight"]))
        shared = spark.sparkContext.broadcast(list(queries.items()))

        def look(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {q: Best(k) for q, _ in shared.value}
            for segment in by_segment(rows):
                lists = Lists(segment, documents, tokens)
                for q, query in shared.value:
                    lists.search(query, best[q])
            full = [(q, b) for q, b in best.items() if len(b.ids)]
            pick = lambda f: [x for q, b in full for x in f(q, b)]
            yield pa.RecordBatch.from_pydict(
                {item: pick(lambda q, b: [q[0]] * len(b.ids)), "own": pick(lambda q, b: [q[1]] * len(b.ids)), "doc_id": pick(lambda q, b: [None if i == LAST_ID else i for i in b.ids.tolist()]), "score": pick(lambda q, b: b.scores.tolist())},
                schema=pa.schema([pa.field(item, pa_type), ("own", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]),
            )

        pa_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
        own_blocks = join_sized(blocks, part.select("term").distinct().union(spark.createDataFrame([("",)], "term string")), ["term"], "left_semi").select(*blocks.columns)
        rows = own_blocks.repartition(tasks, "segment").sortWithinPartitions("segment", "term", "first")
        one = rows.mapInArrow(look, f"{item} {'long' if pa_type == pa.int64() else 'string'}, own long, doc_id long, score long")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy(item, "own").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(item, "own", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    blocks = index(table(spark, sf_dir, "documents"))
    out = written(ranked(blocks, table(spark, sf_dir, "benchmark")), "search-ranks")
    dropped(blocks)
    return out.select("item_id", "rank", "doc_id", "score")


QUERIES = {"op11_block_max_wand": op11_block_max_wand}
TERM_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op11_block_max_wand": f"""
WITH words AS (SELECT doc_id, unnest({TERM_LIST}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM lengths),
posts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dfs AS (SELECT term, CAST(floor(1000 * ln((2.0 * max(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posts, total GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERM_LIST}) AS term FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT a.item_id, p.doc_id, CAST(sum(a.times * d.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * l.n * t.nd) // t.nt)))) AS BIGINT) AS score
  FROM asked a JOIN dfs d ON a.term = d.term JOIN posts p ON p.term = a.term JOIN lengths l ON l.doc_id = p.doc_id, total t
  GROUP BY a.item_id, p.doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10"""
}
