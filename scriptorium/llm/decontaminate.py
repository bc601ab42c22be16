"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case with white space runs as one space. An item of n characters counts as found if a region
of a text has at most ``e = EDITS * n`` edits (insertions, deletions, replacements) to it. By the q-gram lemma such a region
shares at least ``n - q + 1 - q * e`` q-grams with the item, on diagonals (place in the text less place in the item) that lie within e
of each other. So per batch:

1. every q-gram of the texts is looked up among the items' q-grams (a bitmap first, then the sorted codes);
2. shared q-grams are counted by text, item and overlapping diagonal bands of twice e + 1;
3. bands that meet the bound are verified by banded alignment.

q is ``Q``, or for a short item the greatest that leaves a bound of 1 or more: n // (e + 1). Shared q-grams are expanded to
``PAIRS`` at a time and summed up, so that memory doesn't grow with their number. An item that repeats itself (``REPEATS`` places a distinct q-gram)
would share each place of a text that repeats likewise with many of its own; for such items the places of a text whose q-gram the item
has at all are counted in overlapping windows of twice n + e, by the same bound, and windows that meet it are verified. All such items of one q share
one index of distinct q-grams, with a bitmap of its own. Items below ``Q`` characters are looked up by runs of words.

Q-grams that occur in very many items are left out of an item's counts only as far as its bound can be lowered by as many, so
the filter loses nothing. Items are a stated query set against all rows: they are broadcast in blocks of
``BLOCK_BYTES``, one pass over the texts a block, so the broadcast is bounded however many items there are. Nothing is shuffled.

Results for odd rows: a null or empty text has no hits; a null or blank item is never found; an item shorter than ``Q``
characters is found where it stands verbatim between spaces or ends; items with equal texts are all reported; repeated rows
repeat; empty tables give empty results; other columns pass through :func:`clean`. Very long texts are scanned whole.
Positions are code points of the lower-cased text, the end is exclusive; of overlapping regions of one item the nearest is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import pieces, table, tune

#: Length of a q-gram, and edits allowed a character.
Q, EDITS = 8, 0.1
#: Bytes of items in a broadcast.
BLOCK_BYTES = 4 << 20
#: A q-gram in more places of the items than this is common.
COMMON = 16
BITS = 20
#: Shared q-grams that are counted at once, and places a distinct q-gram from which on an item counts as repetitive.
PAIRS, REPEATS = 1_000_000, 4
#: Characters that are searched at once.
PIECE_CHARS = 1_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SPACES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
IS_SPACE = np.zeros(0x3002, bool)  # the last entry stands for all later characters
IS_SPACE[list(SPACES)] = True


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' code points in lower case with single spaces, their places in the lower-cased texts, and where each text
    starts (with a last entry for the end)."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, lower)])
    space = IS_SPACE[np.minimum(points, len(IS_SPACE) - 1)]
    # A space goes if it follows another, or starts or ends its text.
    drop = space.copy()
    drop[1:] &= space[:-1]
    inner = starts[:-1][np.diff(starts) > 0]
    drop[inner] = space[inner]
    keep = np.flatnonzero(~drop)
    counts = np.searchsorted(keep, starts)
    lasts = counts[1:][np.diff(counts) > 0] - 1
    keep = np.delete(keep, lasts[space[keep[lasts]]])
    counts = np.searchsorted(keep, starts)
    return np.where(space[keep], np.uint32(32), points[keep]), keep - np.repeat(starts[:-1], np.diff(counts)), counts


def folded(points: np.ndarray) -> np.ndarray:
    return (points ^ points >> 8).astype(np.uint8)


def grams(letters: np.ndarray, q: int) -> np.ndarray:
    """All windows of q (at most 8) letters as numbers."""
    n = len(letters) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.append(letters, np.zeros(8, np.uint8)).tobytes()
    return np.ndarray((n,), "<u8", raw, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * q) - 1)


def slot(codes: np.ndarray) -> np.ndarray:
    return (codes * SPREAD >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Grams:
    """The q-grams of one length of some items."""

    q: int
    bitmap: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    places: np.ndarray


@dataclass
class Index:
    """A block of items: their q-grams by length, those that are counted by windows, and those too short for q-grams."""

    ids: list
    items: list[np.ndarray]
    edits: np.ndarray
    bounds: np.ndarray
    short: dict[str, list[int]]
    levels: list[Grams]
    windowed: list[Grams]


def gathered(q: int, codes: np.ndarray, owners: np.ndarray, places: np.ndarray) -> Grams:
    order = np.argsort(codes, kind="stable")
    unique, starts = np.unique(codes[order], return_index=True)
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[slot(unique)] = True
    return Grams(q, bitmap, unique, np.append(starts, len(order)), owners[order], places[order])


def build(rows: list[tuple[object, str | None]], share: float) -> Index:
    points, _, cuts = normal([text for _, text in rows])
    items = [points[a:b] for a, b in zip(cuts, cuts[1:])]
    edits = np.array([int(share * len(x)) for x in items] or [0], np.int64)
    # n - q + 1 - q * e is 1 or more up to q = n // (e + 1).
    lengths = [min(Q, len(x) // (int(e) + 1)) if len(x) >= Q else 0 for x, e in zip(items, edits)]
    bounds = np.array([len(x) - q + 1 - q * int(e) for x, e, q in zip(items, edits, lengths)] or [0], np.int64)
    levels, windowed, none = [], [], np.zeros(0, np.int64)
    for q in sorted({q for q in lengths if q}):
        parts = {i: grams(folded(items[i]), q) for i, own in enumerate(lengths) if own == q}
        distinct = {i: np.unique(p) for i, p in parts.items()}
        repetitive = {i: d for i, d in distinct.items() if len(parts[i]) >= REPEATS * len(d)}
        if repetitive:
            owners = np.concatenate([np.full(len(d), i, np.int64) for i, d in repetitive.items()])
            windowed.append(gathered(q, np.concatenate([*repetitive.values()]), owners, np.zeros(len(owners), np.int64)))
        parts = {i: p for i, p in parts.items() if i not in repetitive}
        codes = np.concatenate([np.zeros(0, np.uint64), *parts.values()])
        owners = np.concatenate([none, *[np.full(len(p), i, np.int64) for i, p in parts.items()]])
        places = np.concatenate([none, *[np.arange(len(p)) for p in parts.values()]])
        # Common grams go, the commonest first, while the item's bound stays at 1 or more.
        _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
        often = counts[inverse] if len(codes) else none
        order = np.lexsort((-often, owners))
        ranked = owners[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        drop = np.zeros(len(codes), bool)
        drop[order] = (often[order] > COMMON) & (rank < bounds[ranked] * 3 // 4)
        bounds = bounds - np.bincount(owners[drop], minlength=len(bounds))
        if len(codes):
            levels.append(gathered(q, codes[~drop], owners[~drop], places[~drop]))
    short: dict[str, list[int]] = {}
    for i, x in enumerate(items):
        if 0 < len(x) < Q:
            short.setdefault(string(x), []).append(i)
    return Index([i for i, _ in rows], items, edits, bounds, short, levels, windowed)


def string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def distances(item: np.ndarray, region: np.ndarray, low: int, high: int) -> np.ndarray:
    """Least edits between the item and a piece of the region that ends at low + n .. high + n, on the diagonals
    low .. high of the region."""
    n, width = len(item), high - low + 1
    padded = np.full(n + width + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(region), low + n + width)
    padded[a - low : max(a, b) - low] = region[a:b]
    steps, row = np.arange(width), np.zeros(width, np.int64)
    for i in range(n):
        # Cell d stands on diagonal low + d, after i + 1 characters of the item.
        nearest = row + (padded[i : i + width] != item[i])
        nearest[:-1] = np.minimum(nearest[:-1], row[1:] + 1)
        row = np.minimum.accumulate(nearest - steps) + steps
    return row


def verify(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the best region that starts on the diagonals low .. high, if it is near enough."""
    a, b = max(0, low), min(len(text), high + len(item) + edits)
    raw, want = text[a:b].tobytes(), item.tobytes()
    at = raw.find(want)
    while at >= 0 and at % 4:
        at = raw.find(want, at + 1)
    if at >= 0:
        return a + at // 4, a + at // 4 + len(item), 0
    ends = distances(item, text, low - edits, high + edits)
    best = int(ends.argmin())
    if ends[best] > edits:
        return None
    end = min(len(text), low - edits + best + len(item))
    # Backwards from the end: the start is where the reversed item ends.
    back = distances(item[::-1], text[max(0, end - len(item) - edits) : end][::-1], -edits, edits)
    size = int(back.argmin()) - edits + len(item)
    return max(0, end - size), end, int(ends[best])


def shared(level: Grams, letters: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the code) of the texts' q-grams that an item has; none over two texts."""
    codes = grams(letters, level.q)
    at = np.flatnonzero(level.bitmap[slot(codes)])
    own = np.minimum(np.searchsorted(level.codes, codes[at]), len(level.codes) - 1)
    same = (level.codes[own] == codes[at]) & (np.searchsorted(firsts, at, "right") == np.searchsorted(firsts, at + level.q - 1, "right"))
    return at[same], own[same]


def summed(text: np.ndarray, owner: np.ndarray, band: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sizes by text, owner and band, ordered."""
    order = np.lexsort((band, owner, text))
    text, owner, band, size = text[order], owner[order], band[order], size[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(new)
    return text[first], owner[first], band[first], np.add.reduceat(size, first) if len(first) else size[:0]


def counted(level: Grams, letters: np.ndarray, firsts: np.ndarray, number) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, number, size): how many shared q-grams each text and item have by the number that ``number(place, text, item, place in the item)``
    gives them. They are expanded and summed PAIRS at a time."""
    at, own = shared(level, letters, firsts)
    counts = level.starts[own + 1] - level.starts[own]
    parts = []
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1
    for a, c, n in zip(np.split(at, cuts), np.split(own, cuts), np.split(counts, cuts)):
        rows = np.repeat(level.starts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a = np.repeat(a, n)
        text, owner = np.searchsorted(firsts, a, "right") - 1, level.owners[rows]
        parts.append(summed(text, owner, number(a, text, owner, level.places[rows]), np.ones(len(a), np.int64)))
    return summed(*map(np.concatenate, zip(*parts)))


def banded(index: Index, level: Grams, letters: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first diagonal, last diagonal) of the bands that meet the bound."""
    # Diagonals from the text's start; a region may start up to e before it.
    text, owner, band, size = counted(level, letters, firsts, lambda a, t, o, p: (a - firsts[t] - p + firsts[-1]) // (index.edits[o] + 1))
    both = size.copy()
    follows = (text[1:] == text[:-1]) & (owner[1:] == owner[:-1]) & (band[1:] == band[:-1] + 1)
    both[:-1] += np.where(follows, size[1:], 0)
    for k in np.flatnonzero(both >= index.bounds[owner]).tolist():
        e = int(index.edits[owner[k]])
        low = int(band[k]) * (e + 1) - int(firsts[-1])
        yield int(text[k]), int(owner[k]), low, low + 2 * (e + 1) - 1


def windows(index: Index, level: Grams, letters: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """The same for items that repeat themselves: windows in which enough places have one of an item's q-grams."""
    steps = np.array([len(x) for x in index.items], np.int64) + index.edits
    text, owner, number, size = counted(level, letters, firsts, lambda a, t, o, p: (a - firsts[t]) // steps[o])
    # A region lies in the window it starts in and the next one; it may also start in a window without a shared place.
    follows = np.zeros(len(text), bool)
    follows[1:] = (text[1:] == text[:-1]) & (owner[1:] == owner[:-1]) & (number[1:] == number[:-1] + 1)
    both = size.copy()
    both[:-1] += np.where(follows[1:], size[1:], 0)
    bound = index.bounds[owner]
    for k, back in [*((k, 0) for k in np.flatnonzero(both >= bound).tolist()), *((k, 1) for k in np.flatnonzero((size >= bound) & ~follows & (number > 0)).tolist())]:
        n, step = int(number[k]) - back, int(steps[owner[k]])
        yield int(text[k]), int(owner[k]), n * step, (n + 1) * step - 1


def verbatim(short: dict[str, list[int]], text: str) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) where each short item stands first between spaces or ends: runs of words below Q characters are looked up."""
    words, at, seen = text.split(" "), 0, set()
    for i, word in enumerate(words):
        run, j = word, i
        while len(run) < Q:
            if run in short and run not in seen:
                seen.add(run)
                for o in short[run]:
                    yield o, at, at + len(run)
            j += 1
            if j == len(words):
                break
            run += " " + words[j]
        at += len(word) + 1


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, distance) of all hits, ordered."""
    points, places, firsts = normal(texts)
    pairs = [points[a:b] for a, b in zip(firsts, firsts[1:])]
    out, letters = [], folded(points)
    for find, levels in ((banded, index.levels), (windows, index.windowed)):
        for level in levels if len(points) else ():
            for t, o, low, high in find(index, level, letters, firsts):
                if hit := verify(index.items[o], pairs[t], low, high, int(index.edits[o])):
                    out.append((t, o, *hit))
    for t, own in enumerate(pairs if index.short else ()):
        out += [(t, o, a, b, 0) for o, a, b in verbatim(index.short, string(own))]
    best: list = []
    for hit in sorted(out):
        if best and best[-1][:2] == hit[:2] and hit[2] < best[-1][3]:
            if hit[4] < best[-1][4]:
                best[-1] = hit
        else:
            best.append(hit)
    place = lambda t, x: int(places[firsts[t] + x])
    return [(t, o, place(t, a), place(t, b - 1) + 1, d) for t, o, a, b, d in best if b > a]


def indexes(benchmark: DataFrame, key: str, text_col: str, share: float) -> Iterator[Index]:
    """The items in blocks of bounded size."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = benchmark.select(key, text_col).where(F.pmod(F.xxhash64(key, text_col), F.lit(blocks)) == b)
        if rows := sorted(((r[0], r[1]) for r in part.collect()), key=str):  # at most about BLOCK_BYTES
            yield build(rows, share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_col: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """Rows (key, item key, start, end, distance), one a region of a text that holds an item."""
    spark, out = docs.sparkSession, None
    kinds = [docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()]
    item_type = pa.array([r[0] for r in benchmark.select(item_key).limit(1).collect()]).type
    schema = f"{key} {kinds[0]}, {item_key} {kinds[1]}, start long, `end` long, distance int"
    for index in indexes(benchmark, item_key, item_text, share):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in pieces(batches, 1, PIECE_CHARS):
                hits = search(index, batch.column(1).to_pylist())
                columns = list(zip(*hits)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([index.ids[o] for o in columns[1]], item_type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32())],
                    names=[key, item_key, "start", "end", "distance"],
                )

        found = docs.select(key, text_col).mapInArrow(scan, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    columns = docs.columns
    rows = docs.select(F.col(text_col).alias("_text"), F.struct(*columns).alias("_row"))
    for index in indexes(benchmark, item_key, item_text, share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 0, PIECE_CHARS):
                hit = {h[0] for h in search(shared.value, batch.column(0).to_pylist())}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        rows = rows.mapInArrow(scan, rows.schema)
    return rows.select("_row.*")


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_qgram_decontamination": op2_qgram_decontamination}
SQL: dict[str, str] = {}
