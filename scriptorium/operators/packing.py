"""Sequential folds within an entity: greedy chunks, paragraph windows, first-fit batches, text splitting.

They reset an accumulator, so window sums can't say them. Rows are dealt by entity and sorted; a task folds them as they come and holds only
the accumulator (an open chunk's size, a paragraph, a number for each batch), whatever an entity's size."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_chunks(df: DataFrame, key: str, order: str, size: str, limit: float) -> DataFrame:
    """(key, order, size, chunk): a chunk is closed when it isn't empty and the next item doesn't fit."""
    rows = df.select(key, order, F.col(size).cast("double").alias(size)).repartition(key).sortWithinPartitions(key, order, size)
    kinds = dict(rows.dtypes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, total = object(), 0, 0.0
        for batch in batches:
            out = []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != own:
                    own, chunk, total = k, 0, 0.0
                s = s or 0.0
                full = total > 0 and total + s > limit
                chunk, total = (chunk + 1, s) if full else (chunk, total + s)
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "chunk"])

    return rows.mapInArrow(emit, f"{key} {kinds[key]}, {order} {kinds[order]}, {size} double, chunk int")


ENDS = re.compile(r"""[.!?][\])}'"]*$""")


def paragraph_windows(df: DataFrame, key: str, start: str, text: str, target: int = 800, most: int = 1200, seconds: float = 75.0) -> DataFrame:
    """(key, paragraph, start, text): timed cues as paragraphs.

    A paragraph is closed before a cue that would make it too long or last too long, and behind a cue that ends a sentence once it has
    the target length; the cue that opens a paragraph after an overflow isn't tested for that."""
    cues = df.select(key, F.col(start).cast("double").alias("start"), F.col(text).alias("text")).repartition(key).sortWithinPartitions(key, F.col("start").asc_nulls_last(), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, since, open_text, rows = object(), 0, None, None, []

        def close() -> None:
            nonlocal number, open_text
            if open_text is not None:
                rows.append((own, number, since, open_text))
                number, open_text = number + 1, None

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string())], names=[key, "paragraph", "start", "text"])
            rows.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t, x in zip(*(c.to_pylist() for c in batch.columns)):
                if k != own:
                    close()
                    own, number = k, 0
                x = x or ""
                if open_text is None:
                    since, open_text = t, x
                else:
                    joined = f"{open_text} {x}"
                    if len(joined) > most or t is not None and since is not None and t - since > seconds:
                        close()
                        since, open_text = t, x
                        continue
                    open_text = joined
                if len(open_text) >= target and ENDS.search(open_text):
                    close()
            yield batch_of()
        close()
        if rows:
            yield batch_of()

    return cues.mapInArrow(emit, f"{key} {dict(df.dtypes)[key]}, paragraph int, start double, text string")


def split_text(text: str, most: int) -> list[str]:
    """Parts of at most so many characters: behind a sentence's end in the last 40 %, else at white space, else anywhere."""
    if len(text) <= most:
        return [text]
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            least = at + int(0.6 * most)
            spaces = [k for k in range(end, least - 1, -1) if text[k].isspace()]
            cut = next((k for k in spaces if k > at and text[k - 1] in ".!?。！？"), spaces[0] if spaces else 0)
            end = cut if cut > at else end
        parts.append(text[at:end].strip())
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return [p for p in parts if p]


#: Characters of the units that a task splits and returns at once.
PIECE = 1_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE characters of a text column (one text may be longer)."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)


def unit_parts(units: DataFrame, key: list[str], text: str, chunk: int) -> DataFrame:
    """(keys, part, text): oversize units in parts of at most max(500, chunk - 300) characters. A task holds the parts of about PIECE characters."""
    most = max(500, chunk - 300)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(key)):
            parts = [split_text(t or "", most) for t in batch.column(len(key)).to_pylist()]
            at = pa.array([i for i, x in enumerate(parts) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in batch.columns[: len(key)]], pa.array([n for x in parts for n in range(len(x))], pa.int32()), pa.array([p for x in parts for p in x], pa.string())],
                names=[*key, "part", text],
            )

    kinds = ", ".join(f"`{k}` {units.schema[k].dataType.simpleString()}" for k in key)
    return units.select(*key, text).mapInArrow(emit, f"{kinds}, part int, `{text}` string")


class Batches:
    """Room in batches by number; the first with enough is found in a tree of maxima."""

    def __init__(self):
        self.used, self.size, self.tree = [], 1, [-math.inf] * 2

    def _set(self, i: int, room: float) -> None:
        i += self.size
        self.tree[i] = room
        while i > 1:
            i //= 2
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, item: int | None, limit: int) -> int:
        """The item's batch: the first it fits in, else a new one."""
        if item is not None and self.tree[1] >= item:
            i = 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] >= item else 2 * i + 1
            i -= self.size
            self.used[i] += item
        else:
            i = len(self.used)
            if i == self.size:
                rooms = self.tree[self.size :]
                self.size *= 2
                self.tree = [-math.inf] * (2 * self.size)
                self.tree[self.size : self.size + len(rooms)] = rooms
                for k in range(self.size - 1, 0, -1):
                    self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])
            self.used.append(math.inf if item is None else item)
        self._set(i, limit - self.used[i])
        return i


def first_fit(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """(key, order, size, batch): passes over a queue; the first left item is always taken, then all later ones that still fit.

    An item so goes to the first batch that has room when it comes, which one pass over the sorted rows finds; a task holds a number for
    each batch of the key at hand."""
    schema = f"{key} {dict(df.dtypes)[key]}, {order} {dict(df.dtypes)[order]}, {size} long, batch int"

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batches = object(), Batches()
        for frame in frames:
            out = []
            for k, item in zip(frame.column(0).to_pylist(), frame.column(2).to_pylist()):
                if k != now:
                    now, batches = k, Batches()
                out.append(batches.put(item, limit))
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out, pa.int32())], names=[key, order, size, "batch"])

    rows = df.select(key, order, F.col(size).cast("long").alias(size)).repartition(key)
    return rows.sortWithinPartitions(key, F.col(order).asc_nulls_last()).mapInArrow(pack, schema)


def bisected(items: list, run, fatal=()) -> Iterator[tuple[object, object, Exception | None]]:
    """(item, result, error) of a batch call; a failed batch is run in halves, a single item once more. Errors in ``fatal`` are raised."""
    try:
        yield from ((i, r, None) for i, r in zip(items, run(items)))
        return
    except fatal:
        raise
    except Exception as error:  # noqa: BLE001  a failed call is data here
        if len(items) > 1:
            half = -(-len(items) // 2)
            yield from bisected(items[:half], run, fatal)
            yield from bisected(items[half:], run, fatal)
            return
        try:
            yield items[0], run(items)[0], None
        except fatal:
            raise
        except Exception as again:  # noqa: BLE001
            yield items[0], None, again or error
