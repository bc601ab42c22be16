"""Whitening of embeddings with exact moments by digit-slice products.

1. Every entry c becomes the integer ``floor(64 c) + 1000000``. The fit list is each distinct integer vector once, so copies, however many,
   weigh as one; they collapse by partial aggregation.
2. n and the sums S are exact. ``y = n x - S`` are integers again, centred before anything is multiplied.
3. Digit-slice GEMM: a block of y is split into limbs of LIMB_BITS bits. Products of limb matrices are float64 BLAS products whose sums stay below 2**53, so
   they are exact; they are added up in int64 planes by their power, with carries. Planes are merged by matrix row and
   recombined as big integers. The driver takes dims x dims of them, as many as the decomposition needs anyway.
4. ``V = Y'Y / n**3`` is rounded once, each entry from an exact quotient, and decomposed. Rows are projected in one pass.

Tasks hold one Arrow batch and the planes (dims squared). The fit list is in the shared folder; nothing else grows with the rows.

Results for odd rows: null vectors and those with null or non-finite entries are dropped; vectors of each length are a space of their own, empty
vectors have no components; integers beyond 2**62 in size stop there; components without spread (eigenvalue at most 1e-12 of the trace) are left out, so that
a single distinct vector has no rows; a deviation beyond 64 bits is null; repeated rows repeat; null ids are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table, tune, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Limbs below 2**19 over at most 2**13 rows: sums of products stay below 2**51.
LIMB_BITS, BLOCK_ROWS = 19, 8192
LARGEST, FLAT = 1 << 62, 1e-12


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the integer vectors as 64-bit little-endian bytes, without the rows that drop out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.float64()))
            ends = np.asarray(lists.offsets).astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)  # nulls are NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(SCALE * np.nan_to_num(values, posinf=0.0, neginf=0.0)), -LARGEST, LARGEST - 2048).astype("<i8") + SHIFT
            raw, size = whole.tobytes(), 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array([raw[size * ends[i] : size * ends[i + 1]] for i in good.tolist()], pa.binary())], names=[key, "x"])

    return rows.select(key, F.col(vector).alias("_v")).mapInArrow(emit, f"{key} {rows.schema[key].dataType.simpleString()}, x binary")


def matrix(x: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i8").reshape(-1, dims)


def by_dims(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by their number of dimensions."""
    sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(column)], np.int64)
    for d in np.unique(sizes).tolist():
        if d:
            yield d, batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))


def limbs(y: np.ndarray, bits: int) -> list[np.ndarray]:
    """y as float64 limbs, low ones first; the last one carries the sign."""
    out = []
    for _ in range(-(-(bits + 1) // LIMB_BITS) - 1):
        out.append((y & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        y = y >> LIMB_BITS
    return [*out, y.astype(np.float64)]


def carried(planes: np.ndarray) -> None:
    """Moves what is beyond a limb of each plane on to the next one."""
    for s in range(len(planes) - 1):
        up = planes[s] >> LIMB_BITS
        planes[s] -= up << LIMB_BITS
        planes[s + 1] += up


def products(y: np.ndarray, bits: int, planes: np.ndarray) -> None:
    """Adds Y'Y to the planes, by exact float64 products of limbs."""
    for at in range(0, len(y), BLOCK_ROWS):
        parts = limbs(y[at : at + BLOCK_ROWS], bits)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                p = a.T @ b
                planes[i + j] += (p if i == j else p + p.T).astype(np.int64)
        carried(planes)


def centred(x: np.ndarray, n: int, sums: np.ndarray, bits: int) -> np.ndarray:
    """n x - S, in 64 bits where they hold it, else as Python's integers."""
    if bits < 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


class Space:
    """What the rows of one number of dimensions are projected with."""

    def __init__(self, n: int, sums: np.ndarray, most: int):
        self.n, self.sums = n, sums
        #: Bits of the largest |n x - S|.
        self.bits = int(2 * n * max(1, most)).bit_length()

    def fit(self, gram: list[list[int]], components: int) -> None:
        """gram: Y'Y. The divisor is n for the mean and n squared for the scale of y."""
        values, vectors = np.linalg.eigh(np.array([[v / self.n**3 for v in row] for row in gram]))
        trace = sum(gram[i][i] for i in range(len(gram))) / self.n**3
        order = [i for i in np.argsort(values)[::-1][:components] if values[i] > FLAT * trace]
        self.projection = vectors[:, order] / np.sqrt(values[order])
        self.explained = values[order] / trace
        self.identity_error = 0.0

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(np.float64) @ self.projection

    def deviations(self, y: np.ndarray) -> list[int | None]:
        if int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        exact = (y.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _sums(fit: DataFrame) -> dict[int, Space]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, rows in by_dims(batch):
                x = matrix(rows.column(0), d)
                own = held.setdefault(d, [0, np.zeros(d, object), 0])
                own[0] += len(x)
                own[1] += (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0)
                own[2] = max(own[2], int(np.abs(x).max()))
        for d, (n, sums, most) in held.items():
            same = lambda v, kind, d=d: pa.array([v] * d, kind)
            yield pa.RecordBatch.from_arrays([same(d, pa.int32()), pa.array(range(d), pa.int32()), same(n, pa.int64()), pa.array([str(v) for v in sums]), same(most, pa.int64())], names=["dims", "at", "n", "total", "most"])

    parts = fit.mapInArrow(emit, "dims int, at int, n long, total string, most long")
    rows = parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most")).collect()  # one row a dimension
    out: dict[int, Space] = {}
    for d in {r["dims"] for r in rows}:
        own = sorted((r for r in rows if r["dims"] == d), key=lambda r: r["at"])
        out[d] = Space(own[0]["n"], np.array([int(r["total"]) for r in own], object), max(r["most"] for r in own))
    return out


def _grams(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, list[list[int]]]:
    shared = fit.sparkSession.sparkContext.broadcast(spaces)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows in by_dims(batch):
                space = shared.value[d]
                if d not in held:
                    held[d] = np.zeros((2 * -(-(space.bits + 1) // LIMB_BITS) + 4, d, d), np.int64)
                products(centred(matrix(rows.column(0), d), space.n, space.sums, space.bits), space.bits, held[d])
        for d, planes in held.items():
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([planes[:, i, :].tobytes()], pa.binary())], names=["dims", "at", "planes"])

    def merge(rows: pa.Table) -> pa.Table:
        d = rows["dims"][0].as_py()
        total = np.zeros(0, object)
        for x in rows["planes"]:
            planes = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d)
            total = sum((planes[s].astype(object) << (LIMB_BITS * s) for s in range(len(planes))), total if len(total) else np.zeros(d, object))
        return pa.table({"dims": rows["dims"].slice(0, 1), "at": rows["at"].slice(0, 1), "row": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    parts = fit.mapInArrow(emit, "dims int, at int, planes binary")
    rows = parts.groupBy("dims", "at").applyInArrow(merge, "dims int, at int, row array<string>").collect()  # dims x dims numbers
    out: dict[int, list] = {d: [None] * d for d in spaces}
    for r in rows:
        out[r["dims"]][r["at"]] = [int(v) for v in r["row"]]
    return out


def _identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> None:
    """Measures the covariance of the fit list's whitened vectors; their mean is zero, as the y sum up to zero exactly."""
    shared = fit.sparkSession.sparkContext.broadcast(spaces)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows in by_dims(batch):
                space = shared.value[d]
                z = space.whitened(centred(matrix(rows.column(0), d), space.n, space.sums, space.bits))
                held[d] = held.get(d, 0) + z.T @ z
        for d, sums in held.items():
            k = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([d] * k * k, pa.int32()), pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(sums.reshape(-1), pa.float64())], names=["dims", "a", "b", "v"])

    for r in fit.mapInArrow(emit, "dims int, a int, b int, v double").groupBy("dims", "a", "b").agg(F.sum("v").alias("v")).collect():  # components squared
        space = spaces[r["dims"]]
        space.identity_error = max(space.identity_error, abs(r["v"] / space.n - (r["a"] == r["b"])))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every row and component."""
    own = integers(rows, key, vector)
    fit = written(own.select("x").distinct(), "whiten-fit")
    spaces = _sums(fit)
    for d, gram in _grams(fit, spaces).items():
        spaces[d].fit(gram, components)
    _identity_errors(fit, spaces)
    shared = rows.sparkSession.sparkContext.broadcast(spaces)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_dims(batch):
                space = shared.value[d]
                y = centred(matrix(part.column(1), d), space.n, space.sums, space.bits)
                z = space.whitened(y)
                m, k = z.shape
                each = pa.array(np.repeat(np.arange(m), k), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, space.n), pa.int64()),
                        pa.array(space.deviations(y), pa.int64()).take(each), pa.array(z.reshape(-1), pa.float64()),
                        pa.array(np.tile(space.explained, m), pa.float64()), pa.array(np.full(m * k, space.identity_error), pa.float64()),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(emit, f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_digit_slice_whitening": op12_digit_slice_whitening}
SQL: dict[str, str] = {}
