"""Embedding whitening from exact cross-products (operator 13).

Vectors become integers of 1/256 steps. Each task shifts its rows' dimensions to start at zero, packs
every bit plane of every dimension across rows into 64-bit words, and counts the bits of the AND of two
planes; weighted by powers of two these counts are the exact cross-products, which Spark adds up in limbs
of 30 bits. The covariance is centred as integers (n * sum xy - sum x * sum y) and rounded once, before
the eigenvectors are taken.

Every distinct integer vector counts once in the fit. Vectors of different lengths are whitened apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

STEPS, COMPONENTS = 256, 4
#: Bits of a limb of a sum; rows of a block whose planes are held at once.
LIMB, ROWS = 30, 1 << 15
#: Eigenvalues below this share of the largest are zero but for rounding.
RANK = 1e-13


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _planes(x: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Bit planes of non-negative numbers (uint64), packed across rows: words by plane, and each plane's dimension and bit."""
    words, dimension, bit = [], [], []
    for d in range(x.shape[1]):
        for b in range(int(x[:, d].max()).bit_length()):
            packed = np.packbits((x[:, d] >> np.uint64(b) & np.uint64(1)).astype(bool))
            words.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            dimension.append(d)
            bit.append(b)
    return np.array(words, np.uint64).reshape(len(words), -(-len(x) // 64)), dimension, bit


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of each dimension, and of the products of each two (the second not before the first), of int64 rows."""
    n, size = x.shape
    least = [int(v) for v in x.min(0)]
    shifted = x.astype(np.uint64) - np.array([v % (1 << 64) for v in least], np.uint64)  # modulo 2^64: no range overflows
    words, dimension, bit = _planes(shifted)
    sums, products = [0] * size, [[0] * size for _ in range(size)]
    for k, (d, b) in enumerate(zip(dimension, bit, strict=True)):
        counts = np.bitwise_count(words[k] & words[k:]).sum(1, dtype=np.int64).tolist()
        sums[d] += counts[0] << b
        row = products[d]
        for m, c in enumerate(counts, k):
            # Planes of one dimension meet twice in its square, but for a plane with itself.
            row[dimension[m]] += c << b + bit[m] + (dimension[m] == d and m > k)
    whole = [s + n * v for s, v in zip(sums, least, strict=True)]
    for i in range(size):
        for j in range(i, size):
            products[i][j] += least[i] * sums[j] + least[j] * sums[i] + n * least[i] * least[j]
    return whole, products


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & (1 << LIMB) - 1))
        value >>= LIMB
    return out


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, i, j, limb, value): sums where i is -1, the number of rows where j is -1 too, else products."""
    held: dict[int, list[np.ndarray]] = {}
    total: dict[tuple[int, int, int], int] = {}

    def flush(size: int) -> None:
        x = np.concatenate(held.pop(size))
        sums, products = cross_products(x)
        add = lambda key, v: total.__setitem__(key, total.get(key, 0) + v)
        add((size, -1, -1), len(x))
        for i in range(size):
            add((size, -1, i), sums[i])
            for j in range(i, size):
                add((size, i, j), products[i][j])

    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy()
        for size in np.unique(lengths).tolist():
            part = _matrix(batch.filter(pa.array(lengths == size)).column("x"))
            held.setdefault(size, []).append(part)
            if sum(map(len, held[size])) >= ROWS:
                flush(size)
    for size in list(held):
        flush(size)
    rows = [(*key, k, v) for key, value in total.items() for k, v in enumerate(_limbs(value))]
    columns = zip(*rows) if rows else ((),) * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["size", "i", "j", "limb", "value"])


class Whitening:
    """Sums, count, components (as columns) and eigenvalues of vectors of one length."""

    def __init__(self, size: int, sums: dict[tuple[int, int], int]):
        get = lambda i, j: sums.get((i, j), 0)
        self.n = get(-1, -1)
        self.sums = [get(-1, i) for i in range(size)]
        centred = [[self.n * get(min(i, j), max(i, j)) - self.sums[i] * self.sums[j] for j in range(size)] for i in range(size)]
        square = self.n * self.n
        covariance = np.array([[v / square for v in row] for row in centred])  # of integers: rounded once
        values, vectors = np.linalg.eigh(covariance)
        most = min(COMPONENTS, size)
        self.vectors, self.values = vectors[:, ::-1][:, :most], np.maximum(values[::-1][:most], 0)
        self.sound = self.values > RANK * max(self.values[0], 0)
        trace = sum(centred[i][i] for i in range(size)) / square
        self.explained = self.values / trace if trace else np.zeros(most)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: int64 where that is wide enough, else Python's integers."""
        wide = self.n * (1 + max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, self.sums)) >= 1 << 62
        return (x.astype(object) if wide else x) * self.n - np.array(self.sums, object if wide else np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        d = self.centred(x)
        if d.dtype == object or int(np.abs(d).max()) > isqrt((1 << 62) // d.shape[1]):
            d = d.astype(object)
        return (d * d).sum(1).tolist()


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are dropped; an empty vector has no
    component and no row; null ids and repeated rows come out as they came in, and count once in the fit.
    Entries beyond the range of a long are its ends. ``deviation`` is exact as decimal(38, 0), null beyond.
    A component without variance (below ``RANK`` of the largest, as with fewer distinct vectors than components) has whitened null; without
    any variance identity_error is null and explained 0. ``n`` and identity_error are those of the
    vector's length. An empty table gives an empty one; other columns are left out.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.where(F.coalesce(F.forall("e", finite) & (F.size("e") > 0), F.lit(False)))
    rows = rows.select("vec_id", F.transform("e", lambda c: F.floor(c * STEPS)).alias("x"))
    fit = staged(rows.select("x").distinct(), "fit")
    parts = fit.mapInArrow(_scatter, "size int, i int, j int, limb int, value long").groupBy("size", "i", "j", "limb").agg(F.sum("value").alias("value"))
    sums: dict[int, dict[tuple[int, int], int]] = {}
    for size, i, j, limb, value in parts.collect():  # as many as a covariance has entries, however many rows
        own = sums.setdefault(size, {})
        own[i, j] = own.get((i, j), 0) + (value << LIMB * limb)
    models = {size: Whitening(size, own) for size, own in sums.items()}

    def by_size(batch: pa.RecordBatch) -> Iterator[tuple[Whitening, pa.RecordBatch, np.ndarray]]:
        lengths = batch.column("x").value_lengths().to_numpy()
        for size in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == size))
            yield models[size], part, _matrix(part.column("x"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count, means and centred products of whitened rows, a row for each length."""
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for model, _, x in by_size(batch):
                held[x.shape[1]] = _joined(held.get(x.shape[1]), _moments(model.whitened(x)[:, model.sound]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), *(pa.array([h[k].ravel().tolist() for h in held.values()], pa.list_(pa.float64())) for k in (1, 2))], names=["size", "n", "mean", "product"]
        )

    whole: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for size, n, mean, product in fit.mapInArrow(moments, "size int, n long, mean array<double>, product array<double>").orderBy("size", "n", "mean").collect():  # 21 numbers for each task
        whole[size] = _joined(whole.get(size), (n, np.array(mean), np.array(product).reshape(len(mean), len(mean))))
    errors = {size: float(np.abs(p / n - np.eye(len(p))).max()) if len(p) else None for size, (n, _, p) in whole.items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, part, x in by_size(batch):
                most = len(model.values)
                deviation = [Decimal(v) if v < 10**38 else None for v in model.deviation(x)]
                w = np.where(model.sound, model.whitened(x), np.nan)
                at = np.repeat(np.arange(len(x)), most)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)),
                        pa.array(np.tile(np.arange(1, most + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(at), model.n)),
                        pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(at)),
                        pa.array(w.ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, len(x))),
                        pa.array([errors[x.shape[1]]] * len(at), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _joined(a: tuple[int, np.ndarray, np.ndarray] | None, b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whitened_vectors(vectors: DataFrame) -> DataFrame:
    """``whiten`` with deviation as a long, null where it is beyond one."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as long)"))
