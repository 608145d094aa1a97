"""Approximate nearest neighbours by a hash-prefix forest (operator 11).

Every distinct vector gets one long hash string per tree, a bit for the side of each of ``BITS`` random
hyperplanes. A tree is a sorted array of its strings, cut into blocks of about ``BLOCK`` rows. A query
descends to the rows that share a long beginning with its string and ascends in all trees at once, a bit
at a time, until the trees together hold enough candidates; those are compared by cosine in double
precision. A dense place is thus searched at long beginnings and a sparse one at short ones.

Where to cut the arrays, and how many rows lie below a beginning, is estimated from the strings of about
``SAMPLE`` vectors. How many candidates are enough is calibrated: about ``PROBES`` queries are compared
with every vector, and the least number is taken with which the forest finds ``RECALL`` of their nearest.
So recall holds at every size, and the price follows the data: rows that lie far apart in all directions,
with no near ones to find, ask for a large part of them, clustered ones for a small part.

Equal vectors are one vector with the smallest of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

TREES, BITS = 8, 48
SAMPLE, PROBES = 1 << 16, 256
BLOCK, BLOCKS = 2048, 4096
NEAREST, RECALL = 5, 0.97
LEAST = 64


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors from a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _as_lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), kind))


def hash_strings(x: np.ndarray) -> np.ndarray:
    """One number of ``BITS`` bits per row and tree; the first bit is the highest."""
    planes = np.random.default_rng([11, x.shape[1]]).standard_normal((x.shape[1], TREES * BITS))
    power = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return ((x @ planes > 0).reshape(len(x), TREES, BITS) * power).sum(2)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def interval(codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string with the same ``level`` bits at the beginning."""
    rest = (np.int64(1) << (BITS - level)) - 1
    return codes & ~rest, codes | rest


class Forest:
    """What the sample knows: where sorted arrays are cut, and about how many vectors a beginning holds."""

    def __init__(self, sample: np.ndarray, n: int):
        self.trees = np.sort(sample, axis=0).T.copy()
        self.scale = n / max(1, len(sample))
        blocks = min(BLOCKS, -(-n // BLOCK))
        at = np.arange(1, blocks) * len(sample) // blocks
        self.cuts = self.trees[:, at]
        self.enough = float(LEAST)

    def blocks_of(self, codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Block of each vector in each tree; vectors whose string several cuts share are dealt over the blocks between."""
        low, high = (np.stack([np.searchsorted(c, codes[:, t], side) for t, c in enumerate(self.cuts)], 1) for side in ("left", "right"))
        return low + salt[:, None] % (high - low + 1)

    def level(self, codes: np.ndarray, sampled: np.ndarray, enough: float) -> np.ndarray:
        """The longest beginning below which all trees together hold enough vectors, the query's own left out."""
        counts = np.zeros((len(codes), BITS + 1))
        for level in range(BITS + 1):
            for t, tree in enumerate(self.trees):
                low, high = interval(codes[:, t], np.int64(level))
                counts[:, level] += np.searchsorted(tree, high, "right") - np.searchsorted(tree, low) - sampled
        reached = counts * self.scale >= enough
        return np.where(reached.any(1), BITS - np.argmax(reached[:, ::-1], axis=1), 0)


def _best(scores: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest scores, ties by the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return at[np.lexsort((low[at], -scores[at]))[:most]]


def _calibrated(coded: DataFrame, asked: int, forest: Forest) -> float:
    """Fewest candidates with which ``RECALL`` of the probes' nearest vectors are found; the probes meet every vector."""
    probes = coded.where("asked").where(_share("rep", PROBES / asked, 7)).select("rep", "e", "codes", "sampled").toArrow()
    if not len(probes):
        probes = coded.where("asked").orderBy("rep").limit(1).select("rep", "e", "codes", "sampled").toArrow()
    names, own = np.array(probes["rep"].to_pylist()), _lists(probes["codes"].combine_chunks())
    x = _vectors(probes["e"])
    sampled = probes["sampled"].to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros((0, 2))] * len(x)
        for batch in batches:
            if not len(batch):
                continue
            scores = _vectors(batch.column("e")) @ x.T
            codes, reps = _lists(batch.column("codes")), np.array(batch.column("rep").to_pylist())
            for k in range(len(x)):
                s = np.where(reps == names[k], -2, scores[:, k])
                top = np.argpartition(-s, min(NEAREST, len(s)) - 1)[:NEAREST]
                found = np.stack([s[top], shared(codes[top], own[k]).max(1)], 1)
                found = np.concatenate([kept[k], found[found[:, 0] > -2]])
                kept[k] = found[np.argsort(-found[:, 0])[:NEAREST]]
        probe = np.repeat(np.arange(len(x)), [len(f) for f in kept])
        rows = np.concatenate(kept)
        yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["probe", "score", "depth"])

    near = coded.select("rep", "e", "codes").mapInArrow(compare, "probe long, score double, depth double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), F.desc("depth")))
    near = near.withColumn("place", place).where(F.col("place") <= NEAREST).select("probe", "depth").toPandas()  # a few rows for each probe
    enough = float(LEAST)
    while True:
        level = forest.level(own, sampled, enough)
        if not len(near) or (level[near.probe] <= near.depth).mean() >= RECALL or not level.any():
            return enough
        enough *= 2**0.25


def _share(column: str, share: float, seed: int) -> F.Column:
    """About this share of all values of a column, always the same."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def _search(queries: DataFrame, coded: DataFrame, forest: Forest, element: str) -> DataFrame:
    """(q, c, score): for each query of a level, the nearest others of those below its beginnings."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = np.array([hash_of(r) for r in batch.column("rep").to_pylist()], np.int64)
            blocks = forest.blocks_of(_lists(batch.column("codes")), salt) if len(batch) else np.zeros((0, TREES), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, _as_lists(blocks, pa.int64())], names=[*batch.schema.names, "blocks"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, level = _lists(batch.column("codes")), batch.column("level").to_numpy()
            for t in range(TREES if len(batch) else 0):
                low, high = interval(codes[:, t], level)
                first, last = np.searchsorted(forest.cuts[t], low), np.searchsorted(forest.cuts[t], high, "right")
                n = last - first + 1
                at = np.repeat(np.arange(len(batch)), n)
                block = np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                for part in range(0, len(at), 4096):
                    some = slice(part, part + 4096)
                    rows = batch.select(["rep", "e"]).take(pa.array(at[some]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t), pa.int32()), pa.array(block[some], pa.int64()), pa.array(low[at[some]]), pa.array(high[at[some]]), *rows.columns], names=["tree", "block", "first", "last", "q", "e"])

    def within(mine: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(mine) and len(rows):
            codes = rows["code"].to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, x, low = codes[order], _vectors(rows["e"])[order], rows["low"].to_numpy()[order]
            reps, names, y = np.array(rows["rep"].to_pylist())[order], mine["q"].to_pylist(), _vectors(mine["e"])
            a, b = np.searchsorted(codes, mine["first"].to_numpy()), np.searchsorted(codes, mine["last"].to_numpy(), "right")
            for k, name in enumerate(names):
                top = a[k] + _best(x[a[k] : b[k]] @ y[k], low[a[k] : b[k]], NEAREST + 1)
                top = top[reps[top] != name]
                out[0].extend([name] * len(top))
                out[1].extend(reps[top].tolist())
                out[2].extend((x[top] * y[k]).sum(1).tolist())
        return pa.table({"q": pa.array(out[0], pa.string()), "c": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    vector = f"e array<{element}>"
    points = coded.select("rep", "low", "e", "codes").mapInArrow(deal, f"rep string, low long, {vector}, codes array<long>, blocks array<long>")
    points = points.select("rep", "low", "e", F.posexplode(F.arrays_zip("codes", "blocks")).alias("tree", "at")).select("tree", F.col("at.blocks").alias("block"), F.col("at.codes").alias("code"), "rep", "low", "e")
    visits = queries.select("rep", "e", "codes", "level").mapInArrow(visit, f"tree int, block long, first long, last long, q string, {vector}")
    found = visits.groupBy("tree", "block").cogroup(points.groupBy("tree", "block")).applyInArrow(within, "q string, c string, score double")
    return found.groupBy("q", "c").agg(F.max("score").alias("score"))  # found in several trees


def hash_of(rep: str) -> int:
    return int(rep.split("/")[0]) & 0x7FFFFFFF


def nearest_vectors(vectors: DataFrame, queries: F.Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The nearest other rows of each row for which ``queries`` holds: query_id, rank, vec_id, score.

    ``queries`` is a condition on the id. Nearness is the cosine in double precision; ties go to the
    smaller id. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Vectors of different lengths are never near. Equal rows are one row; rows
    that share an id alone are rows of their own, and each is a query. Where fewer rows than asked for
    exist, all come. An empty table gives an empty one; other columns are left out.
    """
    given = vectors.schema[embedding].dataType
    element = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{element}>").alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.forall("e", finite) & F.exists("e", lambda x: x != 0)
    key = F.concat_ws("/", *(F.xxhash64(F.lit(s), F.size("e"), F.transform("e", lambda x: x + F.lit(0).cast(element))) for s in "ab"))  # plus 0: one kind of zero
    rows = rows.where(F.coalesce(sound, F.lit(False))).withColumn("rep", key)
    light = staged(rows.select("vec_id", "rep").distinct(), "ids")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    ids = light.withColumn("place", place).where(F.col("place") <= NEAREST + 1).groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    ids = staged(ids, "smallest")
    reps = rows.groupBy("rep").agg(F.first("e").alias("e"), F.min("vec_id").alias("low"), F.bool_or(queries).alias("asked"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            size = e.value_lengths().to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                x = _vectors(part.column("e"))
                yield pa.RecordBatch.from_arrays([*part.columns, _as_lists(hash_strings(x), pa.int64()), pa.array((x * x).sum(1))], names=[*part.schema.names, "codes", "own"])

    coded = staged(reps.mapInArrow(code, f"rep string, e array<{element}>, low long, asked boolean, codes array<long>, own double"), "coded")
    parts = coded.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).where("asked > 0").collect()  # a row for each length
    found = [coded.where("asked").select(F.col("rep").alias("q"), F.col("rep").alias("c"), F.col("own").alias("score"))]
    for d, n, asked in parts:
        some = coded.where(F.size("e") == d).withColumn("sampled", _share("rep", SAMPLE / n, 5))
        forest = Forest(_lists(some.where("sampled").select("codes").toArrow()["codes"].combine_chunks()), n)
        forest.enough = _calibrated(some, asked, forest)

        def levels(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                level = forest.level(_lists(batch.column("codes")), batch.column("sampled").to_numpy(zero_copy_only=False), forest.enough) if len(batch) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(level, pa.int64())], names=["rep", "e", "codes", "level"])

        now = some.where("asked").select("rep", "e", "codes", "sampled").mapInArrow(levels, f"rep string, e array<{element}>, codes array<long>, level long")
        now = staged(now, "queries")
        while True:
            place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low", "c"))
            pairs = _search(now, some, forest, element).join(coded.select(F.col("rep").alias("c"), "low"), "c")
            pairs = staged(pairs.withColumn("place", place).where(F.col("place") <= NEAREST).select("q", "c", "score"), "found")
            found.append(pairs)
            # Queries that have found too few ascend further; at level 0 all vectors are candidates.
            others = pairs.unionByName(found[0]).join(ids.select(F.col("rep").alias("c"), F.size("ids").alias("n")), "c").groupBy(F.col("q").alias("rep")).agg(F.sum("n").alias("n"))
            short = now.where("level > 0").join(others, "rep").where(F.col("n") <= NEAREST).select("rep", "e", "codes", F.floor(F.col("level") / 2).alias("level"))
            short = staged(short, "queries")
            if short.isEmpty():
                break
            now = short
    pairs = reduce(DataFrame.unionByName, found).groupBy("q", "c").agg(F.max("score").alias("score"))
    each = pairs.join(ids.withColumnRenamed("rep", "c"), "c").select("q", "c", "score", F.explode("ids").alias("vec_id"))
    asking = light.where(queries).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q"))
    near = asking.join(each, "q").where("vec_id <> query_id or c <> q")
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id", "c")).alias("rank")
    return near.select("query_id", place, "vec_id", "score").where(F.col("rank") <= NEAREST)


def nearest_of_fiftieths(vectors: DataFrame) -> DataFrame:
    """``nearest_vectors`` of the rows whose id is divisible by 50."""
    return nearest_vectors(vectors, F.pmod("vec_id", F.lit(50)) == 0)
