"""Embedding near-duplicates by collision-counting projections (operator 3).

Vectors are compared within their label. A label's vectors are dealt to cells by the signs of a few
projections, in as many tables as recall needs; bits and tables grow with the logarithm of the largest
label, so cells keep their size. Within a cell many one-dimensional projections are sorted, a pair
counts one collision for each projection in which it lies in the window centred on the other, and
pairs with enough collisions, and no others, are verified by the cosine in double precision. Window and count are
calibrated to miss fewer than ``MISS`` of the pairs that just reach the threshold: one table of one cell
for a label of up to ``CELL`` vectors, where every pair is counted, and beyond it sign cells, of which a pair
at the threshold shares none with probability ``MISS`` / 2. In a cell the counts stand in a dense table of
block by block, as a window holds over a quarter of a cell.

Equal vectors are one representative with a multiplicity. A cell of many rows, such as a large group
of near copies, is compared block by block in tasks of their own, and yields counts and a spanning
forest instead of its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged

LEAST, MISS = 0.93, 0.001
CELL, BLOCK = 1000, 1000
PAIRS = 1 << 16
PROJECTIONS = 24


def tables_for(largest: int, least: float = LEAST) -> tuple[int, int]:
    """Bits of a cell and number of tables for a label of ``largest`` vectors."""
    bits = max(0, math.ceil(math.log2(max(1, largest / CELL))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, 1 if same >= 1 - MISS / 2 else math.ceil(math.log(MISS / 2) / math.log(1 - same))


def window_and_count(least: float = LEAST, projections: int = PROJECTIONS) -> tuple[float, int]:
    """Half width of a window, and the collisions that a pair at the threshold reaches but for MISS / 2."""
    width = math.sqrt(2 - 2 * least)  # one standard deviation of such a pair's distance in a projection
    p = math.erf(1 / math.sqrt(2))
    tail, count = 0.0, 0
    while (tail := tail + math.comb(projections, count) * p**count * (1 - p) ** (projections - count)) < MISS / 2:
        count += 1
    return width, count


def _directions(dimension: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, n))


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs; each pair once if both are the same rows."""
    width, enough = window_and_count(least)
    a = _directions(x.shape[1], PROJECTIONS, 2)
    p, q = x @ a, y @ a
    count = np.zeros((len(x), len(y)), np.uint8)
    for k in range(PROJECTIONS):
        order = np.argsort(q[:, k])
        rank = np.empty(len(y), np.int32)
        rank[order] = np.arange(len(y))
        low = np.searchsorted(q[order, k], p[:, k] - width).astype(np.int32)
        high = np.searchsorted(q[order, k], p[:, k] + width, "right").astype(np.int32)
        count += (rank >= low[:, None]) & (rank < high[:, None])
    passing = count >= enough
    if same:
        passing &= np.tri(len(x), k=-1, dtype=bool).T
    i, j = np.nonzero(passing)
    linked = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS):  # the passing pairs alone, some at a time
        some = slice(at, at + PAIRS)
        linked[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]]) >= least
    return i[linked], j[linked]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number that each is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows with a null id or label, and vectors that are null, empty, zero, or hold null or non-finite
    components, link with nothing; vectors of different lengths don't link. Rows that share an id and
    a vector are one vector. An empty table gives an empty one; other columns are left out.
    """
    e = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), e.alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("e", finite) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = [F.when(F.col("sound"), F.xxhash64(F.lit(s), "label", F.size("e"), "e")).alias(f"hash_{s}") for s in "ab"]
    light = staged(rows.select("vec_id", *key), "vectors")
    copies = ["hash_a", "hash_b"]
    sizes = rows.where("sound").select("label", *key, "vec_id", "e")
    reps = sizes.groupBy("label", *copies).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("e").alias("e"))
    reps = staged(reps, "reps")
    largest = reps.groupBy("label", F.size("e")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, least)
    power = 1 << np.arange(bits, dtype=np.int64)

    def cells(batches):
        for batch in batches:
            batch["codes"] = None
            for d, part in batch.groupby(batch.e.str.len()):
                signs = _unit(part.e) @ _directions(int(d), bits * tables, 1) > 0
                batch.loc[part.index, "codes"] = pd.Series(list((signs.reshape(len(part), tables, bits) * power).sum(2)), part.index)
            yield batch

    coded = staged(reps.select("rep", "n", "label", "e").mapInPandas(cells, "rep long, n long, label string, e array<double>, codes array<long>"), "coded")
    each = coded.select("*", F.size("e").alias("d"), F.posexplode("codes").alias("table", "code"))
    cell = ["label", "d", "table", "code"]
    blocks = staged(each.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "cells")
    dealt = each.join(blocks, cell).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        table, low, high = (int(frame[c].iloc[0]) for c in ("table", "low", "high"))
        frame = frame.sort_values("rep")
        rep, n, x, codes, own = frame.rep.to_numpy(), frame.n.to_numpy(), _unit(frame.e), np.stack(frame.codes), frame.own.to_numpy()
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = _linked(x[a], x[b], least, low == high) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        i, j = a[i], b[j]
        fresh = np.ones(len(i), bool)
        for t in range(table):  # else an earlier table has counted the pair
            fresh &= codes[i, t] != codes[j, t]
        links = np.bincount(i[fresh], n[j[fresh]], len(rep)) + np.bincount(j[fresh], n[i[fresh]], len(rep))
        root = rep[_roots(len(rep), i, j)]
        some = (links > 0) | (root != rep)
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]})

    found = dealt.select("rep", "n", "e", "codes", "own", *cell, "low", "high").groupBy(*cell, "low", "high").applyInPandas(compare, "rep long, links long, root long")
    found = staged(found, "links")
    near = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = reps.select(*copies, "rep", "n").join(counts, "rep", "left").join(near, F.col("rep") == F.col("id"), "left")
    per = staged(per.select(*copies, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    out = light.join(per, copies, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
