"""What the operators share: scratch tables, connected components, sums over texts."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and RE2 class; and the words themselves.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Texts are long: unless the session says otherwise, Arrow batches get 1000 rows, not 10000, which executors and their workers hold at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only where no such folder is set and Spark runs in this process alone (tests), one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there.

    Cuts the lineage, so a lost executor re-reads a file instead of redoing the work, and gives the
    planner true sizes, so it broadcasts what is small and splits skewed joins of what is not.
    """
    small_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sheltered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that no operator uses, and the new name of each column."""
    names = {c: f"in_{i}_" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def restored(names: dict[str, str], but: tuple[str, ...] = ()) -> list[Column]:
    """The sheltered columns under their own names."""
    return [F.col(n).alias(c) for c, n in names.items() if c not in but]


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``edges`` has long columns a and b. Returns (id, component): the smallest id of each component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every round is two
    partial aggregations and two equi-joins, and a star of any size needs no task of its own. Ids
    without an edge to another id are left out.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(limit):
        # Settled, if every id has one root, which has none itself.
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("id").agg(F.sum("below").alias("n"), F.max("above").alias("above")).where("n > 1 or n + above > 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large.where("u <> v"), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


FILTER_BITS, FILTER_BLOCK = 1 << 26, 1 << 20


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, set where a hash in column h falls: a fixed size. It only spares rows a join that would drop them."""

    def mark(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(_bit(batch.column("h").to_numpy().view(np.uint64)))
            for block in np.unique(at // FILTER_BLOCK).tolist():
                own = at[slice(*np.searchsorted(at, [block * FILTER_BLOCK, (block + 1) * FILTER_BLOCK]))] - block * FILTER_BLOCK
                blocks.setdefault(block, np.zeros(FILTER_BLOCK, bool))[own] = True
        rows = [(i, zlib.compress(np.packbits(x).tobytes(), 1)) for i, x in blocks.items()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bits"])

    def either(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in frame.bits])
        return frame.iloc[:1].assign(bits=[zlib.compress(out.tobytes(), 1)])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    step = FILTER_BLOCK // 8
    form = "block int, bits binary"
    for row in hashes.mapInArrow(mark, form).groupBy("block").applyInPandas(either, form).collect():  # FILTER_BITS bits in all
        out[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def has_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = _bit(h)
    return (bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1).astype(bool)


def ordered_sum(value: str, by: list[str], order: list) -> Column:
    """The sum of the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))
