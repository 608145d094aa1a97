"""Mixing sources to target weights (operator 4), DataFrame functions only.

Every source is cut into about sqrt(documents) blocks. A source's share of the mix is met by whole
passes over its blocks, and a last pass that takes permuted blocks until the target is reached, the
last block and its last document in part. The block draws are dealt to output shards by a splitting
tree: the root holds the exact quota of each source, and every node gives its left child a
multivariate-hypergeometric draw of half of its quotas (one hypergeometric draw per source, each
given the ones before), so the leaves hold exact, disjoint quotas. Leaf ranges then index each
source's permuted blocks, and rows are shuffled within their shard.

Sources are a dimension: one row of the tree holds an array with one count per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, ordered_sum, restored, sheltered, staged, text_of

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
WORDS_PER_SHARD, LEAST_DEPTH = 1 << 22, 6
_ADDED = ("size", "source_size", "target", "taken", "draws")


def _number(text: Column) -> Column:
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _key(column: str) -> list[Column]:
    return [F.coalesce(F.col(column).cast("string"), F.lit("")).alias("s_"), F.col(column).isNull().alias("null_")]


SOURCE = ["s_", "null_"]


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per source: n, source_size, rank, weight, target. ``sized`` has s_, null_, size."""
    rows = sized.groupBy(*SOURCE).agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("null_", "s_")) - 1
    pick = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("rank", rank).withColumn("weight", pick).withColumn("cap", F.lit(most) * F.col("source_size"))
    # Water level: in order of cap by weight, the first source that stays below its cap sets it.
    upward = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("rest", F.sum("weight").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("filled", F.coalesce(F.sum("cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("filled")) / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("filled", "rest", "level"))).over(everything)["level"])
    )
    full = F.col("cap").cast("double")
    target = F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("weight")))
    return rows.select(*SOURCE, "n", "source_size", "rank", "weight", target.alias("target"))


def _ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, stepped down; exact to about 1e-11."""
    z = n + F.lit(8.0)
    step = (n + 1) * (n + 2) * (n + 3) * (n + 4) * (n + 5) * (n + 6) * (n + 7)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(step)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``total``, by inversion within 12 standard deviations of the mean."""
    f = _ln_factorial
    mean = drawn * marked / total
    width = F.lit(12.0) * F.sqrt(mean * (1 - marked / total)) + 20
    low = F.greatest(F.lit(0.0), drawn - (total - marked), F.floor(mean - width).cast("double")).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + width).cast("double")).cast("long")
    fixed = f(marked) + f(total - marked) + f(drawn) + f(total - drawn) - f(total)

    def step(state, k):
        p = F.exp(fixed - f(k) - f(marked - k) - f(drawn - k) - f(total - marked - drawn + k))
        more = state["sum"] < u
        return F.struct(F.when(more, state["sum"] + p).otherwise(state["sum"]).alias("sum"), F.when(more, k).otherwise(state["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))
    return F.aggregate(F.sequence(low, high), start, step, lambda s: s["k"])


def splitting_tree(quotas: DataFrame, depth: int, seed: str) -> DataFrame:
    """``quotas``: rank, draws. Returns (rank, shard, draws): exact quotas of 2**depth shards."""
    both = F.sort_array(F.collect_list(F.struct("rank", "draws")))
    nodes = quotas.agg(both.alias("q")).select(F.lit(1).cast("long").alias("node"), F.col("q.rank").alias("ranks"), F.col("q.draws").alias("q"))
    for _ in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)

        def step(state, x):
            u = (_number(F.concat_ws(":", F.lit(seed), F.col("node").cast("string"), F.size(state["left"]).cast("string"))) + 0.5) / float(1 << 60)
            d = lambda c: c.cast("double")
            h = F.when((state["n"] == 0) | (x == 0), F.lit(0).cast("long")).otherwise(_hypergeometric(d(state["total"]), d(x), d(state["n"]), u))
            return F.struct((state["total"] - x).alias("total"), (state["n"] - h).alias("n"), F.concat(state["left"], F.array(h)).alias("left"))

        start = F.struct(F.col("total").alias("total"), F.floor(F.col("total") / 2).alias("n"), F.array().cast("array<bigint>").alias("left"))
        left = F.aggregate("q", start, step, lambda s: s["left"])
        split = nodes.withColumn("total", total).withColumn("left", left)
        right = F.zip_with("q", "left", lambda a, b: a - b)
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q"))))
        nodes = split.select("ranks", child.alias("c")).select("c.node", "ranks", "c.q")
    leaf = F.explode(F.arrays_zip("ranks", "q")).alias("x")
    return nodes.select((F.col("node") - (1 << depth)).alias("shard"), leaf).select(F.col("x.ranks").alias("rank"), "shard", F.col("x.q").alias("draws"))


def mix_documents(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """``docs`` with size, source_size, target, taken, and ``draws``: array of (epoch, shard, words).

    Each draw puts the document's first ``words`` words (all but in the last document of a last pass)
    into a shard. Null texts and texts without a word have size 0 and are never taken; null sources
    form one source, last in order; null or repeated doc_ids and repeated rows are rows like others
    (equal rows may share the last, partial draw in either order). An empty table gives an empty
    one. Columns that clash with the added ones are replaced.
    """
    rows, names = sheltered(docs)
    mixed = _mixed(rows, names[text], names[source], names[doc_id], weights, share, most, seed)
    return mixed.select(*restored(names, _ADDED), *_ADDED)


def _mixed(docs: DataFrame, text: str, source: str, doc_id: str, weights, share: float, most: int, seed: str) -> DataFrame:
    keep = docs.columns
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    sized = docs.select(*keep, n_words(text_of(text)).alias("size"), *_key(source)).withColumn("h_", _number(F.concat_ws(":", F.lit(seed), id_text)))
    light = staged(sized.select(*SOURCE, "h_", "size"), "sizes")
    sources = staged(source_targets(light, weights, share, most).withColumn("blocks", F.ceil(F.sqrt("n"))), "sources")
    block = F.pmod("h_", "blocks").alias("block")
    blocks = light.join(sources, SOURCE).select(*SOURCE, "size", block).groupBy(*SOURCE, "block").agg(F.sum("size").alias("words"))
    # Whole passes, then one that stops at the target.
    blocks = blocks.join(sources, SOURCE).withColumn("whole", F.round("target").cast("long")).where("source_size > 0")
    blocks = blocks.withColumn("passes", F.floor(F.col("whole") / F.col("source_size"))).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    in_epoch = [*SOURCE, "rank", "epoch"]
    permuted = [_number(F.concat_ws(":", F.lit(f"{seed} block"), *(F.col(c).cast("string") for c in ("epoch", "s_", "block")))), F.col("block")]
    before = ordered_sum("words", in_epoch, permuted)
    nth = F.row_number().over(Window.partitionBy(*in_epoch).orderBy(*permuted)) - 1
    rest = F.when(F.col("epoch") < F.col("passes"), F.col("source_size")).otherwise(F.col("whole") - F.col("passes") * F.col("source_size"))
    taken = F.greatest(F.lit(0), F.least("words", rest - F.col("before")))
    drawn = blocks.withColumn("before", before).withColumn("nth", nth).withColumn("block_taken", taken).where("block_taken > 0")
    # Empty blocks leave gaps: number the draws anew.
    drawn = drawn.withColumn("j", F.row_number().over(Window.partitionBy(*SOURCE, "rank").orderBy("epoch", "nth")) - 1)
    drawn = staged(drawn.select(*SOURCE, "rank", "block", "epoch", "j", "block_taken"), "draws")
    words = drawn.agg(F.sum("block_taken")).first()[0] or 0
    depth = max(LEAST_DEPTH, math.ceil(math.log2(max(1, words / WORDS_PER_SHARD))))
    leaves = splitting_tree(drawn.groupBy("rank").agg(F.count("*").alias("draws")), depth, seed)
    leaves = leaves.withColumn("first", ordered_sum("draws", ["rank"], ["shard"])).where("draws > 0")
    dealt = leaves.select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("draws") - 1)).alias("j"))
    dealt = drawn.join(dealt, ["rank", "j"]).groupBy(*SOURCE, "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "block_taken"))).alias("dealt"))
    dealt = staged(dealt, "dealt")
    out = sized.join(sources.select(*SOURCE, "source_size", "target", "blocks"), SOURCE).withColumn("block", F.pmod("h_", "blocks"))
    out = out.join(dealt, [*SOURCE, "block"], "left").withColumn("before_", ordered_sum("size", [*SOURCE, "block"], ["h_", id_text, "size"]))
    part = lambda d: F.greatest(F.lit(0), F.least(F.col("size"), d["block_taken"] - F.col("before_")))
    draws = F.filter(F.transform("dealt", lambda d: F.struct(d["epoch"], d["shard"], part(d).alias("words"))), lambda d: d["words"] > 0)
    none = F.array().cast("array<struct<epoch:bigint,shard:bigint,words:bigint>>")
    out = out.withColumn("draws", F.coalesce(draws, none))
    return out.select(*keep, "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws")


def mixed_rows(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per draw, in shards and shuffled within each."""
    rows, names = sheltered(docs)
    text, doc_id, n_chars = names[text], names[doc_id], names.get("n_chars")
    mixed = _mixed(rows, text, names[source], doc_id, weights, share, most, seed).withColumn("d_", F.explode("draws"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("d_.words").cast("int")), "")
    mixed = mixed.withColumn(text, F.when(F.col("d_.words") < F.col("size"), cut).otherwise(F.col(text)))
    if n_chars:
        mixed = mixed.withColumn(n_chars, F.when(F.col("d_.words") < F.col("size"), F.length(text).cast("long")).otherwise(F.col(n_chars)))
    order = F.xxhash64(F.lit(seed), F.col("d_.shard"), F.col("d_.epoch"), F.col(doc_id))
    return mixed.withColumn("shard_", F.col("d_.shard")).repartition("shard_").sortWithinPartitions("shard_", order).select(*restored(names))


#: The query's rows in DuckDB: targets by water level, draws by the same permuted blocks. Shards do not show in these columns.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') s_, source IS NULL null_, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  coalesce(CAST(doc_id AS VARCHAR), 'null') id_text FROM documents),
d2 AS (SELECT *, CAST('0x' || substr(md5('mix:' || id_text), 1, 15) AS BIGINT) h_ FROM d),
s0 AS (SELECT s_, null_, count(*) n, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY null_, s_) - 1 AS rank FROM d2 GROUP BY s_, null_),
s1 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END weight, 2 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) filled, sum(source_size) OVER () everything FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * everything::DOUBLE - filled::DOUBLE) / rest::DOUBLE lvl FROM s2),
s4 AS (SELECT *, (SELECT arg_min(lvl, filled::DOUBLE * 1e9 + (1e9 - rest::DOUBLE)) FROM s3 WHERE lvl * weight <= cap) AS level FROM s3),
s AS (SELECT s_, null_, n, source_size, coalesce(least(cap::DOUBLE, level * weight), cap::DOUBLE) target, CAST(ceil(sqrt(n)) AS BIGINT) blocks FROM s4),
d3 AS (SELECT d2.*, s.source_size, s.target, d2.h_ % s.blocks AS block, CAST(round(s.target) AS BIGINT) whole FROM d2 JOIN s ON d2.s_ = s.s_ AND d2.null_ = s.null_),
b AS (SELECT s_, null_, block, any_value(source_size) source_size, any_value(whole) whole, CAST(sum(size) AS BIGINT) words FROM d3 GROUP BY s_, null_, block HAVING any_value(source_size) > 0),
b2 AS (SELECT *, whole // source_size AS passes, whole % source_size AS rest,
  coalesce(sum(words) OVER (PARTITION BY s_, null_ ORDER BY CAST('0x' || substr(md5('mix block:' || CAST(whole // source_size AS VARCHAR) || ':' || s_ || ':' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
d4 AS (SELECT d3.*, coalesce(b2.passes, 0) passes, greatest(0, least(b2.words, b2.rest - b2.before)) last_words,
  coalesce(sum(d3.size) OVER (PARTITION BY d3.s_, d3.null_, d3.block ORDER BY h_, id_text, d3.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d3 LEFT JOIN b2 ON d3.s_ = b2.s_ AND d3.null_ = b2.null_ AND d3.block = b2.block)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, coalesce(last_words, 0) - ahead)) AS BIGINT) taken FROM d4
"""


def mix_digests(docs: DataFrame) -> DataFrame:
    """The columns of query op4."""
    return mix_documents(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
