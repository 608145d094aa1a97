"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles (operator 7).

A document is the weighted set of its runs of five lower-case words; a weight is the run's count times
ln(1 + min(N / df, 256)), with N documents of which df have the run. The floor makes the statistics
scale: only runs in more than one document of 256 need their own df, and there are at most 256 times
as many of those as a document has runs, however large the corpus is. Both passes that find them read
every document. Each document gets 24 bands of 6 weighted samples (Ioffe 2010): a pair of weighted
Jaccard similarity 0.8 shares a band with probability 0.9993, a pair of 0.3 with 0.017.

Exact copies are one representative from the start. Documents are linked in three steps, each of which
leaves out pairs that are in one class already. Every document is compared with the smallest one that
leads a bucket of its own; then with the leaders of its other buckets; so a group of n copies costs
about n comparisons. A bucket that still holds several classes is compared across classes pair by pair
if that makes few pairs for each of its documents. Otherwise it is dealt out by 3 further bands of new
samples, other ones for each bucket (a pair of 0.8 shares 6 buckets, so 19 trials of probability 0.26),
and again, until that holds or ``LEVELS`` times. What samples miss there is found exactly: texts of such
buckets that are not all in one class by then are joined across classes by a prefix filter. Every link is
verified by the exact weighted Jaccard similarity. In a hot group near the threshold pairs still grow
faster than documents, as classes are those from before the buckets were dealt out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, connected_components, has_bits, staged, text_of
from .textvec import in_slices, mixed, shingles, words

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 6
FLOOR = 256  # df counts from N / FLOOR on
FEW = 8  # pairs across classes for each document of a bucket that is compared pair by pair
FURTHER, LEVELS = 3, 9  # bands that deal a large bucket out, and how often; the exact way follows
BUCKETS, BLOCK = 1 << 20, 1 << 14
_KEY = np.uint64((1 << 44) - 1)


class Idf(NamedTuple):
    """ln(1 + N / df) of the frequent shingles, by hash; all others have the largest value."""

    documents: int
    hashes: np.ndarray
    values: np.ndarray

    @property
    def most(self) -> float:
        return float(np.log1p(min(self.documents, FLOOR)))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.most)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[i] == h
            out[hit] = self.values[i[hit]]
        return out


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """(text, hash, count) of the distinct shingles, sorted by text, and the words."""
    w = words([t.lower().encode() for t in texts])
    text, h = shingles(w, WORDS)
    key = (text.astype(np.uint64) << np.uint64(44)) | (h & _KEY)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key & _KEY, count, w


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in in_slices(batches, "text"):
        yield batch, batch.column("text").to_pylist()


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many distinct shingles of texts fall in each hash bucket: ``BUCKETS`` numbers, however many texts there are."""

    def count(batches):
        sums = np.zeros(BUCKETS, np.int32)
        for _, texts in _texts(batches):
            sums += np.bincount(_bucket(_runs(texts)[1]), minlength=BUCKETS).astype(np.int32)
        blocks = [zlib.compress(x.tobytes(), 1) for x in sums.astype(np.int64).reshape(-1, BLOCK)]
        task = [TaskContext.get().partitionId() % 64] * len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(task, pa.int32()), pa.array(blocks, pa.binary())], names=["block", "part", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in frame.sums)
        return frame.iloc[:1].assign(sums=[zlib.compress(total.tobytes(), 1)])

    form = "block int, part int, sums binary"
    sums = docs.mapInArrow(count, form).groupBy("block", "part").applyInPandas(added, form).groupBy("block").applyInPandas(added, form)
    out = np.zeros(BUCKETS, np.int64)
    for block in sums.select("block", "sums").collect():  # BUCKETS numbers in all, compressed
        at = block["block"] * BLOCK
        out[at : at + BLOCK] = np.frombuffer(zlib.decompress(block["sums"]), np.int64)
    return out


def document_frequencies(docs: DataFrame) -> Idf:
    """Counts over all documents: first by hash bucket, then exactly where a bucket is frequent."""
    n = docs.count()
    limit = n / FLOOR
    frequent = bucket_counts(docs) > limit
    packed = np.packbits(frequent)

    def exact(batches):
        often = np.unpackbits(packed).astype(bool)
        for _, texts in _texts(batches):
            h = _runs(texts)[1]
            h, k = np.unique(h[often[_bucket(h)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(k, pa.int64())], names=["h", "k"])

    if not frequent.any():
        return Idf(n, np.zeros(0, np.uint64), np.zeros(0))
    rows = docs.mapInArrow(exact, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") > limit).toArrow().sort_by("h")
    return Idf(n, rows.column("h").to_numpy().astype(np.uint64), np.log1p(n / rows.column("k").to_numpy()))


class Sampler:
    """Consistent weighted samples. A sample's draws for a shingle are an entry of a table of 2^16, chosen by the sample's own hash of the shingle."""

    def __init__(self, most: float, samples: int, skip: int = 0, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << 16
        self.r, self.lnc = rng.gamma(2, 1, n).astype(np.float32), np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.beta = rng.random(n, np.float32)
        self.factor = (rng.integers(1 << 62, 1 << 63, skip + samples, np.uint64) * np.uint64(2) + np.uint64(1))[skip:]
        self.most = np.float32(np.log(np.float32(most)))
        self.usual = self._order(self._ln_a(self.r, self.lnc, self.beta, self.most))

    @staticmethod
    def _ln_a(r, lnc, beta, lnw):
        t = np.floor(lnw / r + beta)
        return lnc - r * (t - beta) - r

    @staticmethod
    def _order(x: np.ndarray) -> np.ndarray:
        """Upper 32 bits that sort as the numbers do."""
        bits = x.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << np.uint64(32)

    def __call__(self, text: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A sample in each row, a text that has shingles in each column: who is least, and at which weight."""
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        lnw = np.log(weight.astype(np.float32))
        other = np.flatnonzero(lnw != self.most)
        low = h & np.uint64(0xFFFFFFFF)
        out = np.empty((len(self.factor), len(first)), np.uint64)
        for j, factor in enumerate(self.factor):
            i = (h * factor >> np.uint64(48)).astype(np.int64)
            key = self.usual[i]
            if len(other):
                k = i[other]
                key[other] = self._order(self._ln_a(self.r[k], self.lnc[k], self.beta[k], lnw[other]))
            key |= low
            out[j] = np.minimum.reduceat(key, first)
        return out


def signatures(docs: DataFrame, idf: Idf, skip: int = 0) -> DataFrame:
    """(doc_id, hash_a, hash_b, bands): bands, after the first ``skip`` ones, are empty for a text without words."""

    def sign(batches):
        sampler = Sampler(idf.most, BANDS * ROWS, skip * ROWS)
        for batch, texts in _texts(batches):
            text, h, count, w = _runs(texts)
            bands = np.zeros((len(texts), 0), np.int64)
            has = np.zeros(len(texts), bool)
            if len(text):
                found = sampler(text, h, count * idf.of(h))
                has[text] = True
                keys = []
                for b in range(BANDS):
                    k = np.full(found.shape[1], skip + b, np.uint64)
                    for row in found[b * ROWS : (b + 1) * ROWS]:
                        k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + row)
                    keys.append(k)
                bands = np.stack(keys, 1).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has)]).astype(np.int32) * bands.shape[1], pa.array(bands.ravel(), pa.int64()))
            order = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(np.uint64)
            pair = []
            for q in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(w.hash * np.uint64(q) + mixed(order + np.uint64(q))))])
                pair.append(mixed(sums[w.first[1:]] - sums[w.first[:-1]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pair[0]), pa.array(pair[1]), lists], names=["doc_id", "hash_a", "hash_b", "bands"])

    return docs.mapInArrow(sign, "doc_id long, hash_a long, hash_b long, bands array<long>")


def weighted_jaccard(a: list[str], b: list[str], idf: Idf) -> np.ndarray:
    """Of each pair of texts."""
    text, h, count, _ = _runs([t for pair in zip(a, b, strict=True) for t in pair])
    weight = count * idf.of(h)
    pair, side = text // 2, text % 2
    order = np.lexsort((side, h, pair))
    pair, h, weight = pair[order], h[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    least = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), len(a))
    total = np.bincount(pair, weight, len(a))
    return least / np.maximum(total - least, 1e-300)


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity, with it."""

    def measure(batches):
        for batch in in_slices(batches, "text_a", "text_b"):
            s = weighted_jaccard(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), idf)
            found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s)], names=["a", "b", "similarity"])
            yield found.filter(pa.array(s >= least - 1e-12))

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(measure, "a long, b long, similarity double")


def _classed(rows: DataFrame, near: DataFrame | None, *ids: str) -> DataFrame:
    """With a column class_<id> for each of the ids."""
    for c in ids:
        if near is None:
            rows = rows.withColumn(f"class_{c}", F.col(c))
        else:
            own = near.select(F.col("id").alias(c), F.col("component").alias("found_"))
            rows = rows.join(own, c, "left").withColumn(f"class_{c}", F.coalesce("found_", c)).drop("found_")
    return rows


def _linked(docs: DataFrame, members: DataFrame, idf: Idf, least: float) -> DataFrame:
    """(id, component) of the documents that are linked; ``members`` has id and bucket."""
    leaders = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n"))
    leaders = staged(leaders.where("n > 1").drop("n"), "leaders")
    members = staged(members.join(leaders, "bucket"), "shared")
    follow = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    texts = _texts_of(docs, members)
    edges = lambda near: near.select(F.col("component").alias("a"), F.col("id").alias("b"))
    check = lambda pairs: staged(verified(pairs, texts, idf, least).select("a", "b"), "links")
    near = staged(connected_components(check(staged(follow.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs"))), "near")
    across = staged(_classed(follow.distinct(), near, "a", "b").where("class_a <> class_b").select("a", "b"), "pairs")
    if not across.isEmpty():
        near = staged(connected_components(check(across).unionByName(edges(near))), "near")
    # Buckets that still hold several classes.
    links, dealt = edges(near), None
    now = staged(_classed(members.select("id", "bucket"), near, "id").withColumnRenamed("class_id", "class"), "classed")
    for level in range(LEVELS + 1):
        sizes = now.groupBy("bucket", "class").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max(F.struct("k", "class"))["class"].alias("largest"))
        several = sizes.where("n * n > same").select("bucket", "largest", (F.col("n") * F.col("n") - F.col("same") > 2 * FEW * F.col("n")).alias("large"))
        now = staged(now.join(staged(several, "several"), "bucket"), "across")
        few = now.where("not large")  # of a pair across classes at least one is outside of the bucket's largest class
        left, right = (rows.select("bucket", F.col("id").alias(c), F.col("class").alias(f"class_{c}")) for rows, c in ((few.where("class <> largest"), "x"), (few, "y")))
        apart = left.join(right, "bucket").where("class_x <> class_y")
        pairs = staged(apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        links = links.unionByName(check(pairs))
        rest = now.where("large").select("bucket", "id", "class")
        if rest.isEmpty():
            break
        if dealt is None:
            dealt = rest.select("bucket", "id")
        if level == LEVELS:
            break
        again = texts.join(rest.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        more = staged(signatures(again, idf, skip=BANDS * (level + 1)).select(F.col("doc_id").alias("id"), "bands"), "bands")
        chosen = F.explode(F.array(*(F.get("bands", F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(BANDS)).cast("int")) for k in range(FURTHER)))).alias("band")
        now = staged(rest.join(more, "id").select("id", "class", "bucket", chosen).select("id", F.xxhash64("bucket", "band").alias("bucket"), "class").distinct(), "dealt")
    if dealt is None:
        return connected_components(links)
    # Dealing out misses some links: the exact way, for what is not in one class by now.
    near = staged(connected_components(links), "near")
    now = _classed(dealt, near, "id").withColumnRenamed("class_id", "class")
    mixed_ = now.groupBy("bucket").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> last").select("bucket")
    rest = staged(now.join(staged(mixed_, "mixed"), "bucket").select("id", "class").distinct(), "rest")
    if rest.isEmpty():
        return near
    pairs = staged(_alike(texts.join(rest.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), rest, idf, least), "pairs")
    return connected_components(edges(near).unionByName(check(pairs)))


def _outside(rows: DataFrame, key: str) -> DataFrame:
    """The rows that are not in the largest class of their key: of a pair across classes at least one is such a row."""
    sizes = rows.groupBy(key, "class").agg(F.count("*").alias("k"))
    largest = sizes.groupBy(key).agg(F.max(F.struct("k", "class"))["class"].alias("largest"))
    return rows.join(staged(largest, "largest"), key).where("class <> largest").drop("largest")


def _alike(texts: DataFrame, classes: DataFrame, idf: Idf, least: float) -> DataFrame:
    """(a, b) across ``classes`` (id, class) that hold all pairs of the similarity: a prefix filter, exact for weighted Jaccard.

    Shingles are ordered by how few of these texts' shingles share their bucket. A pair of weights x <= y that
    reaches s shares at least 2 s / (1 + s) x and s y; so it shares a shingle within the first part of each text
    that leaves less than that behind, and x >= s y. After the first shared shingle the shared weight is at most
    the lesser of what the texts have from there on. Any order would do, so one by counts of a fixed size does:
    a text is put in order where it is read, and gives a row for each shingle of its first fifth only.
    """
    counts = bucket_counts(texts)
    levels = texts.sparkSession.sparkContext.broadcast(np.ceil(8 * np.log2(np.maximum(counts, 1))).astype(np.uint8))
    near = 1 - 1e-6

    def start(batches):
        for batch, found in _texts(batches):
            text, h, count, _ = _runs(found)
            weight, level = count * idf.of(h), levels.value[_bucket(h)]
            order = np.lexsort((h, level, text))
            h, weight, level = h[order], weight[order], level[order]
            total = np.bincount(text, weight, len(found))
            before = np.concatenate([[0], np.cumsum(weight)])
            left = total[text] - (before[:-1] - before[np.searchsorted(text, text)])
            kept = np.flatnonzero((level > 0) & (left >= least * near * total[text]))  # a shingle of one text comes first and joins with none
            ids = batch.column("doc_id").to_numpy()[text[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h[kept].astype(np.int64)), pa.array(total[text[kept]]), pa.array(left[kept])], names=["id", "h", "total", "left"])

    first = staged(texts.mapInArrow(start, "id long, h long, total double, left double").join(classes, "id"), "first")
    names = lambda rows, c: rows.select("h", *(F.col(x).alias(f"{x}_{c}") for x in ("id", "class", "total", "left")))
    x, y = names(staged(_outside(first, "h"), "outside"), "x"), names(first, "y")
    lesser = F.least("total_x", "total_y")
    shared = F.least("left_x", "left_y") >= least / (1 + least) * near * (F.col("total_x") + F.col("total_y"))
    part = F.when(F.col("total_x") <= F.col("total_y"), F.col("left_x")).otherwise(F.col("left_y")) >= 2 * least / (1 + least) * near * lesser
    found = x.join(y, "h").where((F.col("class_x") != F.col("class_y")) & (lesser >= least * near * F.greatest("total_x", "total_y")) & shared & part)
    return found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, text) of the members. A filter of fixed size drops most other texts where they are read."""
    needed = members.select(F.col("id").alias("doc_id")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(members.select(F.xxhash64("id").alias("h"))))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bits(bits.value, batch.column("h").to_numpy().view(np.uint64))))

    near = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(some, "doc_id long, text string, h long")
    # Rows that share an id are one document: any one of its texts stands for it.
    return staged(near.drop("h").join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (smallest id of its class), kept.

    Texts with the same lower-case words are copies; texts without words, null ones included, are
    copies of each other. A text of fewer than five words is one shingle. Rows that share an id are
    one document. A row without an id belongs to its text's class, if that has an id, and else has no
    class and is kept. An empty table gives an empty one; other columns are left out.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    idf = document_frequencies(docs)
    light = staged(signatures(docs, idf), "signatures")
    copies = ["hash_a", "hash_b"]
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "bands"))
    classes = staged(light.groupBy(*copies).agg(F.min(own).alias("own")).select(*copies, F.col("own.doc_id").alias("rep"), F.col("own.bands").alias("bands")), "classes")
    members = classes.where("rep is not null").select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    near = staged(_linked(docs, members, idf, least), "near")
    found = classes.join(near, classes["rep"] == near["id"], "left").select(*copies, F.coalesce("component", "rep").alias("component_id"))
    out = light.select("doc_id", *copies).join(staged(found, "components"), copies)
    return out.select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
