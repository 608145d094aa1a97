"""Removal of repeated byte strings by threshold-bounded interval expansion (operator 1).

A string of ``length`` bytes that starts twice or more anywhere has the same minimizer (the least hash
among its 50-byte strings) at the same place each time. So texts are cut into contexts, one for each
minimizer, and only contexts of a minimizer that occurs again can repeat. Where all its contexts are
equal they repeat as a whole; where they differ, distinct contexts meet in a task, which sorts their
suffixes as far as ``length`` bytes, takes the Burrows-Wheeler transform and extends intervals backwards,
breadth first: common prefixes come out by increasing value, up to ``length``, and suffixes that are
never parted share so many bytes. What repeats is then marked in every text that has the context.

A minimizer with very many distinct contexts (a line that precedes many texts) is split by what its
strings must share: strings that reach at least so far to the left on one side, and those that don't
but then reach far to the right on the other, again and again until few contexts share a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, has_bits, staged, text_of
from .textvec import in_slices, mixed, powers, rolling, span_hash

LENGTH, SHARE = 200, 4  # minimizers have length / SHARE bytes
SEGMENT = 8 << 20  # longer texts are cut, with an overlap of length - 1
GROUP_CONTEXTS, TASK_BYTES = 3000, 1 << 20


# --- one task's suffixes -------------------------------------------------------------------------


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    step = np.concatenate([[0], key[order][1:] != key[order][:-1]])
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(step)
    return order, rank


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions in order of at least their first ``length`` symbols (below 512), by prefix doubling."""
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(len(symbols), np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | padded[j : j + len(symbols)]
    order, rank = _ranked(key)
    known = 7
    while known < length:
        ahead = np.zeros(len(symbols), np.uint64)
        ahead[:-known] = rank[known:] + np.uint64(1)
        order, rank = _ranked(rank * np.uint64(len(symbols) + 1) + ahead)
        known *= 2
    return order


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of ``length`` symbols that starts elsewhere too; 0 separates and ends strings."""
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1].astype(np.int64)
    by_symbol = np.argsort(bwt, kind="stable")
    follow = np.empty(n, np.int64)  # C[c] + rank of c
    follow[by_symbol] = np.arange(n)
    parted = np.zeros(n + 1, bool)
    parted[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for value in range(1, length + 1):
        size = high - low
        one = size == 1
        single = low[one]
        single = single[bwt[single] != 0] if value > 1 else single
        new_low, new_high = [follow[single]], [follow[single] + 1]
        if not one.all():
            a, k = low[~one], size[~one]
            which = np.repeat(np.arange(len(a)), k)
            at = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(a, k)
            c = bwt[at]
            if value > 1:
                which, at, c = which[c != 0], at[c != 0], c[c != 0]
            key = which << 9 | c
            by = np.argsort(key, kind="stable")
            key, at = key[by], at[by]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
            new_low.append(follow[at[edge[:-1]]])
            new_high.append(follow[at[edge[1:] - 1]] + 1 if len(key) else np.zeros(0, np.int64))
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~parted[high]  # set by now: a shorter prefix parts them already
        low, high = low[fresh], high[fresh]
        parted[high] = True
        if not len(low):
            break
    first = parted[:n]
    last = parted[1:]
    out = np.empty(n, bool)
    out[order] = ~(first & last)
    return out


# --- contexts ------------------------------------------------------------------------------------


def contexts(texts: list[bytes], length: int):
    """Of the contexts of texts of at most 32 MB in all: number of the text, start of the first string, number of strings,
    hash of the minimizer, hash of the context, distance of the minimizer from the first start; and what cuts a context out."""
    k = length // SHARE
    span = length - k + 1
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    if len(buf) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z, lambda i: b""
    s = rolling(buf)
    own = len(buf) - k + 1
    h = mixed((s[k:] - s[:-k]) * powers(len(s))[1][:own])
    place = np.uint64((1 << 25) - 1)
    least = (h & ~place) | np.arange(own, dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor = (least & place).astype(np.int64)
    starts = np.arange(len(anchor))
    part = np.searchsorted(at, starts, "right") - 1
    inside = starts + length <= at[part + 1]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
    sums = np.concatenate([[0], np.cumsum(inside)])
    count = sums[np.concatenate([first[1:], [len(anchor)]])] - sums[first]
    first, count = first[count > 0], count[count > 0]
    ahead = anchor[first] - first
    context = mixed(span_hash(s, first, first + count + length - 1) + ahead.astype(np.uint64))
    data = buf.tobytes()
    cut = lambda i: data[first[i] : first[i] + count[i] + length - 1]
    return part[first], first - at[part[first]], count, h[anchor[first]], context, ahead, cut


def _chunks(batches: Iterator[pa.RecordBatch], length: int):
    """Rows, their texts, and what to add to places in them: a text beyond ``SEGMENT`` comes in parts that overlap by length - 1."""
    for batch in in_slices(batches, "bytes"):
        texts = batch.column("bytes").to_pylist()
        long = [i for i, t in enumerate(texts) if len(t) > SEGMENT]
        yield batch, [b"" if i in long else t for i, t in enumerate(texts)], 0
        for i in long:
            for at in range(0, len(texts[i]) - length + 1, SEGMENT):
                yield batch.slice(i, 1), [texts[i][at : at + SEGMENT + length - 1]], at


def _split_groups(rows: DataFrame, length: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(h, c, key, low, high): the keys under which at most ``limit`` contexts meet, and which strings, by distance ``l`` of the minimizer from their start, they meet for;
    and (h, c, from, run): at a single distance the contexts of a key share the whole string, so more of them repeat there and need not meet."""
    k = length // SHARE
    done = shared_starts = None
    rows = rows.withColumn("key", F.xxhash64("h")).withColumn("low", F.lit(0)).withColumn("high", F.lit(length - k))
    while True:
        sizes = staged(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limit), "sizes")
        if sizes.isEmpty():
            return (rows if done is None else done.unionByName(rows)), shared_starts
        rows = rows.join(sizes, "key", "left")
        small = rows.where(F.col("size").isNull()).drop("size")
        done = small if done is None else done.unionByName(small)
        # One string, by its own bytes' hash: the contexts of a key differ, so more than one text has it.
        large = rows.where("size > 1 and low = high").select("h", "c", (F.col("ahead") - F.col("low")).alias("from"), F.lit(1).alias("run"))
        shared_starts = large if shared_starts is None else shared_starts.unionByName(large)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))).alias("half")
        rows = rows.where("size is not null and low < high").drop("size")
        rows = rows.select("h", "c", "ahead", "count", "context", halves).select("h", "c", "ahead", "count", "context", "half.*")
        # Strings at distances low .. high share this much around the minimizer; a context may have none of them.
        rows = rows.where((F.col("ahead") >= F.col("low")) & (F.col("ahead") - F.col("count") + 1 <= F.col("high")))
        shared = F.substring("context", F.col("ahead") - F.col("low") + 1, F.col("low") + F.lit(length) - F.col("high"))
        rows = staged(rows.withColumn("key", F.xxhash64("h", "low", "high", shared)), "halves")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, starts, counts): of each text of ``docs`` (id, hash, bytes) the runs of starts of repeated strings."""

    def minimizers(batches):
        for _, texts, _ in _chunks(batches, length):
            _, _, _, h, c, _, _ = contexts(texts, length)
            order = np.argsort(h)
            h, c = h[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([first, [len(h)]]))
            low, high = (np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)) if len(h) else (c, c)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].astype(np.int64)), pa.array(n, pa.int64()), pa.array(low), pa.array(high)], names=["h", "n", "low", "high"])

    form = "h long, n long, low long, high long"
    again = docs.select("bytes").mapInArrow(minimizers, form).groupBy("h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    again = staged(again.where("n > 1").select("h", (F.col("low") < F.col("high")).alias("differ")), "again")
    bits, differ_bits = bit_filter(again.select("h")), bit_filter(again.where("differ").select("h"))
    sc = docs.sparkSession.sparkContext
    bits, differ_bits = sc.broadcast(bits), sc.broadcast(differ_bits)

    def occurrences(batches):
        for batch, texts, offset in _chunks(batches, length):
            text, start, count, h, c, ahead, cut = contexts(texts, length)
            rows = np.flatnonzero(has_bits(bits.value, h))
            sent: set[int] = set()
            data = []
            for i, x, d in zip(rows.tolist(), c[rows].tolist(), has_bits(differ_bits.value, h[rows]).tolist(), strict=True):
                data.append(cut(i) if d and x not in sent else None)  # one copy of a context from a chunk
                sent.add(x)
            take = pa.array(text[rows])
            columns = [batch.column("id").take(take), batch.column("hash").take(take), pa.array(start[rows] + offset, pa.int64()), pa.array(count[rows], pa.int32()), pa.array(ahead[rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(h[rows].astype(np.int64)), pa.array(c[rows].astype(np.int64)), pa.array(data, pa.binary())], names=["id", "hash", "start", "count", "ahead", "h", "c", "context"])

    form = "id long, hash long, start long, count int, ahead int, h long, c long, context binary"
    found = staged(docs.mapInArrow(occurrences, form).join(again, "h"), "occurrences")
    whole = found.where("not differ").select("id", "hash", "start", "count")
    distinct = found.where("differ").groupBy("h", "c").agg(F.count("*").alias("n"), F.first("context", ignorenulls=True).alias("context"), F.first("ahead").alias("ahead"), F.first("count").alias("count"))
    distinct = staged(distinct, "contexts")
    size = distinct.agg(F.sum(F.length("context"))).first()[0] or 0
    tasks = max(1, size // TASK_BYTES)
    met, shared = _split_groups(distinct.drop("n"), length, GROUP_CONTEXTS)
    met = met.withColumn("task", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(tasks)))

    def expand(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.groupby(["h", "c"], sort=False)  # a split group's context comes under several keys, and counts once
        which = own.ngroup().to_numpy()
        texts = frame.context.to_numpy()[np.unique(which, return_index=True)[1]]
        data = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8).astype(np.uint16) + 1
        n = np.array([len(x) for x in texts])
        at = np.cumsum(n + 1) - n - 1
        data[at + n] = 0
        again = repeated_starts(data, length)
        marks = np.concatenate([[0], np.cumsum(again)])
        at = at[which]
        rows = []
        for h, c, a, k, low, high, p in zip(frame.h, frame.c, frame.ahead, frame["count"], frame.low, frame.high, at, strict=True):
            first, last = max(0, a - high), min(k - 1, a - low)  # starts within the context
            if last < first or marks[p + last + 1] == marks[p + first]:
                continue
            flags = np.concatenate([[False], again[p + first : p + last + 1], [False]])
            edges = np.flatnonzero(flags[1:] != flags[:-1]) + first
            rows += [(h, c, x, y - x) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["h", "c", "from", "run"])

    parts = met.groupBy("task").applyInPandas(expand, "h long, c long, from int, run int")
    # A context that occurs twice repeats as a whole, whatever else it shares.
    twice = distinct.where("n > 1").select("h", "c", F.lit(0).alias("from"), F.col("count").alias("run"))
    parts = parts.unionByName(twice) if shared is None else parts.unionByName(twice).unionByName(shared)
    parts = staged(parts.groupBy("h", "c").agg(F.collect_set(F.struct("from", "run")).alias("runs")), "runs")
    some = found.where("differ").join(parts, ["h", "c"]).select("id", "hash", "start", F.explode("runs").alias("r"))
    some = some.select("id", "hash", (F.col("start") + F.col("r.from")).alias("start"), F.col("r.run").alias("count"))
    marks = whole.unionByName(some).groupBy("id", "hash").agg(F.collect_set(F.struct("start", "count")).alias("m"))
    return marks.select("id", "hash", F.col("m.start").alias("starts"), F.col("m.count").alias("counts"))


def _covered(starts, counts, length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, counts, strict=True)):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (array of from and to of the removed runs), kept_sha256, and ``kept``, the bytes that stay, if asked for.

    A null text is empty; a text shorter than ``length`` loses nothing. Every occurrence of a repeated
    string is removed, the first included. Null ids, repeated ids and repeated rows are rows like
    others. An empty table gives an empty one; other columns are left out.
    """
    bytes_ = text_of(text).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))).alias("id"), F.xxhash64(bytes_).alias("hash"), bytes_.alias("bytes"))
    marks = staged(find_repeats(rows.select("id", "hash", "bytes"), length), "marks")

    def cut(batches):
        for batch in in_slices(batches, "bytes", limit=4 << 20):
            spans, digests, kept = [], [], []
            for data, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("bytes", "starts", "counts")), strict=True):
                s = _covered(starts or (), counts or (), length)
                edges = [0, *(x for span in s for x in span), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                spans.append([{"from": a, "to": b} for a, b in s])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            n = pa.array([len(x) for x in batch.column("bytes").to_pylist()], pa.int64())
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            columns, names = [batch.column("doc_id"), n, pa.array(spans, kind), pa.array(digests)], ["doc_id", "n_bytes", "spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_bytes, names=names + ["kept"] * keep_bytes)

    form = "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept_sha256 string" + ", kept binary" * keep_bytes
    return rows.join(marks, ["id", "hash"], "left").select("doc_id", "bytes", "starts", "counts").mapInArrow(cut, form)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """The columns of query op1."""
    out = remove_repeats(docs, keep_bytes=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
