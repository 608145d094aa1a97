"""Quality rules (operator 10): text statistics, and a hashed n-gram logistic regression on labelled rows.

Features are the shares of hashed words, word pairs and byte trigrams in a text. The model is fitted on
a bounded sample of labelled rows (``SAMPLE``), calibrated on a part that it was not fitted on, and
applied in Arrow batches; fixed thresholds on the statistics and the probability decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_of
from .linear import calibrate, fit, labelled_sample, sigmoid
from .textvec import Words, in_slices, mixed, words

BITS, SAMPLE, SCALE = 16, 3000, 100.0
LEAST_WORDS, MOST_REPEATED, LEAST_SCORE = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"


def _features(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], Words]:
    """For words, pairs and trigrams: hashed index of each, and of each text the place of its first; and the words."""
    w = words(texts)
    shift = np.uint64(64 - BITS)
    one = (w.hash >> shift).astype(np.int64)
    pair = (mixed(w.hash[:-1] * np.uint64(3) + w.hash[1:]) >> shift).astype(np.int64) + (1 << BITS)
    b = w.buf.astype(np.uint64)
    three = ((b[:-2] | b[1:-1] << np.uint64(8) | b[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) + (2 << BITS)
    return [(one, w.first), (pair, w.first), (three, w.at)], w


def _ends(first: np.ndarray, lost: int) -> np.ndarray:
    """Where each text's n-grams end: the last ``lost`` of a text would reach into the next one."""
    return np.maximum(first[:-1], first[1:] - lost)


def _scores(features, weights: np.ndarray) -> np.ndarray:
    z = 0.0
    for (index, first), lost in zip(features, (0, 1, 2), strict=True):
        sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
        start = np.minimum(first[:-1], len(index))
        end = np.maximum(start, np.minimum(_ends(first, lost), len(index)))
        z = z + SCALE * (sums[end] - sums[start]) / np.maximum(1, end - start)
    return z


def _statistics(texts: list[bytes], w) -> dict[str, np.ndarray]:
    per_text = lambda flags, cuts: np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    table = np.zeros(256, bool)
    table[np.frombuffer(SYMBOLS, np.uint8)] = True
    h, count = w.hash, np.diff(w.first)
    text = np.repeat(np.arange(len(texts)), count)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        own = np.flatnonzero(text[:-2] == text[2:])
        q = np.uint64(0x9E3779B97F4A7C15)
        key = mixed((h[own] * q + h[own + 1]) * q + h[own + 2] + mixed(text[own].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = own[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        for k in range(3):
            covered[again + k] = True
    repeated_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        repeated_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": count,
        "word_chars": per_text(inside & ((w.buf & 0xC0) != 0x80), w.at),
        "n_symbols": per_text(table[w.buf], w.at),
        "n_dup_lines": np.array(repeated_lines, np.int64),
        "n_repeat_words": per_text(covered, w.first),
    }


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    """The model; without labelled rows of both classes it finds every text good."""

    def rows(batches):
        for batch in in_slices(batches, "text"):
            features, _ = _features([t.encode() for t in batch.column("text").to_pylist()])
            index, value = [], []
            for d in range(batch.num_rows):
                i, v = [], []
                for (f, first), lost in zip(features, (0, 1, 2), strict=True):
                    own = f[first[d] : max(first[d], first[d + 1] - lost)]
                    if len(own):
                        k, n = np.unique(own, return_counts=True)
                        i.append(k.astype(np.int32))
                        v.append((SCALE * n / len(own)).astype(np.float32))
                index.append(np.concatenate(i) if i else np.zeros(0, np.int32))
                value.append(np.concatenate(v) if v else np.zeros(0, np.float32))
            lists = [pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "index", "value"])

    sample = labelled_sample(docs, labels, label, bound).withColumn("text", text_of("text"))
    found = sample.mapInArrow(rows, "doc_id long, label int, index array<int>, value array<float>").dropDuplicates(["doc_id"]).toArrow()
    found = found.sort_by("doc_id")
    y = np.asarray(found.column("label").to_numpy(), float)
    size = 3 << BITS
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return Model(np.zeros(size, np.float32), 40.0, 1.0, 0.0)
    lists = found.column("index").combine_chunks()
    index, value = lists.flatten().to_numpy(), found.column("value").combine_chunks().flatten().to_numpy()
    n = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(y), dtype=np.int32), n)
    aside = np.arange(len(y)) % 4 == 3
    place = np.cumsum(~aside) - 1
    own = ~aside[row]
    w, b = fit(index[own], value[own], place[row[own]], y[~aside], size)
    z = np.bincount(row, w[index] * value, len(y)) + b
    held = aside if len(set(y[aside])) == 2 else ~aside
    a, c = calibrate(z[held], y[held])
    return Model(w.astype(np.float32), b, a, c)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, model: Model, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the text, with the statistics, base_failed, score (probability of good) and kept.

    A null text has no words and fails. Repeated rows are each judged; columns that clash with an
    added one are replaced; an empty table gives an empty one.
    """
    added = (*STATISTICS, "base_failed", "score", "kept")
    keep = [c for c in docs.columns if c not in (text, *added)]
    schema = docs.select(*keep).schema
    for c in STATISTICS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text):
            texts = [t.encode() for t in batch.column(text).to_pylist()]
            features, w = _features(texts)
            s = _statistics(texts, w)
            failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
            score = sigmoid(model.slope * (_scores(features, model.weights) + model.intercept) + model.offset)
            columns = [batch.column(c) for c in keep] + [pa.array(s[c], pa.int64()) for c in STATISTICS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= least_score))], names=[*keep, *added])

    small_batches(docs.sparkSession)
    return docs.select(*keep, text_of(text).alias(text)).mapInArrow(judge, schema)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op10."""
    return quality_rules(docs.select("doc_id", "text"), fit_quality(docs, labels))
