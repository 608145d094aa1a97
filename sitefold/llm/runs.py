"""Periodic run detection in texts (operator 12).

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES``
periods long, that no neighbouring word extends. Words at ``i`` and ``i + q`` agree throughout a stretch
of ``max(LEAST, TIMES * q) - q`` places of such a run, so a grid with that step meets every run of period
q: over all periods the grids are harmonic, n log n places in all. Where a grid's place and its
neighbours agree, two longest common extensions, forwards and backwards, give the whole run.

Extensions come from a difference cover: only suffixes that begin at covered places are sorted, by their
first words and then by doubling. For any two places few words lead to a pair of covered ones; the
remaining extension is a range minimum over the sorted suffixes' common beginnings in a sparse table.

The texts of a batch are worked on together, as one array of word numbers with a separator of its own
after each text; extensions are built for those texts alone in which a grid's place agrees.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import small_batches

LEAST, TIMES = 6, 4
#: A perfect difference set; every difference modulo 31 is one of two of its members.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
#: Words worked on at once (a longer text is worked on by itself), and grid places at once.
WORDS, PLACES = 1 << 18, 1 << 20
RUN = "array<struct<start: long, length: long, period: long>>"


def _shifts() -> np.ndarray:
    """For residues a and d: the least s with a + s and a + d + s both covered."""
    out = np.full((MODULUS, MODULUS), MODULUS, np.int64)
    member = np.isin(np.arange(MODULUS), COVER)
    a, d = np.meshgrid(np.arange(MODULUS), np.arange(MODULUS), indexing="ij")
    for s in range(MODULUS - 1, -1, -1):
        out[member[(a + s) % MODULUS] & member[(a + d + s) % MODULUS]] = s
    return out


SHIFT = _shifts()


class Extensions:
    """Longest common extensions of two places of a sequence of non-negative numbers."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        end = (n // MODULUS + 2) * MODULUS
        top = int(x.max(initial=0)) + 1
        self.x = np.concatenate([x, top + np.arange(end - n)])  # an end that equals nothing
        self.slot = np.full(MODULUS, -1)
        self.slot[list(COVER)] = np.arange(len(COVER))
        at = (np.arange(end // MODULUS)[:, None] * MODULUS + np.array(COVER)).ravel()
        self._sort(at)
        self.table = self._minima(self.common)

    def _sort(self, at: np.ndarray) -> None:
        m = len(at)
        self.rank, order = np.zeros(m, np.int64), np.arange(m)
        self.common = np.full(m, np.iinfo(np.int64).max)
        live, depth = np.arange(m), 0
        while len(live):
            items = order[live]
            deep = depth >= MODULUS  # then further ranks of covered places stand for words
            key = self.rank[items + depth // MODULUS * len(COVER)] if deep else self.x[at[items] + depth]
            group = self.rank[items]
            by = np.argsort(group * (int(key.max()) + 1) + key, kind="stable")
            items, key, group = items[by], key[by], group[by]
            order[live] = items
            first = np.ones(len(live), bool)
            first[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            split = np.flatnonzero(first[1:] & (group[1:] == group[:-1])) + 1
            more = self._minimum(self._minima(self.common), key[split - 1], key[split]) if deep and len(split) else 0
            self.common[live[split]] = depth + more
            self.rank[items] = live[np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))]
            alone = first & np.append(first[1:], True)
            live = live[~alone]
            depth = depth * 2 if deep else depth + 1

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    @staticmethod
    def _minimum(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over the places after low, up to high."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(table[k][low[own] + 1], table[k][high[own] - (1 << k) + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from places i and j (i < j or i > j) on are equal."""
        shift = SHIFT[i % MODULUS, (j - i) % MODULUS]
        out = np.zeros(len(i), np.int64)
        same = np.arange(len(i))
        reached = []
        for k in range(MODULUS):
            there = shift[same] == k
            reached.append(same[there])
            same = same[~there]
            same = same[self.x[i[same] + k] == self.x[j[same] + k]]
            out[same] = k + 1
            if not len(same):
                break
        on = np.concatenate(reached)
        a, b = (self.rank[(p // MODULUS) * len(COVER) + self.slot[p % MODULUS]] for p in (i[on] + shift[on], j[on] + shift[on]))
        out[on] = shift[on] + self._minimum(self.table, np.minimum(a, b), np.maximum(a, b))
        return out


def _grid_places(x: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of all grids where the place and enough neighbours agree with those a period on."""
    near = LEAST - 2  # a run's agreeing stretch has LEAST - 1 places at least, for every period
    found = []
    periods = np.arange(1, longest // TIMES + 1)
    steps = np.maximum(LEAST, TIMES * periods) - periods
    counts = np.maximum(0, -(-(len(x) - 2 * near - periods) // steps))
    periods, steps, counts = periods[counts > 0], steps[counts > 0], counts[counts > 0]
    ends = np.cumsum(counts)
    low = 0
    while low < len(periods):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACES)))
        if high == low + 1:  # one period
            i = near + steps[low] * np.arange(counts[low])
            q = np.broadcast_to(periods[low], len(i))
        else:
            own = counts[low:high]
            q = np.repeat(periods[low:high], own)
            i = near + np.repeat(steps[low:high], own) * (np.arange(len(q)) - np.repeat(np.cumsum(own) - own, own))
        hit = x[i] == x[i + q]
        i, q = i[hit], q[hit]
        ahead, behind = (np.zeros(len(i), np.int64) for _ in range(2))
        for total, sign in ((ahead, 1), (behind, -1)):
            going = np.ones(len(i), bool)
            for k in range(1, near + 1):
                going[going] = x[i[going] + sign * k] == x[np.minimum(i[going] + q[going] + sign * k, len(x) - 1)]
                total += going
        good = ahead + behind >= near
        found.append((i[good], q[good]))
        low = high
    return tuple(np.concatenate(parts) if found else np.zeros(0, np.int64) for parts in (zip(*found) if found else ((), ())))


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of sequences of non-negative numbers: sequence, start, length, period; by sequence, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes) or sizes.max() < LEAST:
        return none
    pad = LEAST
    top = 1 + max(int(t.max(initial=0)) for t in texts)

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pad + np.concatenate([[0], np.cumsum(sizes[which] + 1)])
        x = top + np.arange(starts[-1] + pad)  # each place not taken by a word equals nothing
        for at, w in zip(starts.tolist(), which.tolist()):
            x[at : at + sizes[w]] = texts[w]
        return x, starts

    every = np.flatnonzero(sizes >= LEAST)
    x, starts = joined(every)
    i, q = _grid_places(x, int(sizes.max()))
    own = np.searchsorted(starts, i, "right") - 1
    inside = i + q < starts[own] + sizes[every[own]]  # else two texts hold the same words
    i, q, own = i[inside], q[inside], own[inside]
    if not len(i):
        return none
    some = np.unique(own)
    offset = i - starts[own]
    x, starts = joined(every[some])
    own = np.searchsorted(some, own)
    i = starts[own] + offset
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    ahead = Extensions(x)(i, i + q)
    behind = Extensions(x[::-1].copy())(len(x) - i, len(x) - i - q)
    start, length = i - behind, behind + ahead + q
    long = length >= np.maximum(LEAST, TIMES * q)
    rows = np.unique(np.stack([own[long], start[long], length[long], q[long]], 1), axis=0)
    # A multiple of a run's period has the same stretch: its smallest period comes first.
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    own, start, length, q = rows[fresh].T
    by = np.lexsort((q, start, own))
    own, start, length, q = own[by], start[by], length[by], q[by]
    return every[some][own], start - starts[own], length, q


def _numbered(documents: Iterator[list[bytes]]) -> Iterator[tuple[list[list[bytes]], tuple]]:
    """Some texts at a time, as words, with their runs."""

    def worked(texts: list[list[bytes]]):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]
        return texts, find_runs(coded)

    texts, size = [], 0
    for words in documents:
        if texts and size + len(words) > WORDS:
            yield worked(texts)
            texts, size = [], 0
        texts.append(words)
        size += len(words)
    if texts:
        yield worked(texts)


def _kept(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> list[bytes]:
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in zip(start, length, period, strict=True):
        drop[s + q] += 1
        drop[s + n] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def _over_texts(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None, row: Callable[[list[bytes], list[int], list[int], list[int]], tuple], schema: str) -> DataFrame:
    """``row`` of each text's words and runs, beside its doc_id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    form = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)

            def words(ids=ids, texts=texts):
                for doc, text in zip(ids, texts, strict=True):
                    found = (text.as_py() or "").encode().split()  # at ASCII white space alone
                    yield rewrite(doc, found) if rewrite else found

            out, done = [], 0
            for some, (own, start, length, period) in _numbered(words()):
                ends = np.searchsorted(own, np.arange(len(some) + 1))
                parts = start.tolist(), length.tolist(), period.tolist()
                for k, text in enumerate(some):
                    a, b = ends[k], ends[k + 1]
                    out.append((ids[done + k], *row(text, *(p[a:b] for p in parts))))
                done += len(some)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), form, strict=True)], schema=form)

    return rows.mapInArrow(work, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text, and the text without their repeats: doc_id, n_words, runs, collapsed.

    ``runs`` has start (word number), length and period, by start and period; ``collapsed`` joins by one
    space the words that no run holds beyond its first period. Words are separated by ASCII white space
    alone. A null or empty text has no words and no runs and collapses to the empty string; long texts
    are worked on whole; repeated rows and null ids come out as they came in; an empty table gives an
    empty one; other columns are left out.
    """

    def row(words, start, length, period):
        runs = [{"start": s, "length": n, "period": q} for s, n, q in zip(start, length, period, strict=True)]
        return len(words), runs, b" ".join(_kept(words, start, length, period) if runs else words).decode()

    return _over_texts(docs, None, row, f"doc_id long,n_words long,runs {RUN},collapsed string")


def plant(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a tail made periodic in about a tenth of all documents, by their id; null ids are left alone."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document whose words are first planted with repeats: runs and collapsed text as digests.

    Odd rows: as in ``periodic_runs``. Without a run, start to exponent_milli are null.
    """

    def row(words, start, length, period):
        best = min(((-n, s, q) for s, n, q in zip(start, length, period, strict=True)), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start, length, period, strict=True))
        kept = _kept(words, start, length, period) if best else words
        return len(start), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _over_texts(docs, plant, row, "doc_id long,n_runs long,start long,length long,period long,exponent_milli long,runs_sha256 string,collapsed_sha256 string")
