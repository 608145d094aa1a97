"""Words and rolling sums of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19

_Q = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_QI = pow(_Q, -1, 1 << 64)


class _Kept(dict):
    """Kept in a process; empty where it is sent."""

    def __reduce__(self):
        return _Kept, ()


_kept = _Kept()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the multiplier and of its inverse."""
    bits = max(20, (n + 1).bit_length())
    if bits not in _kept:
        out = []
        for q in (_Q, _QI):
            p = np.ones(1, np.uint64)
            for b in range(bits):
                p = np.concatenate([p, p * np.uint64(pow(q, 1 << b, 1 << 64))])
            out.append(p)
        _kept.clear()
        _kept[bits] = tuple(out)
    return _kept[bits]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums S of byte times power: the hash of buf[i:j] is (S[j] - S[i]) / Q**i."""
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[0][: len(buf)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((s[end] - s[start]) * powers(len(s))[1][start])


class Words(NamedTuple):
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text the number of its first word, and the number of words
    at: np.ndarray  # of each text its first byte, and the end


def words(texts: list[bytes]) -> Words:
    """The words (runs without space, \\t, \\n, \\v, \\f, \\r) of the texts, with their hashes."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not((buf == 32) | ((buf >= 9) & (buf <= 13)), out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    s = rolling(buf)
    return Words(buf, start, end, span_hash(s, start, end), np.searchsorted(start, at), at)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all runs of n words; a text of fewer words, but some, has one run of all of them."""
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    h = w.hash
    total = max(0, len(h) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * np.uint64(_Q) + h[k : k + total]
    full = text[:total] == text[n - 1 :] if total else np.zeros(0, bool)
    texts, hashes = text[:total][full], mixed(out[full])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([int(np.bitwise_xor.reduce(mixed(h[w.first[d] : w.first[d + 1]] + np.arange(count[d], dtype=np.uint64) * np.uint64(_QI)))) for d in short], np.uint64)
        texts, hashes = np.concatenate([texts, short]), np.concatenate([hashes, extra])
        order = np.argsort(texts, kind="stable")
        texts, hashes = texts[order], hashes[order]
    return texts, hashes


def in_slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``limit`` bytes, so that few are Python objects at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False), np.int64) for c in columns)
        after, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = int(np.searchsorted(after, (after[a - 1] if a else 0) + limit)) + 1
            yield batch.slice(a, b - a)
            a = b
