"""Packing by best-fit decreasing (operator 8).

A document is its token ids and one end id. Overlong documents are first cut into full windows; the
rests are packed, longest first, each into the tightest open window that holds it, which a segment
tree indexed by remaining capacity finds. Every scan task packs what it reads, some millions of
tokens at a time, so packing needs no shuffle and bounded memory. What a task leaves in half-empty
windows at the end is joined, cut into full windows and powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .textvec import in_slices, rolling, span_hash

WINDOW, END_ID = 4096, 2
#: Tokens that a task holds before it packs them; loosest windows are repacked above this padding.
HELD_TOKENS, LOOSE = 4 << 20, 256
CACHE = 1_000_000


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.at: dict[int, list[int]] = defaultdict(list)

    def add(self, capacity: int, which: int) -> None:
        self.at[capacity].append(which)
        i = self.leaves + capacity
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for ``need``, which is closed; or None."""
        tree, i = self.tree, self.leaves + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        which = self.at[capacity].pop()
        if not self.at[capacity]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return capacity, which


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices of ``lengths`` (each from 1 to ``window``) by window, best-fit decreasing."""
    tree, windows = OpenWindows(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = window, len(windows)
            windows.append([])
        capacity, which = found
        windows[which].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], which)
    return windows


def pack_pieces(pieces: list[tuple[int, int, int]], window: int = WINDOW, loose: int = LOOSE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); pieces of loosely filled windows may be cut further."""
    lengths = [p[2] for p in pieces]
    done, rest = [], []
    for group in best_fit(lengths, window):
        filled = sum(lengths[i] for i in group)
        (done.append if window - filled <= loose or filled & (filled - 1) == 0 else rest.extend)([pieces[i] for i in group])
    left = sum(p[2] for p in rest)
    sizes = [window] * (left // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if left % window >> b & 1]
    pending = rest[::-1]
    for size in sizes:
        group = []
        while size:
            doc, start, n = pending.pop()
            if n > size:
                pending.append((doc, start + size, n - size))
                n = size
            group.append((doc, start, n))
            size -= n
        done.append(group)
    return done


class WordIds:
    """Ids of texts by a vocabulary that lowers case, drops white space, and splits letters, digits and signs.

    Texts are cut in numpy into the units that the pre-tokenizer would make; each unit goes to the
    vocabulary's model once and is then looked up by its hash. A word with any character beyond ASCII
    and Latin-1 letters, or with an apostrophe or a special token's opening, is one unit that goes
    through the whole tokenizer.
    """

    LETTER, DIGIT, SIGN, OTHER = 1, 2, 3, 4

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        self.letters = str.maketrans({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)})
        kinds = np.full(256, self.OTHER, np.uint8)
        kinds[33:127] = self.SIGN
        kinds[48:58] = self.DIGIT
        kinds[65:91] = kinds[97:123] = self.LETTER
        kinds[39] = self.OTHER
        self.kinds = kinds
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, from and to of each unit, whether it is plain, and the number of each text's first unit."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        kind = self.kinds[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        lead = lead[(buf[lead + 1] & 0xDF) != 0x97]  # two signs among the letters
        lead = lead[buf[lead + 1] != 0xB7]
        kind[lead] = kind[lead + 1] = self.LETTER
        opening = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
        kind[opening] = self.OTHER
        kind[space] = 0
        inside = np.concatenate([[False], ~space, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        others = np.concatenate([[0], np.cumsum(kind == self.OTHER)])
        odd = others[end] > others[start]
        kind[np.flatnonzero(inside[1:-1])[np.repeat(odd, end - start)]] = self.OTHER
        cut = np.empty(len(buf), bool)
        cut[0] = kind[0] > 0
        cut[1:] = (kind[1:] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT))
        first = np.flatnonzero(cut)
        lower = (kind == self.LETTER) & (buf >= 65) & (buf <= 90)
        buf[lower] += 32
        accents = lead[(kind[lead] == self.LETTER) & (buf[lead + 1] <= 0x9E)] + 1
        buf[accents] += 32
        is_end = np.zeros(len(buf) + 1, bool)
        is_end[end] = is_end[first] = True
        stops = np.flatnonzero(is_end)
        last = stops[np.searchsorted(stops, first, "right")]
        return buf, first, last, kind[first] != self.OTHER, np.searchsorted(first, at)

    def encode(self, unit: bytes, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.model.tokenize(unit.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the place of each text's first one."""
        buf, start, end, plain, first = self.units(texts)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        keys, place, which = np.unique(span_hash(rolling(buf), start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        i = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(i, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data, k = buf.tobytes(), place[new]
            found = [self.encode(data[a:b], p) for a, b, p in zip(start[k].tolist(), end[k].tolist(), plain[k].tolist(), strict=True)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.at = np.insert(self.at, i[new], len(self.ids) + np.cumsum(n) - n)
            self.n, self.keys = np.insert(self.n, i[new], n), np.insert(self.keys, i[new], keys[new])
            self.ids = np.concatenate([self.ids, np.array([x for ids in found for x in ids], "<u4")])
            i = np.searchsorted(self.keys, keys)
        n = self.n[i][which]
        after = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[i][which] - (after - n), n) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[first]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ``ids`` (little-endian, four bytes each) if asked for.

    A null text counts as empty; an empty text is its end id alone. Null and repeated doc_ids, and
    repeated rows, are packed like others. An empty table gives no piece. ``tokenizer`` is a file of
    the tokenizers library whose pre-tokenizer drops white space.
    """
    end = END_ID.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer or default_tokenizer())
        base, n = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int | None, bytes, int]] = []
        pieces: list[tuple[int, int, int]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, pieces, tokens, n
            rows = []
            for group in pack_pieces(pieces, window):
                offset = 0
                for d, start, length in group:
                    doc, data, total = held[d]
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), total, base + n, offset, *([part] if ids else [])))
                    offset += length
                n += 1
            held, pieces, tokens = [], [], 0
            names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * ids
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in in_slices(batches, text):
            all_ids, first = encode([t.encode() for t in batch.column(text).to_pylist()])
            data, first = all_ids.tobytes(), first.tolist()
            for doc, i, j in zip(batch.column(doc_id).to_pylist(), first, first[1:], strict=False):
                total = j - i + 1
                pieces += [(len(held), s, min(window, total - s)) for s in range(0, total, window)]
                held.append((doc, data[4 * i : 4 * j] + end, total))
                tokens += total
            if tokens >= HELD_TOKENS:
                yield flush()
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text_of(text).alias(text))
    return rows.mapInArrow(pack, PIECE + ", ids binary" * ids)
