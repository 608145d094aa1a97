"""Toxicity by a learned lexicon, Levenshtein automata and context windows (operator 5).

The lexicon is learned from labelled rows: words, and beginnings of words, that toxic documents have
and others lack by more evidence (the log-likelihood ratio of the document counts) than the best of as
many terms would show by chance. Its terms form a trie, which most words leave within three letters. A word that is not in
it is tried by the Levenshtein automata of those terms that it equals after letters of both are left
out, as many as the term has edits; no other term can be that near. A hit is weighed by its context
window: quotation marks around it and words of reporting lower it. A logistic regression on a document's
weighed hits, fitted on the same rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, text_of
from .linear import class_sizes, fit, known_labels, labelled_sample, sigmoid
from .textvec import in_slices, mixed, powers, shingles
from .textvec import words as words_of

SAMPLE, LEAST_SCORE = 20_000, 0.7
LEAST_RATIO = 3  # times as frequent in toxic documents as in others
LEAST_DOCUMENTS = 2  # toxic ones that have a term
WORD = re.compile(r"[^\W_]+")
FIRST, LONGEST = 4, 24  # shortest and longest beginning that can be a term; whole words may be longer
WINDOW = 5
KNOWN = 150_000  # words, before a task forgets them
FILTER_BITS, FILTER_CELLS = 1 << 27, 1 << 20  # a filter spares words a search that would fail; places looked up at once
QUOTES = frozenset("\"“”„«»`")
#: Apostrophes are quotation marks only at the edge of a word: not in "don't" or "l'homme".
OPENS, CLOSES = re.compile(r"(?<!\w)['‘’](?=\w)"), re.compile(r"(?<=[\w.,!?])['’](?!\w)")
#: Words that report what others said.
REPORTS = frozenset("said says wrote called quote quoted quotes reported alleged dit écrit cité sagte schrieb zitiert dijo escribió citado".split())
END = "$"


class Term(NamedTuple):
    text: str
    whole: bool
    weight: float


def _edits(term: str, whole: bool) -> int:
    return 0 if not whole or len(term) < 5 else 1 if len(term) < 8 else 2


def _left_out(word: str, most: int) -> list[str]:
    """The word with up to ``most`` (2 at most) letters left out, and other equal strings."""
    out = [word]
    if most:
        out += [word[:i] + word[i + 1 :] for i in range(len(word))]
    if most > 1:
        out += [x[:i] + x[i + 1 :] for j in range(1, len(word)) for x in [word[:j] + word[j + 1 :]] for i in range(j)]
    return out


def _left_out_bits(words: list[str], most: int) -> np.ndarray:
    """The same of words of one length, in a row each, as places in a filter of ``FILTER_BITS`` bits."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)
    up, down = (p[: n + 1] for p in powers(n))
    before = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(codes * up[:n], axis=1, out=before[:, 1:])
    every = before[:, -1:]
    out = [every, before[:, :-1] + (every - before[:, 1:]) * down[1]]
    if most > 1:
        i, j = np.triu_indices(n, 1)
        out.append(before[:, i] + (before[:, j] - before[:, i + 1]) * down[1] + (every - before[:, j + 1]) * down[2])
    return (np.concatenate(out, axis=1) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


class Automaton:
    """The Levenshtein automaton of a term: a bit for each place in the term, a number for each count of edits."""

    def __init__(self, term: str, most: int):
        self.most, self.last = most, 1 << len(term)
        self.letters: dict[str, int] = defaultdict(int)
        for i, c in enumerate(term):
            self.letters[c] |= 2 << i

    def edits(self, word: str) -> int | None:
        """The fewest edits that lead to the word, or None."""
        now = [(2 << e) - 1 for e in range(self.most + 1)]
        for c in word:
            at, before, after = self.letters.get(c, 0), 0, 0
            for e, x in enumerate(now):
                # The next letter; a letter too many, another letter, or a letter left out for one edit more.
                after = x << 1 & at | before | before << 1 | after << 1
                before, now[e] = x, after
        return next((e for e, x in enumerate(now) if x & self.last), None)


class Lexicon:
    """The trie of the terms and their automata. ``match`` gives (term number, edits) of a lower-case word, or None.

    Only automata of terms that are equal to the word after letters of both are left out can accept it.
    ``matches`` gives the matches of many words, the searches for such terms led by a filter.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        self.start: list[int] = [-1]
        self.automata: dict[int, Automaton] = {}
        self.near: tuple[dict[str, list[int]], ...] = ({}, {}, {})  # by edits, then by what is left of a term
        for k, t in enumerate(terms):
            node = 0
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.start.append(-1)
                node = self.children[node][c]
            (self.whole if t.whole else self.start)[node] = k
            room = _edits(t.text, t.whole)
            if room:
                self.automata[k] = Automaton(t.text, room)
                for x in set(_left_out(t.text, room)):
                    self.near[room].setdefault(x, []).append(k)
        self.filters = {room: self._filter([terms[k].text for k, a in self.automata.items() if a.most == room], room) for room in (1, 2)}
        lengths = [[len(terms[k].text) for k, a in self.automata.items() if a.most == room] or [1 << 30] for room in (1, 2)]
        self.reach = [(min(n) - room, max(n) + room) for room, n in enumerate(lengths, 1)]

    def _misspelled(self, word: str) -> tuple[int, int] | None:
        """Of the terms that edits lead from to the word, the one with the fewest edits, then the largest weight."""
        best = None
        for room, (least, most) in enumerate(self.reach, 1):
            if not least <= len(word) <= most:
                continue
            near, seen = self.near[room], set()
            for x in filter(near.__contains__, _left_out(word, room)):
                seen.update(near[x])
            for k in seen:
                e = self.automata[k].edits(word)
                if e is not None and (best is None or (e, -self.terms[k].weight, k) < best):
                    best = (e, -self.terms[k].weight, k)
        return best and (best[2], best[0])

    def _filter(self, words: list[str], room: int) -> np.ndarray:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for w in words:
            at = _left_out_bits([w], room)[0]
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return bits

    def _near(self, words: list[str]) -> set[str]:
        """All words that some term may lead to by edits, and few others."""
        by_length = defaultdict(list)
        for w in words:
            by_length[len(w)].append(w)
        found = set()
        for n, same in by_length.items():
            for room, (least, most) in enumerate(self.reach, 1):
                step = max(1, FILTER_CELLS // (n * n))
                for i in range(0, len(same) if least <= n <= most else 0, step):
                    at = _left_out_bits(same[i : i + step], room)
                    hit = (self.filters[room][at >> 3] >> (at & 7) & 1).any(axis=1)
                    found.update(same[i + k] for k in np.flatnonzero(hit).tolist())
        return found

    def _spelled(self, word: str) -> tuple[int, int] | None:
        """The term that the word is or begins with, by the largest weight."""
        node, best = 0, None
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                return best
            if (k := self.start[node]) >= 0 and (best is None or self.terms[k].weight > self.terms[best[0]].weight):
                best = (k, 0)
        if (k := self.whole[node]) >= 0 and (best is None or self.terms[best[0]].weight < self.terms[k].weight):
            return k, 0
        return best

    def match(self, word: str) -> tuple[int, int] | None:
        return self._spelled(word) or self._misspelled(word)

    def matches(self, words: list[str]) -> dict[str, tuple[int, int]]:
        found = {w: m for w in words if (m := self._spelled(w))}
        found |= {w: m for w in self._near([w for w in words if w not in found]) if (m := self._misspelled(w))}
        return found


class Scorer:
    """Counts a document's hits; clean words are remembered."""

    def __init__(self, lexicon: Lexicon, innocent: frozenset[str]):
        self.lexicon, self.innocent = lexicon, innocent
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def features(self, texts: list[str]) -> list[tuple[list[float], int]]:
        """Of each text (hit strength, strength per word, strongest hit, terms), and the number of hits."""
        low = [t.lower() for t in texts]
        words = [WORD.findall(t) for t in low]
        if len(self.clean) + len(self.hits) > KNOWN:
            self.clean.clear()
            self.hits.clear()
        new = set().union(*words) - self.clean - self.hits.keys()
        found = self.lexicon.matches(list(new))
        self.hits.update((w, m) for w, m in found.items() if not (m[1] and w in self.innocent))
        self.clean.update(new - self.hits.keys())
        return [self._of(t, w) for t, w in zip(low, words, strict=True)]

    def _of(self, low: str, words: list[str]) -> tuple[list[float], int]:
        own = self.hits.keys() & words
        if not own:
            return [0.0, 0.0, 0.0, 0.0], 0
        strength, most, terms, n = 0.0, 0.0, set(), 0
        for i, m in enumerate(WORD.finditer(low)):
            w = words[i]
            if w not in own:
                continue
            k, e = self.hits[w]
            weight = self.lexicon.terms[k].weight * 0.7**e * self.context(low, m.start(), m.end(), words, i)
            strength, most, n = strength + weight, max(most, weight), n + 1
            terms.add(k)
        return [math.log1p(strength), math.log1p(100 * strength / len(words)), most, math.log1p(len(terms))], n

    @staticmethod
    def context(text: str, a: int, b: int, words: list[str], i: int) -> float:
        """1 for open use, less within quotation marks or beside words of reporting."""
        low, high = max(0, a - 40, text.rfind("\n", 0, a) + 1), min(len(text), b + 40)
        if (end := text.find("\n", b, high)) >= 0:
            high = end
        quoted = not QUOTES.isdisjoint(text[low:a]) and not QUOTES.isdisjoint(text[b:high])
        if not quoted and ("'" in text[low:a] or "‘" in text[low:a] or "’" in text[low:a]):
            quoted = _pattern_in(OPENS, text, low, a) and _pattern_in(CLOSES, text, b, high)
        reported = not REPORTS.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
        return (0.4 if quoted else 1.0) * (0.6 if reported else 1.0)


def _pattern_in(pattern: re.Pattern, text: str, low: int, high: int) -> bool:
    """Whether it is found between the places, seen with what stands around them."""
    found = pattern.search(text, low)
    return found is not None and found.start() < high


class Model(NamedTuple):
    terms: list[Term]
    innocent: frozenset[str]
    weights: list[float]
    intercept: float


def _candidates(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        if len(w) >= FIRST:
            out.add(w + END)
            out.update(w[:k] for k in range(FIRST, min(len(w), LONGEST) + 1))
    return out


def _evidence(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """The log-likelihood ratio of a term in a of the toxic and b of the clean documents."""
    x = lambda c: F.when(c > 0, c * F.log(c.cast("double"))).otherwise(F.lit(0.0))
    fixed = sum(n * math.log(n) for n in (toxic + clean,)) - sum(n * math.log(n) for n in (toxic, clean))
    return 2 * (x(a) + x(b) + x(toxic - a) + x(clean - b) - x(a + b) - x(toxic + clean - a - b) + fixed)


def _independent(sample: DataFrame) -> DataFrame:
    """Without rows that share one of three minimal hashes of five-word runs with a row of smaller id."""

    def sign(batches):
        for batch in in_slices(batches, "text"):
            text, h = shingles(words_of([t.lower().encode() for t in batch.column("text").to_pylist()]), 5)
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
            least = np.zeros((3, batch.num_rows), np.int64)
            for k in range(3 if len(text) else 0):
                least[k, text[first]] = np.minimum.reduceat(mixed(h * np.uint64(2 * k + 1)), first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, least)], names=["doc_id", "f0", "f1", "f2"])

    light = staged(sample.mapInArrow(sign, "doc_id long, f0 long, f1 long, f2 long"), "families")
    for k in range(3):
        rest = [f"f{j}" for j in range(k + 1, 3)]
        light = light.groupBy(f"f{k}").agg(F.min(F.struct("doc_id", *rest)).alias("x")).select("x.*")
    return sample.join(light.select("doc_id"), "doc_id", "left_semi")


def learn_terms(sample: DataFrame) -> list[Term]:
    """All words and beginnings that toxic documents prefer beyond chance, the surest first, from document counts over the sample.

    Of M terms that chance alone deals out, the best is expected to show evidence of about 2 ln M: a term
    must have more. Where so few rows are labelled that no term can, the best ones of those that no clean
    document has are taken. Of near copies one document counts, as the others are no evidence of their own.
    Only the chosen terms come to the driver; the size of the sample bounds how many there are.
    """

    def count(batches):
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in in_slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for t in _candidates(text):
                    counts[t][label] += 1
            if len(counts) > KNOWN:
                yield table(counts)
                counts.clear()
        yield table(counts)

    def table(counts):
        rows = counts.values()
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in rows], pa.int64()), pa.array([c[1] for c in rows], pa.int64())], names=["term", "clean", "toxic"])

    sample = _independent(sample)
    sums = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return []
    odd = F.col("toxic") * (n - toxic) > LEAST_RATIO * toxic * F.col("clean")
    seen = staged(sums.where((F.col("toxic") + F.col("clean") > LEAST_DOCUMENTS) | (odd & (F.col("toxic") >= LEAST_DOCUMENTS))), "terms")
    chance = 2 * math.log(max(2, seen.count()))
    sure = seen.where(odd & (F.col("toxic") >= LEAST_DOCUMENTS)).withColumn("evidence", _evidence(F.col("toxic"), F.col("clean"), toxic, n - toxic))
    sure = staged(sure, "evidence")
    best = sure.where((F.col("clean") == 0) & (F.col("toxic") > LEAST_DOCUMENTS)).agg(F.max("evidence")).first()[0]
    sure = sure.where(F.col("evidence") >= min(chance, best or chance))
    # Without terms of which a longer one says the same.
    longer = sure.select(F.expr("left(term, length(term) - 1)").alias("term"), "clean", "toxic").distinct()
    rows = sure.join(longer, ["term", "clean", "toxic"], "left_anti").collect()
    weight = {r["term"]: math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (n - toxic + 1)) for r in rows}
    # Nor do words need a term of their own that a beginning of theirs catches with about that weight.
    rows = [r for r in rows if not any(weight.get(r["term"][:k], -math.inf) > weight[r["term"]] - math.log(2) for k in range(FIRST, len(r["term"].rstrip(END)) - 1))]
    rows.sort(key=lambda r: (-r["evidence"], r["term"]))
    return [Term(r["term"].rstrip(END), r["term"][-1] == END, weight[r["term"]]) for r in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, allowed=None) -> Model:
    """Lexicon and weights; without labelled rows of both classes every score is the intercept's."""
    sample = labelled_sample(docs, labels, label, bound, allowed).withColumn("text", text_of("text"))
    sample = staged(sample, "toxicity")
    terms = learn_terms(sample)
    lexicon_terms = list(terms)

    def rows(batches):
        scorer = Scorer(Lexicon(lexicon_terms), frozenset())
        for batch in in_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            x = [x for x, _ in scorer.features(texts)]
            near = [[w for w in set(WORD.findall(t.lower())) if w in scorer.hits and scorer.hits[w][1]] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.string()))], names=["doc_id", "label", "x", "near"])

    found = sample.mapInArrow(rows, "doc_id long, label int, x array<double>, near array<string>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    y = np.asarray(found.column("label").to_numpy(), float)
    clean, toxic = Counter(), Counter()
    for words, t in zip(found.column("near").to_pylist(), y, strict=True):
        (toxic if t else clean).update(words)
    innocent = frozenset(w for w, n in clean.items() if n > toxic[w])
    if not len(y) or y.min() == y.max():
        return Model(terms, innocent, [0.0] * 4, -3.0)
    # Scored as later: innocent misspellings count for nothing.
    pairs = sample.mapInArrow(lambda b: _score_rows(b, lexicon_terms, innocent), "doc_id long, label int, x array<double>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    x = np.array(pairs.column("x").to_pylist())
    y = np.asarray(pairs.column("label").to_numpy(), float)
    scale = np.maximum(x.std(0), 1e-6)
    n, k = x.shape
    w, b = fit(np.tile(np.arange(k), n), (x / scale).ravel(), np.repeat(np.arange(n), k), y, k, steps=600, ridge=1e-3)
    # Classes weighed alike while fitting; the true rate shifts the intercept half way back.
    sizes = class_sizes(known_labels(labels, label, allowed))
    prior = sizes[1] / (sizes[0] + sizes[1])
    return Model(terms, innocent, (w / scale).tolist(), float(b + 0.5 * math.log(prior / (1 - prior))))


def _score_rows(batches, terms, innocent):
    scorer = Scorer(Lexicon(terms), innocent)
    for batch in in_slices(batches, "text"):
        x = [x for x, _ in scorer.features(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text unless asked for), with n_hits, score and predicted.

    Only the text decides. A null or empty text has no hits and still has a score. Repeated rows are
    each scored; columns that clash with an added one are replaced; an empty table gives an empty one.
    """
    added = ("n_hits", "score", "predicted")
    keep = [c for c in docs.columns if c not in added and c not in ("t_", text)]
    schema = docs.select(*keep).schema
    if keep_text:
        schema = docs.select(*[c for c in docs.columns if c not in (*added, "t_")]).schema
    names = list(schema.names)
    schema = schema.add("n_hits", "long").add("score", "double").add("predicted", "integer")
    terms, innocent, weights, intercept = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(Lexicon(terms), innocent), np.array(weights)
        for batch in in_slices(batches, "t_"):
            found = scorer.features(batch.column("t_").to_pylist())
            p = sigmoid(np.array([x for x, _ in found]).reshape(-1, 4) @ w + intercept)
            columns = [batch.column(c) for c in names] + [pa.array([n for _, n in found], pa.int64()), pa.array(p), pa.array((p >= LEAST_SCORE).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    small_batches(docs.sparkSession)
    return docs.select(*names, text_of(text).alias("t_")).mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op5."""
    model = fit_toxicity(docs, labels, allowed=~held_out())
    return score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
