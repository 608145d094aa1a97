"""Toxicity scores against brute force, for a given model."""

import math
import random
import re

import pytest

from sitefold.llm import toxicity


def test_toxicity_scores_equal_brute_force(spark):
    """Every word against every term by edit distance, every hit's context, the features and the logistic function, all in plain Python."""
    terms = [toxicity.Term(*t) for t in (("idiot", True, 2.0), ("worthless", True, 1.5), ("scum", True, 1.1), ("patheti", False, 1.3), ("scu", True, 0.2), ("path", False, 0.7))]
    innocent = frozenset({"idiom", "worthies"})
    model = toxicity.Model(terms, innocent, [1.1, 0.3, 0.9, 0.4], -2.5)
    rng = random.Random(3)
    bits = ["idiot", "1diot", "idiom", "Idiots", "idi0t", "worthless", "worthles", "wrthlss", "worthies", "scum", "scam", "pathetic", "Pathway", "path", "don't", "said", "écrit", "the", "river", "a", '"', "'", "«", "\n", ".", ","]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "idiot " * 3000, "x" * 5000 + " idiot"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def hit(word):
        exact = [(-t.weight, k) for k, t in enumerate(terms) if (word == t.text if t.whole else word.startswith(t.text))]
        if exact:
            return min(exact)[1], 0
        near = [(d, k) for k, t in enumerate(terms) if t.whole and 0 < (d := distance(word, t.text)) <= (0 if len(t.text) < 5 else 1 if len(t.text) < 8 else 2)]
        return (min(near)[1], min(near)[0]) if near and word not in innocent else None

    known = {}
    for doc, text in enumerate(texts):
        low = (text or "").lower()
        words = re.findall(r"[^\W_]+", low)
        strength = most = n = 0
        seen = set()
        for i, m in enumerate(re.finditer(r"[^\W_]+", low)):
            if words[i] not in known:
                known[words[i]] = hit(words[i])
            if known[words[i]]:
                k, e = known[words[i]]
                weight = terms[k].weight * 0.7**e * toxicity.Scorer.context(low, m.start(), m.end(), words, i)
                strength, most, n = strength + weight, max(most, weight), n + 1
                seen.add(k)
        x = [math.log1p(strength), math.log1p(100 * strength / len(words)) if words else 0.0, most, math.log1p(len(seen))]
        score = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.intercept)))
        texts[doc] = (doc, text, n, score, int(score >= 0.7))
    frame = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    for doc, _, n, score, predicted in texts:
        assert (got[doc].n_hits, got[doc].predicted) == (n, predicted) and got[doc].score == pytest.approx(score, abs=1e-9)
    assert 20 < sum(t[4] for t in texts) < 280
