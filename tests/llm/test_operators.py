"""The training-data operators against brute force, on rows with every odd case."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.llm import extract, minhash, mixing, packing, quality, repeats, secrets, toxicity, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, key string, spans string, size string, row int, draws int"


def texts():
    rng = random.Random(1)
    syllables = ["the", "on", "er", "ha", "tion", "re", "st", "édi", "ou", "lich", "bo", "ña"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
    passage = prose(60)
    out = [prose(rng.randint(5, 200)) for _ in range(30)]
    out += [f"{prose(20)} {passage} {prose(20)}" for _ in range(6)]
    base = prose(150)
    out += [base] * 4
    for i in range(5):
        near = base.split(" ")
        near[7 * i] = "changed"
        out.append(" ".join(near))
    out += [None, "", " \n\t ", "one two", "one two", "Shti " * 400, "a" * 500, "x y　z \U0001f600 " * 30, prose(4000)]
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    out += [f'{prose(10)} token = "{secret}" {prose(5)}', f"{prose(5)} API-KEY: abc PASSWORD='pa' passwd:longenough1 AKIA{'Q7' * 8}Z", "ghp_" + "Ab3dEf9hIj" * 3]
    out += ["you idiot moron " + prose(30), 'he said "idiot" ' + prose(30)]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", f"src{i % 4}" if i % 9 else None, None if t is None else len(t), i, "k", "s", "z", i, i) for i, t in enumerate(texts())]
    found.append((None, "one two three four five six", "en", "src1", 27, 0, None, None, None, None, None))
    found.append(found[3])  # a repeated row
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, rows):
    return Counter(map(tuple, frame.collect())) == Counter(rows)


def test_repeats(docs, rows, nothing):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    n = 200
    seen = Counter(t[i : i + n] for _, t in data for i in range(len(t) - n + 1))
    want = []
    for doc, t in data:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        want.append((doc, len(t), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    assert same(repeats.repeat_digests(docs), want)
    assert repeats.repeat_digests(nothing).count() == 0


def test_repeats_where_groups_are_split_and_texts_cut(docs, rows, monkeypatch):
    whole = Counter(map(tuple, repeats.repeat_digests(docs).collect()))
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", 2)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert Counter(map(tuple, repeats.repeat_digests(docs).collect())) == whole


def test_a_passage_of_many_texts_makes_no_large_group(spark, monkeypatch):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = letters(230)
    frame = spark.createDataFrame([(i, letters(300) + passage + letters(300)) for i in range(24)], "doc_id long, text string")
    whole = Counter(map(tuple, repeats.repeat_digests(frame).collect()))
    sizes, split = [], repeats._split_groups

    def watched(rows, length, limit):
        out = split(rows, length, limit)
        met = out[0] if isinstance(out, tuple) else out
        sizes.extend(r["count"] for r in met.groupBy("key").count().collect())
        return out

    monkeypatch.setattr(repeats, "_split_groups", watched)
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", 3)
    assert Counter(map(tuple, repeats.repeat_digests(frame).collect())) == whole
    assert max(sizes, default=0) <= 3 and all(n >= 230 for _, _, n, *_ in whole)


def test_interval_expansion_on_random_strings():
    rng = random.Random(3)
    for _ in range(150):
        length, n, kinds = rng.choice([1, 2, 3, 5, 8, 20]), rng.randint(1, 300), rng.choice([1, 2, 4])
        s = np.array([rng.randint(1, kinds) if rng.random() > 0.02 else 0 for _ in range(n)] + [0], np.uint16)
        windows = Counter(bytes(s[i : i + length].astype(np.uint8)) for i in range(n + 2 - length))
        got = repeats.repeated_starts(s, length)
        for i in range(n + 2 - length):
            w = bytes(s[i : i + length].astype(np.uint8))
            assert 0 in w or got[i] == (windows[w] > 1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="nav-open">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><div class="ad">Buy now.</div>
<div class="cookie-notice">We use cookies, please agree.</div><article><h1>Head &amp; title</h1><p><b>First   text,<br>with a break.</b><p>Second&nbsp;one &lt;tag&gt;, longer than the first, and so on; it ends.
<blockquote>Quoted words, here too.</blockquote><form>Search</form><div id="comments"><p>I like this, very much. Really, I do.</p></div></article>
<aside>Also read this, it is good.</aside><footer>&copy; 2024</footer></body></html>"""


def test_extraction(spark):
    want = "Head & title\n\nFirst text, with a break.\n\nSecond one <tag>, longer than the first, and so on; it ends.\n\nQuoted words, here too."
    assert extract.main_text(PAGE) == want
    pages = [(1, "u", PAGE, "old", 5), (1, "u", PAGE, "old", 5), (None, None, None, None, None), (3, "u", "", "", 0), (4, "u", "no markup at all", "", 0), (5, "u", "<p>open <b>bold<p>next, one", "", 0), (6, "u", "<", "", 0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars long")
    got = extract.extract_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert same(got, [(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (3, "u", "", 0), (4, "u", "no markup at all", 16), (5, "u", "open bold\n\nnext, one", 20), (6, "u", "<", 1)])
    assert extract.extract_text(frame.limit(0)).count() == 0


SECTIONS = """<html><body><nav><a href=a>Home</a> and more</nav><article><h1>T</h1><p>First one, it is long enough, really so. Yes.</p>
<section class="related-work"><h2>Related work</h2><p>Others did, long ago, some of it; here is what, and why it matters.</p></section>
<section class="discussion"><p>We discuss, at length, what this means. It means a lot, we think.</p></section>
<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><noscript><p>After an unclosed one, it goes on.</p><svg><text>drawn</text>
<p>After a drawing, too.</p><div id=comments><p>Nice, I like.</p></div></article><div class="ad">Buy it, now. Really.</div><footer>c</footer></body></html>"""


def test_sections_of_an_article_stay():
    text = extract.main_text(SECTIONS)
    assert text.split("\n\n") == [
        "T", "First one, it is long enough, really so. Yes.", "Related work", "Others did, long ago, some of it; here is what, and why it matters.",
        "We discuss, at length, what this means. It means a lot, we think.", "Let x=2 be.", "After an unclosed one, it goes on.", "After a drawing, too.",
    ]


def test_path_scores_equal_plain_sums():
    for html in (PAGE, SECTIONS):
        page = extract.Page(html)
        chain = lambda i: () if i == 0 else (*chain(page.parent[i]), page.tag[i])
        paths = [chain(i) for i in page.node]
        plain = [1 - k for k in page.links]
        total = lambda values, p: sum(v * k for v, k, q in zip(values, plain, paths, strict=True) if q == p)
        letters, points = [len(t) for t in page.texts], [len(extract.PUNCTUATION.findall(t)) for t in page.texts]
        whole = sum(v * k for v, k in zip(letters, plain, strict=True))
        ratio = [total(letters, p) / paths.count(p) * (1 + math.log1p(total(points, p) / paths.count(p))) * total(letters, p) / whole for p in paths]
        n, kernel = len(paths), [math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)]
        near = [sum(k * ratio[i + d] for d, k in zip(range(-2, 3), kernel, strict=True) if 0 <= i + d < n) / sum(k for d, k in zip(range(-2, 3), kernel, strict=True) if 0 <= i + d < n) for i in range(n)]
        want = [a**0.25 * b**0.75 * k * page.prior[i] for a, b, k, i in zip(near, ratio, plain, page.node, strict=True)]
        assert n >= 5 and np.allclose(extract.path_scores(page), want)


def made_page(rng, marked):
    """A page and the text of its article."""
    word = lambda: rng.choice(["stone", "river", "walks", "of", "and", "the", "late", "was", "under"])
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "!", ", so."])
    cls = lambda name: f' class="{name}"' if marked else ""
    blocks = [("h1", prose(5))] + [(rng.choice(["p", "p", "p", "blockquote", "h2", "pre"]), prose(rng.randint(20, 90))) for _ in range(rng.randint(4, 12))]
    blocks += [("p", prose(3)), ("p", prose(40))]
    menu = "".join(f"<li><a href='/{i}'>{word()}</a></li>" for i in range(rng.randint(3, 8)))
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    top, side = f"<div{cls('site-header')}>{prose(3)}</div><div{cls('main-nav')}><ul>{menu}</ul></div>", f"<div{cls('sidebar')}><span>{prose(4)}</span></div>"
    page = f"<html><body>{top}<div{cls('article-body')}>{body}</div>{side}<div{cls('page-footer')}>Copyright 2020. {prose(4)}</div></body></html>"
    return page, "\n\n".join(x for _, x in blocks)


@pytest.mark.parametrize("marked", [True, False])
def test_made_pages_give_their_articles(marked):
    rng = random.Random(11)
    for _ in range(150):
        page, want = made_page(rng, marked)
        assert extract.main_text(page) == want


def test_ratios_decide_and_marks_help(monkeypatch):
    rng = random.Random(12)
    pages = [made_page(rng, True) for _ in range(100)]
    monkeypatch.setattr(extract, "path_ratios", lambda page: np.ones(len(page.node)))
    bare = [extract.main_text(page.replace("class=", "data-x=")) for page, _ in pages]
    assert not any(got == want for got, (_, want) in zip(bare, pages, strict=True))  # without ratios and marks no page comes out right


STORY = " ".join(["Words, words and more of them, as a story goes."] * 8)


@pytest.mark.parametrize(
    "part, kept",
    [
        ('<section class="discussion"><h2>Discussion</h2><p>A short remark.</p></section>', ["Discussion", "A short remark."]),
        (f'<section class="related-work"><h2>Related work</h2><p>{STORY}</p><p>Short.</p></section>', ["Related work", STORY, "Short."]),
        ('<div class="notice-board"><p>It hung there.</p></div>', ["It hung there."]),
        ('<div class="header"><h1>Title</h1></div>', ["Title"]),
        ('<p class="ad-hoc">Ad hoc it was.</p><p id="search-results">Found two.</p>', ["Ad hoc it was.", "Found two."]),
        ('<ul><li><a href="1">Ref one</a></li><li><a href="2">Ref two</a></li><li><a href="3">Ref three</a></li></ul>', ["Ref one", "Ref two", "Ref three"]),
        ('<div id="comments"><p>I like it, really.</p></div>', []),
        ('<div class="user-comment"><p>Me too, yes.</p></div>', []),
        ('<div class="ad-slot-1">Buy it, now.</div><div class="newsletter-signup"><p>Join us!</p></div>', []),
        ('<div class="related-posts"><a href="1">One</a> <a href="2">Two</a></div>', []),
        ("<aside>Read this, too.</aside>", []),
    ],
)
def test_marks_within_an_article(part, kept):
    page = f'<html><body><nav><a href="a">Home</a><a href="b">News</a></nav><div id="content"><h1>T</h1><p>{STORY}</p>{part}<p>{STORY} End.</p></div><footer>c</footer></body></html>'
    assert extract.main_text(page).split("\n\n") == ["T", STORY, *kept, f"{STORY} End."]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_ratios_alone_give_nearly_every_page(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    want = [extract.main_text(p) for p in pages]
    mark = extract._mark
    monkeypatch.setattr(extract, "_mark", lambda tag, attrs: (1.0, 1.0) if mark(tag, attrs)[0] else (0.0, 0.0))
    assert sum(extract.main_text(p) == w for p, w in zip(pages, want, strict=True)) >= 0.9 * len(pages)


def test_deep_and_broken_pages_take_linear_time():
    n = 100_000
    assert extract.main_text("<div>text" * n).count("text") >= n - 2
    for page in ("<div>text", "<a<", "<p><b>x", "<svg>", "<table><tr><td>x", '<a title="', "<!--", "<script>"):
        extract.main_text(page * n)


def vector_rows(n=900):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    for i in range(0, n, 3):
        x[i + 1] = x[i] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.28])
    x[30:60] = x[30] + rng.standard_normal((30, 16)) * 0.03
    x[100:110] = x[100]
    out = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    out += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 0), (n + 4, x[0].tolist(), None), (n + 5, [], 0), (n + 6, x[0].tolist()[:8], 0), (None, x[0].tolist(), 0)]
    return out


@pytest.mark.parametrize("cell", [1000, 60])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", cell)
    data = vector_rows()
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("hash_a", F.lit(1))
    got = {r["vec_id"]: r for r in vectors.link_vectors(frame).collect()}
    assert len(got) == len(data)
    sound = [(i, v, g) for i, v, g in data if i is not None and g is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v for _, v, _ in sound], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = np.array([k for _, _, k in sound])
    link = (x @ x.T >= vectors.LEAST) & (g[:, None] == g)
    np.fill_diagonal(link, False)
    links, found = link.sum(), 0
    for k, (i, _, _) in enumerate(sound):
        assert got[i]["n_links"] <= link[k].sum()
        found += got[i]["n_links"]
    assert links > 200 and found >= 0.99 * links
    ids = np.array([i for i, _, _ in sound])
    least = ids.copy()
    while True:
        lower = np.minimum(least, np.where(link, least, ids.max()).min(1))
        if (lower == least).all():
            break
        least = lower
    assert [got[i]["component_id"] for i in ids.tolist()] == least.tolist()
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i)
        if i not in {s[0] for s in sound}:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
    assert vectors.link_vectors(frame.limit(0)).count() == 0


def test_mixing(docs, rows, nothing):
    got = mixing.mix_documents(docs).toPandas()
    assert len(got) == len(rows) and list(got.block.fillna(0)) is not None
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, rest = dict(size), {}, 1.5 * sum(size.values())
    while left:
        full = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / full > 2 * size[s]]
        if not over:
            target |= {s: rest * weight[s] / full for s in left}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        rest -= sum(target[s] for s in over)
        left = {s: n for s, n in left.items() if s not in over}
    taken = Counter()
    for r in got.itertuples():
        source = r.source if isinstance(r.source, str) else None
        assert r.source_size == size[source] and math.isclose(r.target, target[source])
        assert 0 <= r.taken <= 2 * int(got["size"][r.Index])
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = mixing.mix_documents(docs.repartition(5)).toPandas()
    key = lambda f: sorted(zip(f.doc_id.fillna(-1), f["size"], f.taken, strict=True))
    assert key(got) == key(again)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == got.taken.sum()
    assert mixing.mix_documents(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0


def test_shards_hold_whole_blocks_and_exact_quotas(spark):
    """Blocks recomputed in plain Python: each draw of a block goes to one shard whole, passes draw every block once, shards get equal numbers of draws."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), f"s{i % 3}" if i % 7 else None) for i in range(900)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    n = Counter(r.source for r in got)
    where, words = {}, Counter()
    for r in got:
        block = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:15], 16) % math.ceil(math.sqrt(n[r.source]))
        assert len({d.epoch for d in r.draws}) == len(r.draws)
        for d in r.draws:
            where.setdefault((r.source, block, d.epoch), set()).add(d.shard)
            words[r.source, d.epoch] += d.words
    assert all(len(shards) == 1 for shards in where.values())
    quotas = Counter(next(iter(x)) for x in where.values())
    assert set(quotas.values()) <= {len(where) // 64, -(-len(where) // 64)} and sum(quotas.values()) == len(where)
    for r in got:
        passes = int(round(r.target) // r.source_size)
        for epoch in range(passes):
            assert words[r.source, epoch] == r.source_size  # a whole pass
        assert words[r.source, passes] == round(r.target) - passes * r.source_size


def test_splitting_tree_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 200), (2, 101)], "rank int, draws long")
    got = mixing.splitting_tree(quotas, 4, "s").toPandas()
    assert dict(got.groupby("rank").draws.sum()) == {0: 700, 1: 200, 2: 101}
    per = got.groupby("shard").draws.sum()
    assert len(per) == 16 and per.min() >= 62 and per.max() <= 63
    assert got[got["rank"] == 0].draws.std() > 0


def labelled(spark, rows):
    return spark.createDataFrame([(i, i % 2, int("idiot" in (r[1] or ""))) for i, r in enumerate(rows[:-2])] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, nothing):
    rng = random.Random(6)
    bad = ["idiot", "moron", "worthless", "pathetic"]
    many = []
    for i in range(600):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "loved", "lower"]) for _ in range(40)]
        if i % 5 == 0:
            words[3], words[20] = rng.choice(bad), rng.choice(bad)
        many.append((i, " ".join(words)))
    frame = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame, labels, allowed=~toxicity.held_out())
    got = toxicity.toxicity_scores(frame, labels).toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id])
    assert (got.held_out == held).all()
    assert ((got.predicted == 1) == (got.doc_id % 5 == 0)).mean() > 0.98
    plain = "you are a worthles and pathetic idoit"
    quoted = 'he said "worthless" and "idiot"'
    odd = spark.createDataFrame([(1, plain), (2, quoted), (3, ""), (4, None), (5, "alpha beta " * 30000)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert score[1] > 0.7 > score[3] and score[3] == score[4] and score[5] < 0.5 and score[2] < score[1]
    assert toxicity.score_toxicity(docs, model, keep_text=True).select(*docs.columns).count() == docs.count()
    blank = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(nothing, blank).count() == 0


def test_every_sure_term_is_kept(spark):
    word = lambda i: "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:04d}")
    rng = random.Random(2)
    each = [j for j in range(600) for _ in range(25)]
    rng.shuffle(each)
    rows = [(i, " ".join(word(j) for j in each[30 * i : 30 * i + 30]), 1) for i in range(500)]
    rows += [(500 + i, " ".join(f"plain{rng.randrange(40)}" for _ in range(30)), 0) for i in range(500)]
    # Copies of one toxic text are no evidence for its other words.
    rows += [(1000 + i, rows[0][1] + " singular", 1) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.Lexicon(toxicity.learn_terms(sample))
    assert all(lexicon.match(word(j)) for j in range(600))
    assert lexicon.match("singular") is None and lexicon.match("plain7") is None


def test_apostrophes_within_words_quote_nothing():
    context = toxicity.Scorer.context
    weight = lambda text: context(text, text.index("idiot"), text.index("idiot") + 5, text.split(), 0)
    assert weight("i don't care, you idiot, it's over") == weight("l'homme est un idiot, c'est sur") == 1
    assert weight("they shout 'you idiot' at him") == weight('they shout "you idiot" at him') == weight("they shout «idiot» now") == 0.4
    assert weight('"a line"\nyou idiot\n"and a line"') == 1


def test_words_beyond_24_letters_are_terms(spark):
    long = "x" * 20 + "abcdefgh"
    rows = [(i, f"{long} filler{i} more{i}", 1) for i in range(40)] + [(50 + i, f"{long[:25]}other clean{i}", 0) for i in range(40)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert any(t.whole and t.text == long for t in terms)


def test_automaton_equals_edit_distance():
    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    terms = [toxicity.Term(t, True, 1.0) for t in ("idiot", "pathetic", "scum", "worthless")]
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(9)
    for _ in range(1500):
        t = rng.choice(terms).text
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(0, len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(i, rng.choice("abcst"))
            elif i < len(w):
                w[i : i + 1] = [] if kind == 1 else [rng.choice("abcst")]
        w = "".join(w)
        want = [(plain(w, x.text), k) for k, x in enumerate(terms) if plain(w, x.text) <= toxicity._edits(x.text, True)]
        got = lexicon.match(w)
        assert (got is None) == (not want) and (got is None or got[1] == min(want)[0])


def test_edits_at_the_first_letter():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = [toxicity.Term(t, True, 1.0) for t in ("idiot", "pathetic", "scum", "worthless")]
    lexicon = toxicity.Lexicon(terms)
    assert lexicon.match("1diot") == lexicon.match("diot") == lexicon.match("xidiot") == (0, 1) and lexicon.match("cum") is None
    assert lexicon.match("thetic") == lexicon.match("xxthetic") == (1, 2)
    rng, words = random.Random(10), []
    for _ in range(1500):
        w = list(rng.choice(terms).text)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(0, len(w)) if rng.random() < 0.6 else 0
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "s", "t"])
        words.append("".join(w))
    for w in words:
        want = min(((plain(w, x.text), k) for k, x in enumerate(terms) if plain(w, x.text) <= toxicity._edits(x.text, True)), default=None)
        got = lexicon.match(w)
        assert got is None if want is None else (got[1], got[0]) == want
    assert lexicon.matches(words) == {w: m for w in words if (m := lexicon.match(w))}


def test_archives(spark, tmp_path):
    pages = [(5, "http://a\r\nX: y", "same"), (3, "u", "same"), (3, "u", "same"), (9, None, None), (8, "u", ""), (None, "u", "same"), (7, "u", "é" * 100_000), (2, "u", "\r\n\r\nbody"), (4, "u", "lonely")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("hash", F.lit(1))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(frame).collect()]
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = least[h or ""] == i
        want.append((i, len(data), warc.digest(data), "response" if first else "revisit", None if first else least[h or ""]))
    assert Counter(got) == Counter(want)
    every = warc.archive_round_trip(frame, least_bytes=10**9).collect()
    assert {r["record_type"] for r in every} == {"response"}
    archives = warc.write_archives(frame, str(tmp_path / "warc"))
    bodies = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(archives).where("record_type = 'response'").collect()}
    many = warc.write_archives(frame.repartition(5), str(tmp_path / "many"))
    assert warc.read_archives(many).rdd.getNumPartitions() == many.count()
    assert bodies[7] == ("é" * 100_000).encode() and bodies[2] == b"\r\n\r\nbody"
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_damaged_archives():
    import io

    good = warc.record("1", "u", b"payload" * 1000, None, "2024-01-01T00:00:00Z")
    assert len(list(warc.read_records(io.BytesIO(good + good)))) == 2
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good + good[:-5])))
    text = zlib.decompress(good, 31)
    for wrong in (text.replace(b"payload", b"PAYLOAD", 1), text.replace(b"Content-Length: ", b"Content-Length: 1", 2), b"HTTP" + text):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(pack.compress(wrong) + pack.flush())))


def shingles(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates(docs, rows, nothing):
    named = [r for r in rows if r[0] is not None]
    n = len(rows)
    sets = [shingles(r[1]) for r in rows]
    df = Counter(k for s in sets for k in s)
    weight = [{k: c * math.log1p(min(n / df[k], 256)) for k, c in s.items()} for s in sets]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            both = sum(min(v, weight[j].get(k, 0)) for k, v in weight[i].items())
            total = sum(weight[i].values()) + sum(weight[j].values()) - both
            if rows[i][0] is not None and rows[j][0] is not None and (sets[i] == sets[j] and WORD.findall((rows[i][1] or "").lower()) == WORD.findall((rows[j][1] or "").lower()) or total and both / total >= 0.8):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[root(i)] = min(groups.get(root(i), r[0]), r[0])
    want = [(r[0], groups[root(i)], groups[root(i)] == r[0]) if r[0] is not None else (None, None, True) for i, r in enumerate(rows)]
    assert same(minhash.near_duplicates(docs), want)
    assert len({w[1] for w in want}) < len(named) - 10
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_large_mixed_buckets(spark, monkeypatch):
    """One continuum of texts, so that buckets hold several classes: classes equal those of all links."""
    monkeypatch.setattr(minhash, "FEW", 0)
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for _ in range(150):
        now = list(base)
        for _ in range(rng.randrange(5)):
            now[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(50)]
    sets, n = [shingles(t) for t in texts], len(texts)
    df = Counter(k for s in sets for k in s)
    weight = [{k: c * math.log1p(min(n / df[k], 256)) for k, c in s.items()} for s in sets]
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            both = sum(min(v, weight[j].get(k, 0)) for k, v in weight[i].items())
            if both >= 0.8 * (sum(weight[i].values()) + sum(weight[j].values()) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert len(set(root)) > 55 and len(set(root)) < n - 20
    assert sum(found[i] == root[i] for i in range(n)) >= 0.99 * n


def continuum(seed, n=120):
    """Texts with up to six edits of one text, and the class of each by all links."""
    rng = random.Random(seed)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(60)], []
    for _ in range(n):
        now = list(base)
        for _ in range(rng.randrange(7)):
            now[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    sets = [shingles(t) for t in texts]
    df = Counter(k for s in sets for k in s)
    weight = [{k: c * math.log1p(min(n / df[k], 256)) for k, c in s.items()} for s in sets]
    root, links = list(range(n)), set()
    for i in range(n):
        for j in range(i):
            both = sum(min(v, weight[j].get(k, 0)) for k, v in weight[i].items())
            if both >= 0.8 * (sum(weight[i].values()) + sum(weight[j].values()) - both):
                links.add((j, i))
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return texts, root, links


def test_no_link_of_a_large_bucket_hangs_on_further_samples(spark, monkeypatch):
    """Pairs of texts around one passage, which fills buckets with all of them; further samples never meet."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(40):
        own = [word() for _ in range(20)]
        texts += [" ".join([*passage, *own, *(word() for _ in range(4))]) for _ in range(2)]
    real = minhash.signatures
    unlucky = lambda docs, idf, skip=0: real(docs, idf, skip).withColumn("bands", F.transform("bands", lambda b: F.xxhash64(b, "doc_id"))) if skip else real(docs, idf)
    for name, value in {"FEW": 0, "LEVELS": 1, "BANDS": 6, "ROWS": 1, "FLOOR": 1, "signatures": unlucky}.items():
        monkeypatch.setattr(minhash, name, value)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i // 2 * 2 for i in range(len(texts))}


def test_the_exact_way_offers_every_link(spark):
    texts, _, links = continuum(6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = minhash.document_frequencies(docs)
    own = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("class"))
    offered = {tuple(r) for r in minhash._alike(docs, own, idf, 0.8).collect()}
    assert len(links) > 40 and links <= offered and len(offered) < len(texts) * (len(texts) - 1) / 4


def test_the_exact_way_makes_no_row_for_each_shingle(spark, monkeypatch):
    """Of one group, and of one three times as large, tables and pairs grow with the texts; a few texts are outside of its class."""
    made, real = [], minhash.staged

    def told(df, name):
        out = real(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "staged", told)
    rows = []
    for n in (100, 300):
        texts, _, _ = continuum(9, n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        own = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") < 4, F.col("doc_id")).otherwise(4).alias("class"))
        idf = minhash.Idf(n, np.zeros(0, np.uint64), np.zeros(0))
        made.clear()
        offered = minhash._alike(docs, own, idf, 0.8).count()
        assert sum(made) + offered < 0.3 * sum(len(shingles(t)) for t in texts)
        rows.append(sum(made) + offered)
    assert rows[1] < 3.5 * rows[0]


def test_pairs_across_classes_have_a_row_outside_of_the_largest(spark):
    rows = [(1, i, 7) for i in range(50)] + [(1, 50, 8), (1, 51, 9)] + [(2, i, 7) for i in range(50)] + [(3, 1, 7), (3, 50, 8)]
    left = minhash._outside(spark.createDataFrame(rows, "bucket long, id long, class long"), "bucket")
    assert sorted(map(tuple, left.select("bucket", "id", "class").collect())) == [(1, 50, 8), (1, 51, 9), (3, 1, 7)]


def test_samples_collide_as_often_as_texts_are_alike():
    rng = np.random.default_rng(8)
    h = rng.integers(1, 1 << 44, 300, np.uint64)
    a, b = rng.gamma(2, 1, 300) + 0.1, rng.gamma(2, 1, 300) + 0.1
    b[:200] = a[:200]
    sampler = minhash.Sampler(1.0, 2000)
    order = np.argsort(h)
    x = sampler(np.zeros(300, np.int64), h[order], a[order])[:, 0]
    y = sampler(np.zeros(300, np.int64), h[order], b[order])[:, 0]
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs, window=256).toPandas()
    for _, sequence in got.groupby("sequence_id"):
        s = sequence.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    pieces = Counter((None if math.isnan(p.doc_id) else int(p.doc_id), p.doc_tokens) for p in got.astype({"doc_id": float}).itertuples())
    for r in rows:
        ids = [*encoder.encode(r[1] or "", add_special_tokens=False).ids, 2]
        data = np.array(ids, "<u4").tobytes()
        own = got[got.doc_id.isna() if r[0] is None else got.doc_id == r[0]]
        own = own.drop_duplicates("start").sort_values("start")
        assert pieces and list(own.start) == [0, *np.cumsum(own.length)[:-1]] or r == rows[3]
        for p in own.itertuples():
            part = data[4 * p.start : 4 * (p.start + p.length)]
            assert bytes(p.ids) == part and zlib.crc32(part) == p.ids_crc32 and p.doc_tokens == len(ids)
    filled = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in filled)
    assert got.length.sum() == sum(len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert padding < 0.6 * got.length.sum()
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("window, loose", [(64, 4), (256, 0), (256, 32)])
def test_loose_windows_are_packed_anew(window, loose):
    """Every piece's tokens lie in one sequence once; what padding stays is within ``loose`` of a window, or none at a power of two."""
    rng = random.Random(window + loose)
    for _ in range(60):
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
        pieces = [(doc, 0, n) for doc, n in enumerate(lengths)]
        fitted = packing.best_fit(lengths, window)
        sequences = packing.pack_pieces(pieces, window, loose)
        held = {}
        for sequence in sequences:
            total = sum(n for _, _, n in sequence)
            assert total <= window and (window - total <= loose or total & (total - 1) == 0)
            for doc, start, n in sequence:
                held.setdefault(doc, []).append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, part in sorted(held[doc]):
                assert start == at and part > 0
                at += part
            assert at == n
        tight = [g for g in fitted if window - sum(lengths[i] for i in g) <= loose or (t := sum(lengths[i] for i in g)) & (t - 1) == 0]
        padding = sum(window - t for t in (sum(n for _, _, n in s) for s in sequences) if t & (t - 1))
        assert padding <= loose * len(tight)  # only windows that best fit had filled keep padding


def test_best_fit_equals_a_plain_search():
    rng = random.Random(7)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 200))]
        open_, want = [], 0
        for s in sorted(sizes, reverse=True):
            fit = min((c for c in open_ if c >= s), default=None)
            if fit is None:
                want, fit = want + 1, 64
            else:
                open_.remove(fit)
            open_.append(fit - s)
        windows = packing.best_fit(sizes, 64)
        assert len(windows) == want and sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 64 for w in windows)


def test_ids_of_odd_words():
    rng, encode = random.Random(1), packing.WordIds(packing.default_tokenizer())
    letters = "aZéÀß×÷'<|>.,!19 \n\t\xa0　İΣς中x"
    for k in range(400):
        batch = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3)] + ["<|endoftext|>" * (k % 2)]
        ids, first = encode([x.encode() for x in batch])
        for i, x in enumerate(batch):
            assert list(ids[first[i] : first[i + 1]]) == encode.tokenizer.encode(x, add_special_tokens=False).ids


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(x):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_secrets(docs, rows, nothing):
    got = secrets.secret_digests(docs).toPandas()
    want = []
    for r in rows:
        s = base_spans(r[1] or "")
        n = Counter(k for _, _, k, _ in s)
        want.append((r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()).hexdigest()))
    have = [(None if math.isnan(r.doc_id) else int(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.astype({"doc_id": float}).itertuples()]
    assert Counter(have) == Counter(want) and sum(w[1] + w[2] + w[3] for w in want) >= 4
    assert any("token:" in s for s in got.spans)
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(docs).collect()}
    assert secrets.redact_secrets(docs).columns == docs.columns and len(clean) == len(rows) - 1
    for r in rows:
        now, spans = clean[r[0]], base_spans(r[1] or "")
        assert now["block"] == r[5] and now["spans"] == r[7]
        assert spans and "<SECRET>" in now["text"] or not spans and (now["text"] == r[1] or "<SECRET>" in now["text"])
        assert not any(b - a > 24 for a, _, _, b in base_spans(now["text"] or ""))
    assert secrets.secret_digests(nothing).count() == 0


def test_spans_of_the_method(docs, rows):
    """Tokens outside base spans, judged by owners and repositories."""
    found = []
    for i, r in enumerate(rows):
        x = r[1] or ""
        base = base_spans(x)
        tokens = [(m.start(), 3, "token", m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{24,}", x) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        apart = [t for t in tokens if not any(b[0] < t[3] and t[0] < b[3] for b in base)]
        value = lambda s: ASSIGN.match(x, s[0])[2] if s[2] == "assign" else x[s[0] : s[3]]
        found += [(i, r[3], r[0], s, value(s)) for s in base + apart]
    spread = {}
    for _, owner, repository, _, v in found:
        spread.setdefault(v, set()).add((owner, repository))
    want = {i: [] for i in range(len(rows))}
    for i, _, _, s, v in found:
        plain = re.search("example|sample|dummy|placeholder|changeme|xxxx|0000000|1234567|abcdefg", v, re.I)
        few = len({o for o, _ in spread[v]}) <= 2 and len(spread[v]) <= 10
        if s[2] != "token" or few and not plain and len(set(v)) >= 8:
            want[i].append(s)
    have = Counter((r["doc_id"], r["spans"]) for r in secrets.secret_digests(docs).collect())
    assert have == Counter((r[0], ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want[i]))) for i, r in enumerate(rows))
    assert any(s[2] == "token" for spans in want.values() for s in spans)


def test_a_text_of_many_secrets(spark):
    n = 100_000
    text = "é ".join(f"token={i:08d}x" for i in range(n))
    frame = spark.createDataFrame([(1, text, "s"), (2, "none", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_assign"] for r in secrets.secret_digests(frame).collect()}
    assert got == {1: n, 2: 0}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame).collect()}
    assert clean[1] == "é ".join(["<SECRET>"] * (n - 1)) + "é <SECRET>" and clean[2] == "none"


def test_copies_within_one_owner_are_examples(spark):
    example = "Zq8vKp2mTx7wLs4nRb9cYd3f"
    rows = [(i, f"see {example} here", "one owner") for i in range(12)]
    assert all(r["spans"] == "" for r in secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_widely_copied_tokens_are_examples(spark):
    example, own = "Zq8vKp2mTx7wLs4nRb9cYd3f", "Hj5tQw8eRu2iOp6aSd4fGk1l"
    rows = [(i, f"see {example} here", f"owner{i}") for i in range(6)] + [(9, f"mine {own} x", "owner1")]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[9] == "token:5:29" and not any(got[i] for i in range(6))


def test_quality(spark, docs, rows, nothing):
    labels = labelled(spark, rows)
    got = quality.quality_verdicts(docs, labels).toPandas()
    want = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = [False] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit[i] = hit[i + 1] = hit[i + 2] = True
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), sum(hit), len(w) < 50 or 100 * sum(hit) > 50 * len(w))] += 1
    have = Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.astype({"doc_id": float}).itertuples())
    assert have == want and not (got.kept & got.base_failed).any()
    model = quality.fit_quality(nothing, labels.limit(0))
    assert quality.quality_rules(docs.select("doc_id", "text"), model).where("kept").count() == sum(n for k, n in want.items() if not k[-1])
    assert quality.quality_rules(nothing, model).count() == 0


def test_quality_verdicts_equal_a_plain_evaluator(docs, rows):
    """Each text alone, n-gram by n-gram, with a model of random weights."""
    from sitefold.llm.textvec import words

    rng = np.random.default_rng(5)
    model = quality.Model(rng.standard_normal(3 << quality.BITS).astype(np.float32) * 0.05, 0.2, 1.3, -0.1)
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def score(text):
        h = [int(x) for x in words([text]).hash]
        pairs = [int(quality.mixed(np.array([(a * 3 + b) & mask], np.uint64))[0]) for a, b in zip(h, h[1:])]
        line = text + b"\n"  # a text's last characters are told from others by its end
        threes = [(int.from_bytes(line[i : i + 3], "little") * golden) & mask for i in range(len(line) - 2)]
        z = model.intercept
        for k, grams in enumerate((h, pairs, threes)):
            found = [float(model.weights[(g >> 64 - quality.BITS) + (k << quality.BITS)]) for g in grams]
            z += 100.0 * sum(found) / max(1, len(found))
        return 1 / (1 + math.exp(-(model.slope * z + model.offset)))

    number = lambda i: -1 if i is None else i
    want = sorted((number(r[0]), score((r[1] or "").encode())) for r in rows)
    got = quality.quality_rules(docs.select("doc_id", "text"), model).collect()
    have = sorted((number(r.doc_id), r.score) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert all(a == pytest.approx(b, abs=1e-9) for (_, a), (_, b) in zip(have, want, strict=True))
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) for r in got) and len({r.kept for r in got}) == 2


def test_quality_is_learned(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        words = [rng.choice(["tree", "river", "stone", "cloud", "grass", "house", "light"]) + str(rng.randrange(50)) for _ in range(60)]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if i % 3 == 0 else " ".join(words), int(i % 3 != 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_quality(frame.where("doc_id < 300").select("doc_id", "text"), frame.select("doc_id", "quality"))
    got = quality.quality_rules(frame.where("doc_id >= 300"), model).toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97
