"""Main text of web pages by tag-path ratios (operator 2).

A page is cut into blocks of text, each with its root-to-leaf path of block tags. Text length and
punctuation outside links are averaged over the blocks of a path and fused with the path's share of the
page's text; the fused score is smoothed along the page, which lets a neighbourhood of text carry its odd
paths a little. Blocks of at least the page's threshold are content. The article is the smallest element
that holds most of the score, and all of it belongs to the result but for what boilerplate's tags and class
names mark within it.

Such marks lower a score too, but the ratios stand without them: with all marks ignored nearly every page
of the test tables comes out the same. A class name marks where it says nothing else (``comment-list``,
not ``notice-board``), the article's own header is no page header, and a section's weak name (related,
discussion) drops nothing within the article.

Time and memory are linear in the page, however deep its elements nest.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_of
from .textvec import in_slices

#: Their content is never text of the page; unclosed, they reach to its end.
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes|annotation"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?:[/!?]|[a-zA-Z])[^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mspace mstyle mpadded mphantom semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Not shown, if they are closed: else (drawings apart) they are no element at all.
UNSEEN = frozenset("noscript template svg canvas video audio object applet head".split())
#: Tags and words in class, id or role that speak against text: what a score is multiplied with.
FAINT, WEAK = 0.02, 0.5
FAINT_TAGS = frozenset("nav footer aside form button select option menu dialog".split())
FAINT_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar toolbar footer sidebar rail ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login comment comments disqus respond replies "
    "breadcrumb breadcrumbs pagination pager search complementary contentinfo".split()
)
WEAK_WORDS = frozenset("aside widget related recommended recommendations share sharing social reply discussion".split())
#: What such a name may hold besides; any other word makes it a name of its own.
PLAIN_WORDS = frozenset(
    "site page main global primary secondary top bottom left right inner outer box block container wrapper wrap list item items area section bar panel row col column unit slot link links post posts article articles "
    "story stories news content text body title author user reader thread feed toggle button buttons icon icons logo form info google fixed sticky mobile desktop".split()
)
PUNCTUATION = re.compile(r"[.,;:!?¿¡…、。]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SMOOTH = np.exp(-0.5 * np.array([-2, -1, 0, 1, 2]) ** 2)
MOST, LINKS, MARKED_LINKS, SHORT = 0.8, 0.9, 0.5, 60
OWN = 0.75  # weight of a block's own path against its neighbours'
#: Which open elements a start tag ends, and the elements that shelter them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",)),
}


def _mark(tag: str, attrs: str) -> tuple[float, float]:
    """How far the element itself speaks for text: 1, less, or 0 if it is hidden; and the same within an article, which has a header of its own."""
    value, within = (FAINT, FAINT) if tag in FAINT_TAGS else (FAINT, 1.0) if tag == "header" else (1.0, 1.0)
    if not attrs:
        return value, within
    said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
    if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
        return 0.0, 0.0
    if tag in ("html", "body", "main"):
        return value, within
    for name in " ".join(said.get(k, "") for k in ("class", "id", "role")).split():
        words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}
        if words - FAINT_WORDS - WEAK_WORDS - PLAIN_WORDS:
            continue
        if words & FAINT_WORDS:
            value = FAINT
            within = min(within, FAINT if words & FAINT_WORDS - {"header", "banner"} else 1.0)
        elif words & WEAK_WORDS:
            value, within = min(value, WEAK), min(within, WEAK)
    return value, within


class Page:
    """The elements of a page (``parent``, ``tag``, ``path``, ``prior`` of each, by number; ``within``: its own mark
    where it is part of an article) and its blocks of text (``node``: the element, ``texts``, ``links``: the share of
    letters in links), in order. Element 0 holds all."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.prior, self.within = [0], [""], [0], [1.0], [1.0]
        self.node: list[int] = []
        self.texts: list[str] = []
        self.links: list[float] = []
        self._read(page)

    def _read(self, page: str) -> None:
        tags: list[str] = []  # of the open elements, with the number of the innermost block element at each
        blocks = [0]
        at: dict[str, list[int]] = {}  # where they are open, by tag
        paths: dict[tuple[int, str], int] = {}
        last_end = {}  # of the unseen elements' end tags
        unseen = 0
        pieces: list[str] = []
        linked = 0
        low = page.lower()

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.node.append(blocks[-1])
                    self.texts.append(text)
                    self.links.append(min(1.0, linked / len(text)))
                pieces.clear()
            linked = 0

        def close(depth: int) -> None:
            nonlocal unseen
            while len(tags) > depth:
                if tags[-1] not in INLINE:
                    flush()
                tag = tags.pop()
                at[tag].pop()
                blocks.pop()
                unseen -= tag in UNSEEN

        def last(names, stop=()) -> int:
            place = lambda x: max((at[t][-1] for t in x if at.get(t)), default=-1)
            found = place(names)
            return found if found > place(stop) else -1

        m, end = None, page.rfind(">") + 1  # beyond it there is text alone
        for m in TOKEN.finditer(page, 0, end):
            text = m["text"]
            if text is not None:
                if not unseen:
                    text = entities.unescape(text)
                    pieces.append(text)
                    if at.get("a"):
                        linked += len(text)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if (i := last((tag,))) >= 0:
                    close(i)
                elif tag == "br":
                    pieces.append(" ")
                continue
            if tag in VOID:
                if tag == "br" and not unseen:
                    pieces.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in UNSEEN and tag != "svg":  # text blocks end a drawing
                if tag not in last_end:
                    last_end[tag] = low.rfind(f"</{tag}")
                if last_end[tag] < m.end():
                    continue
            if tag not in INLINE:
                if at.get("svg") and tag not in UNSEEN and tag in ("p", "div", "ul", "ol", "table", "blockquote", "pre", "body", *HEADINGS):
                    close(at["svg"][0])
                if (i := last(("p",), ("table", "button", "object", "td", "th"))) >= 0:
                    close(i)
                if tag in ENDS and (i := last(*ENDS[tag])) >= 0:
                    close(i)
                flush()
            elif tag == "a" and (i := last(("a",))) >= 0:
                close(i)
            attrs = m["attrs"] or ""
            if attrs.endswith("/") and (tag in UNSEEN or tag in MATH or tag not in INLINE and tag not in ("p", "div")):
                continue
            up = blocks[-1]
            own, within = _mark(tag, attrs)
            prior = min(self.prior[up], within if at.get("article") or at.get("main") else own)
            if tag not in INLINE or prior < self.prior[up]:  # an inline element with a mark of its own is one too
                if tag in INLINE:
                    flush()
                self.parent.append(up)
                self.tag.append(tag)
                self.path.append(paths.setdefault((self.path[up], tag), len(paths) + 1))
                self.prior.append(prior)
                self.within.append(within)
                blocks.append(len(self.parent) - 1)
            else:
                blocks.append(up)
            at.setdefault(tag, []).append(len(tags))
            tags.append(tag)
            unseen += tag in UNSEEN
        open_ = m is not None and (m["raw"] and not re.search(r"</[^<>]*>\Z", m[0]) or m[0].startswith("<!--") and not m[0].endswith("-->"))
        if not open_ and not unseen:
            pieces.append(entities.unescape(page[end:].partition("<!--")[0]))
        close(0)
        flush()


def path_ratios(page: Page) -> np.ndarray:
    """Of each block: its path's mean text length and punctuation, times the path's share of the page's text, smoothed along the page; links count for nothing."""
    path = np.array(page.path)[page.node]
    plain = 1 - np.array(page.links)
    count = np.maximum(np.bincount(path), 1)
    text = np.bincount(path, plain * [len(t) for t in page.texts])
    marks = np.bincount(path, plain * [len(PUNCTUATION.findall(t)) for t in page.texts])
    ratio = (text / count * (1 + np.log1p(marks / count)) * text / max(text.sum(), 1))[path]
    near = ratio
    if len(path) >= len(SMOOTH):
        near = np.convolve(ratio, SMOOTH, "same") / np.convolve(np.ones(len(path)), SMOOTH, "same")
    return near ** (1 - OWN) * ratio**OWN * plain


def path_scores(page: Page) -> np.ndarray:
    """The ratios, lowered by marks of boilerplate."""
    return path_ratios(page) * np.array(page.prior)[page.node]


def main_text(html: str | None) -> str:
    """The article, its blocks joined by empty lines; empty if there is none."""
    page = Page(html or "")
    if not page.node:
        return ""
    score = path_scores(page)
    limit = min(score.std(), score.mean()) or score.max()
    # The smallest element, leaves aside, with most of the score: of those that have it, the last opened.
    held = np.zeros(len(page.parent))
    np.add.at(held, np.array(page.parent)[page.node], score)
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
    article = int(np.flatnonzero(held >= MOST * score.sum() * (1 - 1e-9))[-1])
    broad = page.tag[article] in ("", "html", "body")
    # Marks between the article and each of its elements; elsewhere, and where a whole page is the article, all marks count.
    inside, mark = [article == 0] * len(held), list(page.prior)
    for i in range(1, len(held)):
        inside[i] = i == article or inside[page.parent[i]]
        if inside[i] and not broad:
            mark[i] = 1.0 if i == article else min(mark[page.parent[i]], page.within[i])
    content = np.flatnonzero(score >= limit)
    first, last = (content[0], content[-1]) if len(content) else (0, len(score))
    lists: dict[int, int] = {}
    is_link = [k >= LINKS and len(t) < SHORT and s < limit for k, t, s in zip(page.links, page.texts, score, strict=True)]
    for i, link in zip(page.node, is_link, strict=True):
        if link:
            lists[page.parent[i]] = lists.get(page.parent[i], 0) + 1
    kept = []
    for k, (i, text) in enumerate(zip(page.node, page.texts, strict=True)):
        own = inside[i] and not broad
        if not page.prior[i] or mark[i] < 1 and page.links[k] >= MARKED_LINKS and score[k] < limit:
            continue
        if is_link[k] and lists[page.parent[i]] >= 3 and not own:
            continue
        if mark[i] <= FAINT and (score[k] < limit or not inside[i]):
            continue
        if score[k] < limit and not own and (not inside[i] or mark[i] < 1 or not first <= k <= last and page.tag[i] not in HEADINGS):
            continue
        kept.append(text)
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` without ``html``, and text, n_chars (its code points).

    A null or empty page, or one without an article, gives an empty text. Repeated rows are each
    extracted; an empty table gives an empty one. Columns named text or n_chars are replaced; other
    columns are kept as they are.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, html, limit=4 << 20):
            texts = [main_text(x) for x in batch.column(html).to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(*keep, text_of(html).alias(html)).mapInArrow(extract, schema)
