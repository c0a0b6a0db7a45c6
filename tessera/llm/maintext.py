"""Main text of web pages by text-to-tag ratio (operator 9).

A page streams through the standard library's parser. Its events become lines,
one per block element, each with its text, its tags and the element it stands in.
The ratio of text to tags per line is smoothed with a Gaussian and split by a
two-means threshold; the lines above it are the content clusters. They select the
region: the article and main elements together, if they hold the bulk of the
content, or else the smallest element around all of it. The region's lines are the
text, without those of elements that are no part of an article: menus, asides,
footers, forms, elements whose whole name says so (``cookie-notice``, but not
``market-share``), and, outside article and main, lists of nothing but links.

Elements with names that articles use too (``discussion``) go only if they hold no
content line, and what holds the largest article or main element, or most of the
content of a page without one, stays whatever it is called. Hidden text inside a
block (a script, a button, ``hidden``) is left out of it; the block's other words stay.

Nulls, ties and clashes: null or empty html gives an empty text; a page without
visible lines too; repeated rows come back each; page_id and url are carried and may be null; extra columns are
ignored; an empty table gives no rows. Length and depth aren't bounded: work and
memory go in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Never text; and elements that are no part of an article.
NEVER = frozenset("script style noscript template head title button select option textarea label iframe object svg canvas audio video map".split())
ASIDE = frozenset("nav footer aside form fieldset dialog menu header".split())
MAIN = frozenset(("article", "main"))
#: Elements that can be the region of a page without article and main.
REGIONS = frozenset("body div section td html #page".split())
#: Words of class, id and role names that mark page furniture, and words that go along with them.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu navbar nav navigation breadcrumb breadcrumbs toolbar pagination pager comment comments commentlist reply replies respond disqus discussion social share sharing related recommended recommendations footer masthead toc skip search searchbox complementary contentinfo".split()
)
ALONG = frozenset("area bar block bottom box buttons button container form global holder icons inner item items left link links list main outer page panel post posts primary right secondary section site sticky thread top unit user widget wrap wrapper".split())
#: Furniture words that sections of an article are called by too.
AMBIGUOUS = frozenset("alert banner discussion notice notices promotion recommendations recommended related replies reply respond response search share sharing skip social subscription toc".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Elements that names never hide.
KEPT = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split())
#: Least share of the content that article and main elements hold if they are the region; of its characters that a menu has in links.
BULK, LINKED = 0.8, 0.8
_NAME = re.compile(r"[a-z]+|[^a-z\W_]+")
_WHITE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that a start tag of these closes, as HTML has it.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Gaussian of the smoothing: standard deviation in lines.
SIGMA = 1.0
#: Rows whose texts are held at once.
_ROWS = 256


def furniture_words(name: str) -> set[str]:
    """The furniture words of a class, id or role name if it is made of nothing but them and words that go along; else none."""
    words = set(_NAME.findall(name.lower()))
    hit = words & FURNITURE
    return hit if hit and words <= FURNITURE | ALONG | {w for w in words if w.isdigit()} else set()


class _Page(HTMLParser):
    """Parser events to elements, numbered as they open, and lines (text, tags, element, linked characters, hidden?)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.parent, self.hidden = ["#page"], [0], [False]
        #: by element: 0 if it goes where it holds no content line, 1 if its name says what it is, 2 if the element itself does
        self.furniture: dict[int, int] = {}
        #: elements in which no article is the page's own
        self.foreign: set[int] = set()
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.stack, self.opened = [0], Counter()
        self.text: list[str] = []
        self.veiled: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        for data, hidden in ((self.text, False), (self.veiled, True)):
            text = _WHITE.sub(" ", "".join(data)).strip()
            if text:
                self.lines.append((text, self.tags, self.stack[-1], self.linked, hidden))
                self.tags = self.linked = 0
        self.text, self.veiled = [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            self.shut("p")
        if tag == "body":
            self.shut("head")
        if tag in _CLOSES:
            while self.names[self.stack[-1]] in _CLOSES[tag]:
                self.pop()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                (self.veiled if self.hidden[self.stack[-1]] else self.text).append(" ")
            return
        e = len(self.names)
        hidden = self.hidden[self.stack[-1]] or tag in NEVER
        words: set[str] = set()
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _UNSEEN.search(value)):
                hidden = hidden or tag not in ("html", "body")
            elif value and name in ("class", "id", "role"):
                for x in value.split():
                    words |= furniture_words(x)
        if tag in ASIDE and not (tag == "header" and any(self.opened[m] for m in MAIN)):
            self.furniture[e] = 2
        elif words and tag not in KEPT:
            if tag in BLOCK:
                self.furniture[e] = 0 if words <= AMBIGUOUS else 1
            else:
                # inside a block a name hides its own words alone
                hidden = hidden or not words <= AMBIGUOUS
        if tag in ("nav", "footer", "aside") or words & COMMENTS:
            self.foreign.add(e)
        self.names.append(tag)
        self.parent.append(self.stack[-1])
        self.hidden.append(hidden)
        self.stack.append(e)
        self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self) -> str:
        name = self.names[self.stack.pop()]
        self.opened[name] -= 1
        return name

    def shut(self, tag: str) -> None:
        """Close the innermost ``tag`` with all inside it; nothing if it isn't open."""
        if self.opened[tag]:
            while self.pop() != tag:
                pass

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag not in VOID:
            self.shut(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden[self.stack[-1]]:
            if self.names[self.stack[-1]] not in ("script", "style"):
                self.veiled.append(data)
            return
        self.text.append(data)
        if self.opened["a"]:
            self.linked += len(data.strip())

    # figures of elements, each a pass over the elements: children come after their parents

    def held(self, some: np.ndarray, what: list[int]) -> list[int]:
        """The sum of ``what`` over these lines, by element."""
        out = [0] * len(self.names)
        for i in np.flatnonzero(some).tolist():
            out[self.lines[i][2]] += what[i]
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inside(self, some: set[int]) -> np.ndarray:
        """Whether each line is inside one of these elements."""
        within = [False] * len(self.names)
        for e in range(len(within)):
            within[e] = e in some or (e > 0 and within[self.parent[e]])
        return np.array([within[x[2]] for x in self.lines], bool)

    def above(self, e: int) -> set[int]:
        found = set()
        while e:
            e = self.parent[e]
            found.add(e)
        return found


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the kernel normalised over the lines there are."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(x, kernel)[r : r + len(x)] / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def threshold(x: np.ndarray) -> float:
    """The cut between two clusters of ``x`` that leaves the least variance within them."""
    s = np.sort(x)
    if s[0] == s[-1]:
        return float(s[0])
    n = np.arange(1, len(s))
    left, left2 = np.cumsum(s)[:-1], np.cumsum(s * s)[:-1]
    right, right2 = s.sum() - left, (s * s).sum() - left2
    within = left2 - left * left / n + right2 - right * right / (len(s) - n)
    return float(s[int(np.argmin(within)) + 1])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = _Page()
    p.feed(html)
    p.close()
    p.flush()
    lines = p.lines
    seen = np.array([not x[4] for x in lines], bool)
    if not seen.any():
        return ""
    chars = [len(x[0]) for x in lines]
    own = np.array([n / max(1, x[1]) for n, x in zip(chars, lines, strict=True)])
    ratio = smooth(own)
    cut = threshold(ratio)
    cluster = ratio >= cut
    dense = cluster & (own >= cut)
    seen &= ~p.inside(_furniture(p, seen, dense, cluster, chars))
    if not seen.any():
        return ""
    content = seen & cluster
    if not content.any():
        content = seen
    weight = p.held(content, chars)
    region = _named_region(p, seen, weight)
    if not region:
        # smoothing lifts a footer next to the content into its cluster: lines bound the region that have its ratio by themselves
        bound = p.held(seen & dense if (seen & dense).any() else content, chars)
        root = max(e for e in range(len(bound)) if bound[e] == bound[0] and p.names[e] in REGIONS)
        keep = seen & p.inside({root})
        keep &= ~p.inside(_menus(p, keep, dense, root, chars))
        # a headline right before the region belongs to it
        i = int(np.flatnonzero(keep)[0]) - 1
        if i >= 0 and seen[i] and any(p.names[e] == "h1" for e in {lines[i][2], *p.above(lines[i][2])}):
            keep[i] = True
    else:
        keep = seen & p.inside(region)
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(keep))


def _furniture(p: _Page, seen: np.ndarray, dense: np.ndarray, cluster: np.ndarray, chars: list[int]) -> set[int]:
    """The elements that go."""
    if not p.furniture:
        return set()
    weight, every = p.held(seen & cluster, chars), p.held(seen, chars)
    foreign = [False] * len(p.names)
    for e in range(1, len(foreign)):
        foreign[e] = e in p.foreign or foreign[p.parent[e]]
    main = max((e for e in range(len(weight)) if p.names[e] in MAIN and every[e] and not foreign[e]), key=lambda e: (weight[e], every[e]), default=None)
    around = p.above(main) if main is not None else {e for e in p.furniture if 2 * weight[e] > weight[0] and (p.furniture[e] < 2 or p.names[e] in ("form", "header"))}
    held = p.held(seen & dense, chars)
    return {e for e, kind in p.furniture.items() if e not in around and (kind or not held[e])}


def _named_region(p: _Page, seen: np.ndarray, weight: list[int]) -> set[int]:
    """The article and main elements that hold the bulk of the content, with those beside them; of nested ones that hold as much the inner. None if they don't."""
    if not any(n in MAIN for n in p.names):
        return set()
    visible = p.held(seen, [1] * len(p.lines))
    top = [0] * len(p.names)
    inner: dict[int, int] = {}
    for e in range(1, len(top)):
        top[e] = top[p.parent[e]] or (e if p.names[e] in MAIN else 0)
        if p.names[e] in MAIN and visible[e] and weight[e] == weight[top[e]]:
            inner[top[e]] = e
    if sum(weight[t] for t in inner) < BULK * weight[0]:
        return set()
    beside = {p.parent[t] for t in inner if weight[t]}
    return {e for t, e in inner.items() if weight[t] or p.parent[t] in beside}


def _menus(p: _Page, keep: np.ndarray, dense: np.ndarray, root: int, chars: list[int]) -> set[int]:
    """Elements below the region without a line of content's own ratio, of two lines or more and nearly all links."""
    one = [1] * len(chars)
    n, prose, size, linked = p.held(keep, one), p.held(keep & dense, one), p.held(keep, chars), p.held(keep, [x[3] for x in p.lines])
    return {e for e in range(root + 1, len(n)) if n[e] > 1 and not prose[e] and linked[e] >= LINKED * size[e] and p.names[e] in BLOCK}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
