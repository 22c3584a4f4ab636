"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, table

#: Made pages that the trees are fitted on, and their seed.
PAGES, SEED = 500, 11
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.3
#: Share of a node's score that comes from its parent.
INHERITED = 0.3
#: Characters of markup that are looked at together.
TOGETHER = 4 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
    " math semantics mrow mi mn mo mtext ms mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mtable mtr mtd menclose mpadded mphantom".split()
)
#: What a reader doesn't see: code, styles, form fields, what stands for a page without scripts or within a frame, titles.
_RAW = frozenset("script style noscript template textarea select iframe title head".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("ul ol dl table div section article main aside nav header footer form body td".split())
_GOOD_TAG, _BAD_TAG = frozenset("article main".split()), frozenset("nav header footer aside form button menu dialog fieldset".split())
_LIST, _PROSE = frozenset("ul ol li dl dt dd".split()), frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption".split())
_GOOD = frozenset("article body content entry main post prose story text blog page news paragraph".split())
_BAD = frozenset("ad ads advert advertisement alert author banner bar breadcrumb breadcrumbs byline comment comments complementary consent contact cookie cookies copyright discuss disqus discussion feedback footer form gdpr head header hero legal login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain pager pagination popup privacy promo promoted recommended related replies reply rail response responses search share sharing side sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar tools top trending widget".split())


class Pages:
    """The nodes of many pages in flat lists: block elements in page order, each run of text a leaf under its element."""

    def __init__(self) -> None:
        self.page: list[int] = []
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.good: list[int] = []
        self.bad: list[int] = []
        self.text: list[str | None] = []
        self.linked: list[int] = []
        self.controls: list[int] = []

    def _add(self, page: int, parent: int, tag: str, names: str, text: str | None = None, linked: int = 0) -> int:
        words = set(_WORD.findall(names.lower())) if names else ()
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(tag)
        self.good.append(sum(w in _GOOD for w in words))
        self.bad.append(sum(w in _BAD for w in words))
        self.text.append(text)
        self.linked.append(linked)
        self.controls.append(0)
        return len(self.page) - 1

    def read(self, page: int, source: str) -> None:
        """Take in a page. Wrong nesting is mended as far as needed: an unknown end tag is ignored, list items, cells
        and paragraphs end where the next one or a block begins."""
        root = self._add(page, -1, "html", "")
        stack = [("html", root)]
        pieces: list[str] = []
        linked = links = 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self._add(page, stack[-1][1], "#" + stack[-1][0], "", text, min(linked, len(text)))
            linked = 0

        while at < end:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                piece = source[at:stop]
                pieces.append(piece)
                if links:
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag not in _INLINE:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            flush()
                            del stack[k:]
                            break
                    else:
                        flush()
                continue
            if tag == "a":
                links = 1
            if tag == "br":
                pieces.append(" ")
            if tag in ("input", "button", "select", "textarea"):
                self.controls[stack[-1][1]] += 1
            if tag in _RAW:
                if tag != "head" and not m[3].rstrip().endswith("/"):
                    closing = _RAW_END[tag].search(source, at)
                    at = closing.end() if closing else (end if tag in ("script", "style", "textarea", "title") else at)
                    continue
                if tag == "head":
                    closing = _RAW_END[tag].search(source, at) or re.compile(r"<body\b", re.I).search(source, at)
                    if closing:
                        at = closing.end() if closing[0].startswith("</") else closing.start()
                continue
            if tag in _INLINE:
                continue
            flush()
            if tag in _VOID:
                continue
            closes = _CLOSES.get(tag, frozenset())
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0]
                if name in closes or name == "p":
                    del stack[k:]
                    if name != "p":
                        break
                elif name in _SCOPE and not (name == "td" and tag in ("tr", "td", "th")):
                    break
            if tag in ("html", "body"):
                continue
            names = " ".join(filter(None, (x for found in _NAMES.findall(m[3]) for x in found))) if m[3] else ""
            stack.append((tag, self._add(page, stack[-1][1], tag, names)))
            if m[3].endswith("/") and tag not in _PROSE | _SCOPE:
                stack.pop()
        flush()

    def features(self) -> tuple[np.ndarray, ...]:
        """Per node its features, text length in the subtree, depth and parent."""
        n = len(self.page)
        page, parent = np.array(self.page), np.array(self.parent)
        depth = np.zeros(n, int)
        for i in range(n):  # a parent stands before its children
            depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
        leaf = np.array([t is not None for t in self.text])
        own = np.array([len(t) if t else 0 for t in self.text])
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.text])
        marks = np.array([t.count(",") + t.count(".") if t else 0 for t in self.text])
        paragraph = np.array([t == "p" for t in self.tag])
        good_tag, bad_tag, listed, prose = (np.array([t.lstrip("#") in s for t in self.tag]) for s in (_GOOD_TAG, _BAD_TAG, _LIST, _PROSE))
        good, bad = np.array(self.good), np.array(self.bad)
        sums = np.stack([own, np.array(self.linked), words, marks, leaf, ~leaf, paragraph, np.array(self.controls), own * (bad + 2 * bad_tag > 0)], 1).astype(float)
        above = np.stack([good > 0, bad > 0, good_tag, bad_tag], 1).astype(float)
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1 if n else 0)]
        for nodes in levels[:0:-1]:
            np.add.at(sums, parent[nodes], sums[nodes])
        inherited = np.zeros_like(above)
        for nodes in levels[1:]:
            inherited[nodes] = inherited[parent[nodes]] + above[parent[nodes]]
        chars, links, words, marks, leaves, elements, paragraphs, controls, bad_chars = sums.T
        up = np.where(parent >= 0, parent, np.arange(n))
        root = np.searchsorted(page, page)
        children, same, linked_near = np.zeros(n), np.zeros(n), np.zeros(n)
        np.add.at(children, up, 1)
        density = links / np.maximum(chars, 1)
        np.add.at(linked_near, up, density)
        order = np.lexsort((np.arange(n), up))
        first = np.concatenate([[True], up[order][1:] != up[order][:-1]]) if n else np.zeros(0, bool)
        place = np.empty(n)
        place[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        codes = {t: k for k, t in enumerate(sorted(set(self.tag)))}
        key = up * (len(codes) + 1) + np.array([codes[t] for t in self.tag])
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        same = count[group]
        out = [depth, np.log1p(chars), density, chars / (1 + elements), np.log1p(paragraphs), chars / np.maximum(chars[root], 1), chars / np.maximum(chars[up], 1), place / np.maximum(children[up], 1), np.log1p(children[up]), same / np.maximum(children[up], 1)]
        out += [linked_near[up] / np.maximum(children[up], 1), 100 * marks / np.maximum(chars, 1), words / np.maximum(leaves, 1), good, bad, inherited[:, 0], inherited[:, 1], bad_chars / np.maximum(chars, 1), good_tag, bad_tag, listed, prose, inherited[:, 2], inherited[:, 3], np.log1p(controls), leaf]
        return np.stack(out, 1).astype(float), chars, depth, parent


class Trees:
    """Gradient-boosted regression trees of the logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        rate = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(x), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            size = (1 << DEPTH) - 1
            feature, cut, at = np.zeros(size, int), np.full(size, BINS), np.zeros(len(x), int)
            for d in range(DEPTH):
                base, nodes = (1 << d) - 1, 1 << d
                best = np.full(nodes, 1e-9)
                for j in range(x.shape[1]):
                    key = (at - base) * BINS + binned[:, j]
                    g, h = (np.cumsum(np.bincount(key, v, nodes * BINS).reshape(nodes, BINS), 1) for v in (grad, hess))
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    top = gain.argmax(1)
                    value = gain[np.arange(nodes), top]
                    better = value > best
                    best[better] = value[better]
                    feature[base : base + nodes][better], cut[base : base + nodes][better] = j, top[better]
                at = 2 * at + 1 + (binned[np.arange(len(x)), feature[at]] > cut[at])
            leaf = at - size
            g, h = (np.bincount(leaf, v, 1 << DEPTH) for v in (grad, hess))
            value = -RATE * g / (h + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        binned, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def made_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made page and its main text's blocks."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 11)))
    odd = rng.random() < 0.15

    def prose(lo: int, hi: int) -> str:
        out = []
        for k in range(int(np.exp(rng.uniform(np.log(lo), np.log(hi))))):
            w = word()
            out.append(w.capitalize() if not k or out[-1][-1] == "." else w)
            if odd:
                out[-1] += pick("", "***", "&amp;&amp;", "$$")
            elif rng.random() < 0.16:
                out[-1] += pick(",", ".", ".")
        return " ".join(out) + pick(".", ".", "", "!")

    def name(*known: str) -> str:
        r = rng.random()
        return f' {pick("class", "id")}="{pick(*known)}"' if r < 0.75 else f' class="{word()}"' if r < 0.85 else ""

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(n)) + "</ul>" if rng.random() < 0.8 else " | ".join(f'<a href="/{word()}">{prose(1, 3)}</a>' for _ in range(n))

    def small(n: int) -> str:
        return "".join(pick(f"<p>{prose(3, 40)}</p>", f"<div>{prose(3, 25)}</div>", f'<p><a href="#">{prose(2, 8)}</a></p>') for _ in range(n))

    def comments() -> str:
        inner = "".join(f'<{t}{name("comment", "reply", "comment-body")}><p>{prose(4, 60)}</p></{t}>' for t in [pick("div", "li", "article")] * rng.integers(1, 7))
        t = pick("section", "div", "div")
        return f'<{t} {pick("class", "id")}="{pick("comments", "comment-list", "responses", "discussion", "reader-comments", "disqus_thread")}"><h3>{prose(1, 3)}</h3>{inner}</{t}>'

    def noise() -> str:
        t = pick("div", "div", "section", "aside")
        return pick(
            f'<div class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner")}">{prose(2, 40)}</div>',
            f'<aside{name("sidebar", "related", "widget", "right-rail")}><h4>{prose(1, 4)}</h4>{small(rng.integers(1, 4))}{links(rng.integers(2, 8))}</aside>',
            f'<{t} class="{pick("sidebar", "side", "related-posts", "widget", "trending")}">{small(rng.integers(0, 3))}{links(rng.integers(2, 8))}</{t}>',
            f'<div {pick("class", "id")}="{pick("cookie-notice", "cookie-banner", "notice", "alert", "gdpr-consent", "notification")}"><p>{prose(5, 60)}</p><button>{prose(1, 3)}</button></div>',
            f'<form{name("search-form", "newsletter", "subscribe", "login", "contact-form")}><label>{prose(1, 6)}</label><input type="text"><p>{prose(2, 30)}</p><button>{word()}</button></form>',
            f'<div class="{pick("share", "social", "breadcrumbs", "tags", "pagination")}">{links(rng.integers(2, 6))}</div>',
        )

    blocks, body = [], []

    def block(tag: str, text: str, shown: str | None = None) -> None:
        blocks.append(" ".join(html.unescape(text).split()))
        body.append(f"<{tag}>{shown or text}</{tag}>")

    if rng.random() < 0.85:
        block(pick("h1", "h1", "h2"), prose(2, 16))
    for k in range(rng.integers(1, 13)):
        text = prose(3 if rng.random() < 0.2 else 12, 180)
        r = rng.random()
        if r < 0.08:
            block("h2", prose(1, 8))
        if r > 0.94:
            for _ in range(rng.integers(2, 6)):
                block("li", prose(2, 30))
        elif r > 0.9:
            block("blockquote", text)
        elif r > 0.75:
            w = text.split(" ")
            block("p", text, " ".join(f'<{pick("b", "em", "strong")}>{x}</b>' if rng.random() < 0.1 else f'<a href="#">{x}</a>' if rng.random() < 0.06 else x for x in w))
        elif r > 0.7:
            block("div", text)
        else:
            block("p", text)
        if rng.random() < 0.08:
            body.append(noise())
    inside = comments() if rng.random() < 0.12 else ""
    core = "".join(body) + inside
    r = rng.random()
    if r < 0.4:
        core = f"<article{name('post', 'story', 'article')}>{core}</article>"
    elif r < 0.55:
        core = f"<main>{core}</main>"
    elif r < 0.97:
        core = f"<div{name('content', 'post-content', 'entry', 'article-body', 'main-text', 'story')}>{core}</div>"
    if rng.random() < 0.3:
        core = f"<{pick('main', 'div', 'section')}{name('wrap', 'container', 'page', 'main')}>{core}</{pick('main', 'div')}>"
    before, after = [], []
    if rng.random() < 0.6:
        before.append(f"<header{name('header', 'site-header', 'masthead')}>{pick('', f'<h1>{prose(1, 4)}</h1>', f'<p>{prose(2, 14)}</p>')}{links(rng.integers(1, 6))}</header>")
    if rng.random() < 0.8:
        before.append(f"<nav{name('menu', 'nav', 'navbar')}>{links(rng.integers(2, 10))}</nav>" if rng.random() < 0.7 else f"<div{name('menu', 'nav', 'topbar')}>{links(rng.integers(2, 10))}</div>")
    for _ in range(rng.integers(0, 4)):
        (before if rng.random() < 0.5 else after).append(noise())
    if rng.random() < 0.35:
        after.append(comments())
    if rng.random() < 0.85:
        foot = f"{pick('&copy; ', '')}{prose(2, 30)} {pick('&middot;', '')} {prose(2, 20)}"
        after.append(f"<footer>{foot}{pick('', links(4))}</footer>" if rng.random() < 0.7 else f'<div class="{pick("footer", "site-footer", "copyright", "bottom-legal")}">{foot}</div>')
    return f"<html><head><title>{prose(1, 9)}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>", blocks


@lru_cache(maxsize=1)
def fitted() -> Trees:
    """The trees, fitted on made pages; a node's target is whether most of its text is main text."""
    rng = np.random.default_rng(SEED)
    nodes, wanted = Pages(), []
    for k in range(PAGES):
        source, blocks = made_page(rng)
        nodes.read(k, source)
        wanted.append(set(blocks))
    x, chars, depth, parent = nodes.features()
    main = np.array([len(t) if t and t in wanted[p] else 0 for t, p in zip(nodes.text, nodes.page)], float)
    for d in range(depth.max(), 0, -1):
        at = np.flatnonzero(depth == d)
        np.add.at(main, parent[at], main[at])
    real = chars > 0
    share = main[real] / chars[real]
    return Trees(x[real], (share > 0.5).astype(float), np.sqrt(np.log1p(chars[real])) * (0.2 + np.abs(2 * share - 1)))


def decoded(nodes: Pages, trees: Trees) -> dict[int, list[str]]:
    """The chosen blocks of each page.

    A node's score is its own log odds and a share of its parent's. A subtree is main text as a whole, or none of it
    is, or its children are decided each for itself: whichever has the greatest sum of scores times text. So what is
    decided for a node holds for all below it.
    """
    x, chars, depth, parent = nodes.features()
    score = trees.score(x)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1 if len(depth) else 0)]
    for at in levels[1:]:
        score[at] = (1 - INHERITED) * score[at] + INHERITED * score[parent[at]]
    best, below = np.abs(score) * chars, np.zeros(len(score))
    for at in levels[::-1]:
        best[at] = np.maximum(best[at], below[at])
        if depth[at[0]]:
            np.add.at(below, parent[at], best[at])
    whole = np.abs(score) * chars >= below
    state = np.zeros(len(score), int)
    for at in levels:
        mine = np.where(whole[at], np.where(score[at] > 0, 1, -1), 0)
        up = np.where(depth[at] > 0, state[np.maximum(parent[at], 0)], 0)
        state[at] = np.where(up, up, mine)
    out: dict[int, list[str]] = {}
    for i in np.flatnonzero(state == 1):
        if nodes.text[i] is not None:
            out.setdefault(nodes.page[i], []).append(nodes.text[i])
    return out


def main_text(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page: blocks joined by an empty line."""
    nodes = Pages()
    for k, source in enumerate(sources):
        nodes.read(k, source)
    found = decoded(nodes, trees)
    return ["\n\n".join(found.get(k, [])) for k in range(len(sources))]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html; other columns are ignored).

    The whole markup is read. Blocks of the main text keep their order; character references are decoded and white
    space in a block is one space. Null or empty html, or no main text: empty text, 0. Other nulls and repeated rows
    stay as they are. Empty table: no rows. The trees are fitted on the driver, on made pages, and sent to executors;
    they have a fixed size.
    """
    ship(pages.sparkSession)
    trees = fitted()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            sources = [s or "" for s in batch.column(2).to_pylist()]
            at = 0
            while at < len(sources):
                stop, size = at, 0
                while stop < len(sources) and (stop == at or size + len(sources[stop]) <= TOGETHER):
                    size += len(sources[stop])
                    stop += 1
                texts = main_text(sources[at:stop], trees)
                yield pa.record_batch([batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)
                at = stop

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table."""
    return extract(table(spark, sf_dir, "pages"))
