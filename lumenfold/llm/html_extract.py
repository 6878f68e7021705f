"""HTML extraction: gradient-boosted trees over DOM nodes, decoded so that no choice contradicts another.

A page is parsed into block nodes; inline markup only contributes text and link shares. Trees
score each node's chance of holding main text. Decoding keeps or drops whole subtrees: under a
dropped node everything is dropped, and a node is kept only if something below it is; among such
choices the likeliest is found exactly, bottom up, in linear time.

The tables have no node labels, so the trees are trained on pages written here by ``write_page``,
whose blocks know whether they are main text; layouts, tag names, attributes, broken markup and
lengths vary. The number of pages is a parameter; training is deterministic.

Parsing takes time linear in the page, whatever its markup: the scanner never goes back, and open
elements are found by their tag, not by a walk up the page.

Cases. A null or empty page has an empty text. Unclosed and stray tags, cut-off pages and pages
without markup are parsed as far as they go; a tag that the page's end cuts off is no text. Very
long pages are taken whole. A null page_id or
url passes through; repeated rows give equal texts; an empty table gives an empty result. Extra
columns aren't read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by role.
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas select option button textarea audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input link meta area embed param source track".split())
RAW = frozenset({"script", "style"})
CLOSES_PARAGRAPH = frozenset("address article aside blockquote body center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}

PARAGRAPH, AROUND_PARAGRAPH = frozenset({"p"}), frozenset("td th body li dd button div section article blockquote form aside main".split())

# Groups of tags and of attribute tokens that become features.
TAG_GROUPS = ({"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div", "center"}, {"section"}, {"article", "main"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html"}, {"#run"}, {"dialog", "details", "address"})
TOKEN_GROUPS = (
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager", "skip"},
    {"header", "masthead", "banner", "topbar", "logo", "branding", "hero"},
    {"footer", "copyright", "colophon", "legal", "bottom"},
    {"sidebar", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "complementary", "more"},
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "commercial", "dfp", "adsense"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "paywall", "subscribe", "newsletter", "signup", "login"},
    {"comment", "comments", "disqus", "reply", "replies", "discussion", "respond", "reader", "reviews"},
    {"share", "social", "sharing", "follow", "tags", "byline", "meta", "tools"},
    {"search", "form", "input", "contact"},
    {"content", "article", "post", "entry", "main", "story", "body", "text", "page", "blog"},
)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_MARKS = re.compile(r"[.,;:!?]")


_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)?+(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?+))?+""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Longer than any character's number; Python refuses to read endless ones.
_LONG_REFERENCE = re.compile(r"&#(?:0*([0-9]{8,})|[xX]0*([0-9a-fA-F]{7,}));?")


def characters(text: str) -> str:
    """``text`` with its character references decoded."""
    if "&" not in text:
        return text
    return unescape(_LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text)


def scan(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """("text", text, []), ("start" or "empty", tag, attributes) and ("end", tag, []) of a page, in order."""
    at, size = 0, len(html)
    text_from = 0
    while at < size:
        at = html.find("<", at)
        if at < 0:
            break
        following = html[at + 1 : at + 2]
        name = _TAG_NAME.match(html, at + 1) if following.isascii() and following.isalpha() else None
        closing = _TAG_NAME.match(html, at + 2) if following == "/" else None
        if name is None and closing is None and following not in ("!", "?", "/"):
            at += 1  # a plain "<"
            continue
        if text_from < at:
            yield "text", characters(html[text_from:at]), []
        if name is not None:
            tag, k, attributes = name[0].lower(), name.end(), []
            while k < size and html[k] != ">":
                m = _ATTRIBUTE.match(html, k)
                if m.end() == k or m[1] is None and m.end() < size and html[m.end()] != ">":
                    k = max(m.end(), k + 1)  # a stray quote
                    continue
                if m[1]:
                    attributes.append((m[1].lower(), next((v for v in m.groups()[1:] if v), "")))
                k = m.end()
            if k >= size:
                return
            at = text_from = k + 1
            yield ("empty" if html[k - 1] == "/" else "start"), tag, attributes
            if tag in RAW and html[k - 1] != "/":
                end = _RAW_END[tag].search(html, at)
                stop = size if end is None else end.start()
                yield "text", html[at:stop], []
                at = text_from = stop
            continue
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):  # an empty comment, cut short
                stop = html.index(">", at) + 1
            else:
                stop = end + 3 if (end := html.find("-->", at + 4)) >= 0 else -1
        else:
            stop = html.find(">", at) + 1 or -1
        if stop < 0:
            return
        at = text_from = stop
        if closing is not None:
            yield "end", closing[0].lower(), []
    if text_from < size:
        yield "text", characters(html[text_from:]), []


class Page:
    """Block nodes of a page, in order, and the runs of text that each of them holds directly."""

    GONE = "#gone"  # an inline element that was closed below others that are still open

    def __init__(self, html: str):
        self.tag, self.parent, self.tokens, self.marked = ["html"], [-1], [frozenset()], [False]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self.stack: list[tuple[str, int]] = [("html", 0)]  # open elements; inline ones share their block's node
        self.places: dict[str, list[int]] = defaultdict(list)  # where each tag stands on the stack
        self.blocks = [0]  # where blocks stand on it
        self.hidden: list[str] = []
        self.hidden_tags: Counter[str] = Counter()
        self.links = 0
        self.piece: list[str] = []
        self.in_links = 0
        for kind, what, attributes in scan(html):
            if kind == "text":
                self.on_text(what)
            elif kind == "end":
                self.on_end(what)
            else:
                self.on_start(what, attributes)
                if kind == "empty" and (what in VOID or what in ("svg", "math", "iframe", "script")):
                    self.on_end(what)
        self.end_run()

    def end_run(self) -> None:
        text = " ".join("".join(self.piece).split())
        if text:
            self.runs.append((self.stack[-1][1], text, min(self.in_links, len(text))))
        self.piece, self.in_links = [], 0

    def on_text(self, data: str) -> None:
        if not self.hidden:
            self.piece.append(data)
            if self.links:
                self.in_links += len(data)

    def push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        if tag != self.GONE:
            self.places[tag].pop()
            self.links -= tag == "a"
        if self.blocks[-1] == len(self.stack):
            self.blocks.pop()

    def pop_to(self, k: int) -> None:
        self.end_run()
        while len(self.stack) > k:
            self.pop()

    def open_index(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int | None:
        """The outermost open element of ``names`` that is inside the innermost of ``stop``."""
        places = self.places
        floor = max((places[t][-1] for t in stop if places.get(t)), default=0)
        inside = [p[k] for t in names if (p := places.get(t)) and p[-1] > floor for k in (bisect_right(p, floor),)]
        return min(inside, default=None)

    def on_start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if tag in UNSEEN:
            if tag not in VOID:
                self.hidden.append(tag)
                self.hidden_tags[tag] += 1
            if tag not in ("head", "title") and len(self.hidden) < 2:
                self.piece.append(" ")
            return
        if self.hidden:
            if tag == "body":
                self.hidden.clear()
                self.hidden_tags.clear()
            else:
                return
        if tag == "html" or (tag == "body" and self.places["body"]):
            return
        if tag == "br" or (tag in INLINE and tag in VOID):
            self.piece.append(" ")
            return
        if tag in INLINE:
            self.links += tag == "a"
            self.push(tag, self.stack[-1][1])
            return
        if tag in CLOSES_PARAGRAPH and (k := self.open_index(PARAGRAPH, AROUND_PARAGRAPH)) is not None:
            self.pop_to(k)
        if tag in CLOSES and (k := self.open_index(*CLOSES[tag])) is not None:
            self.pop_to(k)
        self.end_run()
        if tag in VOID:
            return
        words = " ".join(v for n, v in attributes if n in ("class", "id", "role", "aria-label", "itemprop", "data-role"))
        self.tag.append(tag)
        self.parent.append(self.stack[-1][1])
        self.tokens.append(frozenset(t.lower() for t in _TOKEN.findall(characters(words))) if words else frozenset())
        self.marked.append(any(n == "data-main-text" for n, _ in attributes))
        self.blocks.append(len(self.stack))
        self.push(tag, len(self.tag) - 1)

    def on_end(self, tag: str) -> None:
        if self.hidden:
            while self.hidden_tags[tag]:
                last = self.hidden.pop()
                self.hidden_tags[last] -= 1
                if last == tag:
                    break
            return
        if tag in VOID or tag in ("html", "body") or not self.places.get(tag):
            return
        k = self.places[tag][-1]
        if tag not in INLINE:
            self.pop_to(k)
        elif k > self.blocks[-1]:  # inline elements above stay open, as formatting does
            self.places[tag].pop()
            self.links -= tag == "a"
            self.stack[k] = (self.GONE, self.stack[k][1])
            while self.stack[-1][0] == self.GONE:
                self.pop()


def parse(html: str | None) -> Page:
    """A page whose runs beside block children have become leaf nodes of their own."""
    page = Page(html or "")
    has_blocks = {p for p in page.parent if p >= 0}
    runs = []
    for node, text, linked in page.runs:
        if node in has_blocks:
            page.tag.append("#run")
            page.parent.append(node)
            page.tokens.append(frozenset())
            page.marked.append(page.marked[node])
            node = len(page.tag) - 1
        runs.append((node, text, linked))
    page.runs = runs
    return page


N_FEATURES = 2 * (len(TAG_GROUPS) + len(TOKEN_GROUPS)) + 16
_TAG_GROUP = {t: k for k, g in enumerate(TAG_GROUPS) for t in g}
_TOKEN_GROUP = {t: k for k, g in enumerate(TOKEN_GROUPS) for t in g}


def node_features(page: Page) -> np.ndarray:
    """One row per node: own and ancestors' tag and attribute groups, sizes, densities, place, siblings."""
    n, parent = len(page.tag), page.parent
    up = np.array(parent)
    own, chars, linked, words, marks, runs = (np.zeros(n) for _ in range(6))
    first = np.full(n, np.inf)
    seen = 0
    for k, text, in_links in page.runs:
        own[k] += len(text)
        linked[k] += in_links
        words[k] += text.count(" ") + 1
        marks[k] += len(_MARKS.findall(text))
        runs[k] += 1
        first[k] = min(first[k], seen)
        seen += len(text)
    chars += own
    nodes, below, children = np.ones(n), np.zeros(n), np.zeros(n)
    depth = np.zeros(n)
    # runs' leaves stand at the end, but a parent always comes before its children
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        words[p] += words[k]
        marks[p] += marks[k]
        nodes[p] += nodes[k]
        children[p] += 1
        first[p] = min(first[p], first[k])
        below[p] = max(below[p], below[k] + 1)
    tags, marks_of = len(TAG_GROUPS), len(TOKEN_GROUPS)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    index = np.zeros(n)
    count: dict[int, int] = {}
    for k in range(n):
        p = parent[k]
        g = _TAG_GROUP.get(page.tag[k])
        if g is not None:
            x[k, g] = 1
        for t in page.tokens[k]:
            g = _TOKEN_GROUP.get(t)
            if g is not None:
                x[k, tags + g] = 1
        if p >= 0:
            depth[k] = depth[p] + 1
            index[k] = count.get(p, 0)
            count[p] = count.get(p, 0) + 1
            at = tags + marks_of
            x[k, at : 2 * at] = np.maximum(x[p, :at], x[p, at : 2 * at])
    siblings = np.maximum(children[up], 1)
    around = (chars[up] - chars) / np.maximum(siblings - 1, 1)
    first[np.isinf(first)] = seen
    total = max(1, seen)
    x[:, -16:] = np.stack(
        [depth, np.log1p(chars), np.log1p(own), linked / np.maximum(chars, 1), chars / nodes, own / np.maximum(chars, 1), first / total, chars / total, np.log1p(children), below, index / siblings, np.log1p(siblings), np.log1p(np.maximum(around, 0)), marks / np.maximum(words, 1), chars / np.maximum(words, 1), np.log1p(nodes)],
        axis=1,
    )
    return x


# ---------------------------------------------------------------- gradient-boosted trees


@dataclass
class Boosted:
    """Trees as arrays: split feature, threshold (go right if above) and leaf values by heap position."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaves.shape[1].bit_length() - 1
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss with histogram splits."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, base)
    inner, n_leaves = 2**depth - 1, 2**depth
    all_f, all_t, all_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        f, t = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            sums = np.bincount(local, g, width), np.bincount(local, h, width)
            whole = sums[0] ** 2 / (sums[1] + ridge)
            cut = np.zeros(width, dtype=np.int64)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = local * bins + binned[:, j]
                gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(edges[j])]
                hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(edges[j])]
                gr, hr = sums[0][:, None] - gl, sums[1][:, None] - hl
                gain = np.where((hl > 0.5) & (hr > 0.5), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole[:, None], 0)
                k = gain.argmax(axis=1)
                v = gain[np.arange(width), k]
                better = v > best
                best[better], cut[better], f[first : first + width][better] = v[better], k[better], j
                t[first : first + width][better] = edges[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, n_leaves) / (np.bincount(leaf, h, n_leaves) + ridge)
        score += value[leaf]
        all_f.append(f)
        all_t.append(t)
        all_v.append(value)
    return Boosted(base, np.array(all_f), np.array(all_t), np.array(all_v))


# ---------------------------------------------------------------- decoding


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The likeliest consistent choice: nodes to keep.

    A kept node has kept ancestors and holds a kept run of its own or below. With log-odds s, keeping
    a set scores the sum of its s, so a subtree's best is max(0, s + the best of its children), where
    a node without kept text can't be kept.
    """
    n, parent = len(page.tag), page.parent
    holds = np.zeros(n, dtype=bool)
    for k, *_ in page.runs:
        holds[k] = True
    kids = np.zeros(n)  # of the children worth keeping
    best, best_kid = np.full(n, -np.inf), np.full(n, -1)
    total = np.zeros(n)
    for k in range(n - 1, -1, -1):
        # without text of its own, a node needs one child, its best, even at a loss
        total[k] = log_odds[k] + (kids[k] if holds[k] or best[k] > 0 else best[k])
        if (p := parent[k]) >= 0:
            kids[p] += max(0.0, total[k])
            if total[k] > best[p]:
                best[p], best_kid[p] = total[k], k
    keep = np.zeros(n, dtype=bool)
    keep[0] = total[0] > 0
    for k in range(1, n):
        p = parent[k]
        keep[k] = keep[p] and (total[k] > 0 or (best_kid[p] == k and not holds[p]))
    return keep


def extract(html: str | None, model: Boosted) -> str:
    return extract_many([html], model)[0]


def extract_many(pages: Sequence[str | None], model: Boosted, nodes_together: int = 50_000) -> list[str]:
    out: list[str] = []
    waiting: list[tuple[Page, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        scores = model.log_odds(np.concatenate([x for _, x in waiting]))
        start = 0
        for page, x in waiting:
            keep = decode(page, scores[start : start + len(x)])
            start += len(x)
            out.append("\n".join(text for k, text, _ in page.runs if keep[k]))
        waiting.clear()
        size = 0

    for html in pages:
        page = parse(html)
        waiting.append((page, node_features(page)))
        size += len(page.tag)
        if size >= nodes_together:
            flush()
    if waiting:
        flush()
    return out


# ---------------------------------------------------------------- pages to train on


class _Writer:
    """Writes one random page; ``data-main-text`` marks the blocks of main text."""

    def __init__(self, rng: random.Random):
        self.r = rng
        letters = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ch", "ung", "ción", "eau", "ou", "ti", "es", "or", "st"]
        self.vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(60)]
        self.style = rng.choice(["", "", "", "", "symbols", "bars", "capitals"])

    def text(self, least: int, most: int) -> str:
        r = self.r
        n = min(most, max(least, int(r.lognormvariate(3.2, 1.2))))
        words = []
        for k in range(n):
            w = r.choice(self.vocabulary)
            if self.style == "symbols":
                w += r.choice(["###", "$$$", "%%%", "&&&"])
            elif self.style == "capitals":
                w = w.upper() + "!!"
            if r.random() < 0.1:
                w += r.choice([",", ".", ".", "?"])
            words.append(w.capitalize() if k == 0 or r.random() < 0.05 else w)
        return escape((" | " if self.style == "bars" else " ").join(words) + r.choice([".", ".", ""]), quote=False)

    def link(self) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.text(1, 3)}</a>'

    def links(self) -> str:
        items = [self.link() for _ in range(self.r.randint(2, 9))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def wrap(self, choices: Sequence[tuple[str, str]], inside: str) -> str:
        tag, name = self.r.choice(list(choices))
        attr = f' {self.r.choice(["class", "id"]) if tag in ("div", "section", "aside", "p", "ul") else "class"}="{name}"' if name else ""
        return f"<{tag}{attr}>{inside}</{tag}>"

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            words = text.split(" ")
            k = r.randrange(len(words))
            words[k] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(words[k])
            text = " ".join(words)
        return text

    def main_block(self) -> str:
        r, m = self.r, " data-main-text"
        kind = r.random()
        if kind < 0.76:
            text = self.inline(self.text(1, 400))
            shape = r.random()
            if shape < 0.12:
                return f"<p{m}><b>{text}<br>"
            return f"<p{m}>{text}" + ("</p>" if shape < 0.9 else "")
        if kind < 0.84:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}{m}>{self.text(1, 8)}</{h}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li{m}>{self.inline(self.text(1, 25))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote{m}>{self.text(5, 50)}</blockquote>"
        if kind < 0.97:
            return f"<div{m}>{self.text(5, 100)}</div>"
        return "<table>" + "".join(f"<tr><td{m}>{self.text(1, 4)}</td><td{m}>{self.text(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"

    def advert(self) -> str:
        return self.wrap([("div", "ad"), ("div", "ads banner"), ("div", "advert"), ("div", "sponsored"), ("aside", "promo"), ("section", "advertisement"), ("p", "ad")], self.text(2, 60) if self.r.random() < 0.6 else f"<p>{self.text(2, 60)}</p>{self.link()}")

    def notice(self) -> str:
        return self.wrap([("div", "cookie-notice"), ("div", "consent"), ("div", "notice"), ("section", "alert"), ("dialog", ""), ("div", "newsletter popup"), ("aside", "notice")], f"<p>{self.text(4, 60)}</p><button>ok</button>")

    def form(self) -> str:
        inside = f"<label>{self.text(1, 4)}</label><input name=a><p>{self.text(2, 25)}</p><button>go</button>"
        return self.r.choice([f"<form>{inside}</form>", f'<div class="signup"><form action="/s">{inside}</form></div>', f'<form class="search">{self.text(1, 3)}<input></form>'])

    def sidebar(self) -> str:
        inside = "".join(self.r.choice([lambda: f"<h3>{self.text(1, 5)}</h3>", self.links, lambda: f"<p>{self.text(3, 80)}</p>", self.advert])() for _ in range(self.r.randint(1, 5)))
        return self.wrap([("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("section", "widget")], inside)

    def comments(self) -> str:
        one = lambda: self.wrap([("div", "comment"), ("li", "comment"), ("article", "comment"), ("div", "reply")], f"<p>{self.text(2, 120)}</p>")
        return self.wrap([("section", "comments"), ("div", "comments"), ("div", "discussion"), ("ol", "comment-list"), ("aside", "reader-comments")], f"<h3>{self.text(1, 4)}</h3>" * (self.r.random() < 0.5) + "".join(one() for _ in range(self.r.randint(1, 6))))

    def header(self) -> str:
        inside = self.r.choice([lambda: f"<h1>{self.text(1, 5)}</h1>", lambda: f"<p>{self.text(1, 12)}</p>", lambda: self.text(1, 20), lambda: f"<h2>{self.text(1, 5)}</h2>{self.links()}"])()
        return self.wrap([("header", ""), ("div", "header"), ("div", "masthead"), ("header", "topbar")], inside)

    def menu(self) -> str:
        return self.wrap([("nav", ""), ("nav", "menu"), ("div", "nav"), ("ul", "menu"), ("div", "breadcrumb"), ("div", "navigation")], self.links())

    def footer(self) -> str:
        inside = self.r.choice([lambda: f"&copy; site &middot; {self.text(2, 60)}", lambda: f"<p>{self.text(2, 60)}</p>{self.links()}", lambda: self.links()])()
        return self.wrap([("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright")], inside)

    def page(self) -> str:
        r, m = self.r, " data-main-text"
        title = self.text(1, 12)
        blocks = [self.main_block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20]))]
        for extra in (self.advert, self.sidebar, self.form, self.notice, lambda: self.wrap([("div", "share"), ("ul", "social")], self.links())):
            if r.random() < 0.12:
                blocks.insert(r.randrange(len(blocks) + 1), extra())
        head = f"<h1{m}>{title}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        main = self.wrap([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("section", "story"), ("div", "entry-content"), ("div", "")], head + "".join(blocks))
        if r.random() < 0.3:
            main = self.wrap([("main", ""), ("div", "main"), ("div", "container"), ("section", "")], main)
        before = [f() for f, p in ((self.header, 0.5), (self.menu, 0.8), (self.notice, 0.25), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.15)) if r.random() < p]
        after = [f() for f, p in ((self.comments, 0.35), (self.sidebar, 0.3), (self.advert, 0.25), (self.form, 0.15), (self.notice, 0.15)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join(before) + main + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        if r.random() < 0.3:
            body = f'<div id="{r.choice(["wrapper", "page", "root", "layout"])}">{body}</div>'
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t=1;</script></head><body>{body}{end}"


def write_page(seed: int) -> str:
    return _Writer(random.Random(seed)).page()


def labelled_nodes(pages: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes that hold text, and whether main text is among it."""
    rows, labels = [], []
    for html in pages:
        page = parse(html)
        main, some = np.zeros(len(page.tag), dtype=bool), np.zeros(len(page.tag), dtype=bool)
        for k, *_ in page.runs:
            some[k] = True
            main[k] |= page.marked[k]
        for k in range(len(page.tag) - 1, 0, -1):
            main[page.parent[k]] |= main[k]
            some[page.parent[k]] |= some[k]
        rows.append(node_features(page)[some])
        labels.append(main[some])
    return np.concatenate(rows), np.concatenate(labels).astype(float)


@lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 20) -> Boosted:
    return boost(*labelled_nodes([write_page(seed * 1_000_003 + k) for k in range(pages)]))


def extract_pages(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract_many(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
