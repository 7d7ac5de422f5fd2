"""A page as a list of structural nodes with features, and text blocks with their owners."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

#: Element classes of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rb rt rp nobr wbr br img map area input picture source".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object select option textarea audio video canvas title".split())
#: Tags that may stand in a head; any other one, or text, ends it (fixed values).
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: An opening tag of the key closes an open element of the value, up to the nearest of _SCOPES.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table div article section main body html td th blockquote form aside nav header footer".split())
#: Kinds of tags and of attribute tokens that are features (fixed values).
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "button", "details", "dialog", "address"]
TOKENS = {
    "content": "content article post entry story text body main prose copy richtext page hentry articlebody",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip topbar links sitemap",
    "head": "header masthead logo brand top hero banner site",
    "foot": "footer foot copyright bottom colophon legal disclaimer imprint",
    "side": "sidebar side aside widget rail related recommended recommendations popular trending latest more tags archive categories secondary teaser",
    "notice": "cookie cookies consent gdpr notice alert message popup modal overlay dialog toast announcement warning subscribe newsletter signup paywall banner",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion promoted dfp adslot adbox",
    "form": "form search login register input contact field feedback survey",
    "comment": "comment comments commentlist reply replies respond discussion disqus review reviews responses thread reader",
    "share": "share sharing social follow facebook twitter like buttons toolbar",
    "byline": "byline author meta date published info bio credit",
}
_KIND = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_GAP = re.compile(r"\s+")
_ENDS = re.compile("[.!?,;:]")


class Page(HTMLParser):
    """Nodes: 0 is the root. Blocks: (owner, text) in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parent, self.depth, self.kinds = ["#root"], [-1], [0], [[0] * len(TOKENS)]
        self.counts = [[0, 0, 0, 0]]  # characters, linked characters, sentence marks, words
        self.at, self.children, self.start = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = [("#root", 0)]
        self._text: list[str] = []
        self._linked = self._unseen = self._seen_chars = 0
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = _GAP.sub(" ", "".join(self._text)).strip()
            self._text.clear()
            if text:
                self.blocks.append((self._open[-1][1], text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop()
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                self._text.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag not in INLINE:
            if any(t == "p" for t, _ in self._open) and tag not in UNSEEN:
                self._close_to({"p"})
            if tag in CLOSES:
                self._close_to(CLOSES[tag])
            if tag not in UNSEEN:
                self._flush()
        node = self._open[-1][1]
        if tag not in INLINE and tag not in UNSEEN:
            parent = node
            node = len(self.tags)
            self.tags.append(tag)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            kinds = [0] * len(TOKENS)
            for name, value in attrs:
                if value and name in ("class", "id", "role", "itemprop", "aria-label", "data-testid"):
                    for word in _SPLIT.split(value):
                        k = _KIND.get(word.lower())
                        if k is not None:
                            kinds[k] = 1
            self.kinds.append(kinds)
            self.counts.append([0, 0, 0, 0])
            self.at.append(self.children[parent])
            self.children[parent] += 1
            self.children.append(0)
            self.start.append(self._seen_chars)
        self._linked += tag == "a"
        self._unseen += tag in UNSEEN
        self._open.append((tag, node))

    def _pop(self) -> None:
        tag, _ = self._open[-1]
        if tag not in INLINE and tag not in UNSEEN:
            self._flush()
        self._open.pop()
        self._linked -= tag == "a"
        self._unseen -= tag in UNSEEN

    def _close_to(self, names: set[str]) -> None:
        """Closes the nearest open element of these names, unless another scope stands between."""
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i][0]
            if tag in names:
                while len(self._open) > i:
                    self._pop()
                return
            if tag in _SCOPES:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if tag in INLINE and self._open[i][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        n = len(data.strip())
        if n and self._open[-1][0] == "head":
            self._pop()
        if self._unseen:
            return
        self._text.append(data)
        if n:
            c = self.counts[self._open[-1][1]]
            c[0] += n
            c[1] += n if self._linked else 0
            c[2] += len(_ENDS.findall(data))
            c[3] += len(data.split())
            self._seen_chars += n


FEATURES = 3 * len(TOKENS) + 2 * len(TAGS) + 22


def features(page: Page) -> np.ndarray:
    """One row of features a node."""
    n = len(page.tags)
    parent = np.array(page.parent)
    own = np.array(page.counts, float)
    total = np.column_stack((own, np.ones(n), np.array([t == "p" for t in page.tags], float), np.array([t == "li" for t in page.tags], float)))
    kinds = np.array(page.kinds, float)
    above = np.zeros_like(kinds)
    tag = np.zeros((n, len(TAGS)))
    for i, t in enumerate(page.tags):
        if t in _TAG_AT:
            tag[i, _TAG_AT[t]] = 1
    above_tag = np.zeros_like(tag)
    below = kinds.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        below[parent[i]] = np.maximum(below[parent[i]], below[i])
    for i in range(1, n):
        above[i] = np.maximum(above[parent[i]], kinds[parent[i]])
        above_tag[i] = np.maximum(above_tag[parent[i]], tag[parent[i]])
    up = np.maximum(parent, 0)
    chars, linked, marks, words, nodes, paras, items = total.T
    siblings = np.array(page.children, float)[up]
    one = np.maximum(chars, 1)
    place = np.array(page.at, float)
    whole = max(chars[0], 1)
    rows = [
        np.log1p(chars), linked / one, marks / np.maximum(words, 1), np.log1p(words / nodes), np.log1p(nodes), chars / whole, paras / nodes, items / nodes,
        np.log1p(own[:, 0]), own[:, 1] / np.maximum(own[:, 0], 1), np.array(page.depth, float), place, siblings, place / np.maximum(siblings, 1),
        np.array(page.start, float) / whole, (np.array(page.start) + chars) / whole, np.log1p(chars[up]), linked[up] / one[up], chars / one[up],
        np.array(page.children, float), paras[up] / nodes[up], chars / np.maximum(words, 1),
    ]
    return np.column_stack((kinds, above, below, tag, above_tag, *rows))


_TAG_AT = {t: i for i, t in enumerate(TAGS)} | {"th": TAGS.index("td"), "tr": TAGS.index("td"), "tbody": TAGS.index("table"), "h4": TAGS.index("h3"), "h5": TAGS.index("h3"), "h6": TAGS.index("h3"), "dl": TAGS.index("ul"), "dd": TAGS.index("li"), "dt": TAGS.index("li"), "figcaption": TAGS.index("figure"), "menu": TAGS.index("nav"), "fieldset": TAGS.index("form"), "summary": TAGS.index("details")}


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The likeliest labels under which nothing is kept below a node that is not: one pass up, one down."""
    n = len(page.tags)
    keep, drop = log_odds.astype(float).copy(), np.zeros(n)
    # Against 0 for every dropped node, a kept node scores its log odds and the best of each child.
    for i in range(n - 1, 0, -1):
        keep[page.parent[i]] += max(keep[i], drop[i])
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[page.parent[i]] and keep[i] > 0
    return out


def main_text(page: Page, kept: np.ndarray) -> str:
    return "\n".join(text for owner, text in page.blocks if kept[owner])
