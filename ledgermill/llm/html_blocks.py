"""Flat text blocks of a web page and a decision tree that tells article blocks.

A page is cut at block-level tags; scripts, styles, choices of forms and
markup comments are no text. Every block has its number of words, its share of
words in links, whether it lies in an article and whether in a part that is
none by its tag, role or class. The tree sees these of the block and the first
two of its neighbours.

Some tags and roles are never part of an article. Words in a class or id are
only hints, as a page's wrapper or the article itself may carry them
(``comments-open``, ``tag-login``), and so is a form, which may wrap a page.
A hint is held against the rest of the page: of articles those with the fewest
hints around them count, and where a page has no article element, hints that
lie around nearly all of its words are ignored.

A page is read once from left to right, and its open elements are found by
their tag, so time grows with its length whatever the nesting. A quote that
swallows markup counts as a plain character.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np

# Fixed values ---------------------------------------------------------------
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "canvas", "select")
INLINE = frozenset(
    "math mi mo mn ms mtext mrow msup msub mfrac msqrt object "
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
#: Parts that are no article by their tag or role.
OTHER_TAGS = frozenset("nav footer aside button dialog menu fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Hints: tags, and words of a class or id.
HINT_TAGS = frozenset(["form", "header"])
HINT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer ad ads advert advertisement advertising adsense sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share "
    "sharing social related recommended comment comments reply replies disqus respond widget pagination pager copyright "
    "login form skip toolbar tooltip header masthead topbar banner sidebar side rail alert".split()
)
#: Hints around so large a share of a page's words say nothing.
WRAPPED = 0.9
# ----------------------------------------------------------------------------

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_LETTERS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: bool
    other: bool
    heading: bool


@dataclass
class _Open:
    """An element that is not closed yet, with what holds inside it."""

    tag: str
    article: bool = False
    never: bool = False  # by a tag, a role or being hidden
    around: int = 0  # hints on and around the nearest article, or around all if there is none
    inside: int = 0  # hints since the nearest article
    heading: bool = False


class _Ends:
    """Finds where tags end; what is not there once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def _find(self, mark: str, at: int) -> int:
        if self.none.get(mark, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.none[mark] = min(at, self.none.get(mark, at))
        return found

    def of_tag(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, or -1."""
        while True:
            mark = _MARK.search(self.page, at)
            if not mark or self._find(">", at) < 0:
                return -1
            if mark.group() == ">":
                return mark.start()
            close = self._find(mark.group(), mark.end())
            if close >= 0:
                end = self.page.find(">", mark.end(), close)
                if end >= 0 and self.page.find("<", mark.end(), end) < 0 <= self.page.find("<", end, close):
                    close = -1  # markup between the quotes
            at = close + 1 if close >= 0 else mark.end()


def _element(tag: str, attributes: str, parent: _Open) -> _Open:
    names, role, gone = set(), "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names.update(value.split())
        elif name == "role":
            role = value
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            gone = True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            gone = True
    page = tag in ("html", "body")
    never = parent.never or not page and (gone or tag in OTHER_TAGS or role in OTHER_ROLES)
    # a whole name says more than a word of one
    hint = 0 if page else 2 if names & HINT_WORDS else int(any(HINT_WORDS.intersection(_LETTERS.findall(n)) for n in names))
    if tag in HINT_TAGS and not (tag == "header" and parent.article):
        hint += 1
    heading = parent.heading or tag in HEADINGS
    article = tag in ARTICLE or role in ("main", "article")
    if article and not (parent.article and (hint or parent.inside)):
        # a hint on the article itself is one more around it
        around = parent.around + parent.inside + hint
        return _Open(tag, True, never, around, 0, heading)
    if parent.article:
        return _Open(tag, True, never, parent.around, parent.inside + hint, heading)
    return _Open(tag, False, never, parent.around + hint, 0, heading)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; unclosed parts end with the page."""
    found: list[tuple[str, int, float, _Open]] = []
    stack, places, link = [_Open("")], {}, False
    parts: list[tuple[str, bool]] = []
    ends = _Ends(page)

    def end() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(html.unescape(p).split()) for p, in_link in parts if in_link)
            words = len(text.split())
            found.append((text, words, min(1.0, linked / words), stack[-1]))
        parts.clear()

    def pop() -> None:
        places[stack.pop().tag].pop()

    at = 0
    while at < len(page):
        start = page.find("<", at)
        start = len(page) if start < 0 else start
        if start > at:
            parts.append((page[at:start], link))
        if start == len(page):
            break
        name = _NAME.match(page, start)
        if not name:
            other = _OTHER.match(page, start)
            if not other:
                parts.append(("<", link))
            at = other.end() if other else start + 1
            continue
        stop = ends.of_tag(name.end())
        if stop < 0:
            break  # cut off inside a tag
        tag, closing, attributes, at = name.group(2).lower(), bool(name.group(1)), page[name.end() : stop], stop + 1
        empty = attributes.endswith("/")
        if tag in RAW:
            if not closing and not empty:
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag == "br":
            parts.append((" ", False))
        elif tag == "a":
            link = not closing
        elif tag not in INLINE:
            end()
            if closing:
                if places.get(tag):
                    depth = places[tag][-1]
                    while len(stack) > depth:
                        pop()
            elif tag not in VOID and not empty:
                # the end tag of a paragraph or an item may be left out
                if tag in ("p", "li") and stack[-1].tag == tag:
                    pop()
                places.setdefault(tag, []).append(len(stack))
                stack.append(_element(tag, attributes, stack[-1]))
    end()
    return _judged(found)


def _judged(found: list[tuple[str, int, float, _Open]]) -> list[Block]:
    """Blocks with their flags, hints held against those of the rest of the page."""
    inside = [e.around for _, _, _, e in found if e.article and not e.never and not e.inside]
    fewest = min(inside, default=None)
    # how many hints lie around nearly all words of a page without an article
    loose = sorted((e.around, words) for _, words, _, e in found if not e.never)
    left, usual = (1 - WRAPPED) * sum(w for _, w in loose), 0
    for hints, words in loose:
        left -= words
        if left < 0:
            usual = hints
            break
    out = []
    for text, words, links, e in found:
        article = e.article and not e.never and not e.inside and e.around == fewest
        if fewest is None:
            other = e.never or bool(e.inside) or e.around > usual
        else:
            other = e.never or bool(e.inside) or (e.around > fewest if e.article else e.around > 0)
        out.append(Block(text, words, links, article or e.article and not other, other, e.heading))
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row per block: own flags, words and links, and those of its neighbours.

    The fourth flag tells a block outside an article on a page that has one.
    """
    if not found:
        return np.zeros((0, 10))
    own = np.array([[b.words, b.links] for b in found], float)
    edge = np.zeros((1, 2))
    has_article = any(b.article and not b.other for b in found)
    flags = np.array([[b.article, b.other, b.heading, has_article and not b.article] for b in found], float)
    return np.hstack([flags, own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])


# Labelled pages: the table below has the label of each block, 1 for the article.
_P = "<p>" + "The council said on Monday that the bridge would stay open for all traffic until the work is done, and more. " * 2 + "</p>"
_S = "<p>It stays open.</p>"
_W = "<p>Yes.</p>"
_MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
_FOOT = "<footer>&copy; 2024 The Daily. All rights reserved to the publisher and others.</footer>"
LABELLED = (
    (_MENU + "<article><h1>Bridge stays open</h1>" + _P + _S + _P + "</article>" + _FOOT, "0011110"),
    (_MENU + "<div class=ad>Buy two for one now and save a lot on all of our new shoes this week.</div><main><h1>Open</h1>" + _W + _P + _S + "</main>" + _FOOT, "00011110"),
    ("<header><div>The Daily</div></header><article>" + _P + _W + _P + "<div class=share><a href=/f>Share this</a></div></article><aside><p>Most read today: ten ways to save on heating and three more things to know about it.</p></aside>", "01110" + "0"),
    ("<article>" + _P + _P + "<ul><li>first point of the plan</li><li><a href=/x>second point with link</a></li></ul></article><section class=comments><p>" + "I think this is a good plan and it was about time that they did it. " * 3 + "</p></section>", "11110"),
    # pages without an article element
    ("<div><a href=/1>Home</a> <a href=/2>Sport</a></div><div><h1>Bridge stays open</h1></div><div>" + _P + _P + _S + _P + "</div><div><a href=/3>Older</a></div><div>Imprint</div>", "01111100"),
    ("<p><a href=/1>One</a></p><p><a href=/2>Two</a></p>" + _P + _P + "<p>Read more</p><p><a href=/4>Next story here</a></p>", "001100"),
    ("<div class=cookie><p>We use cookies to make this site better for you. By staying you accept that.</p></div>" + _P + _W + _P + _FOOT, "01110"),
    (_MENU + _P + "<form><p>Enter your mail address and get the news of the day each morning for free.</p></form>" + _P + _P, "001011"),
    ("<div>Menu</div><div><a href=/a>All topics of the week</a></div><p>Short</p>", "000"),
    (_P, "1"),
    ("<h1>Title of it</h1>" + _P, "11"),
    (_MENU + "<article>" + _W + "</article>" + _FOOT, "0010"),
    (_MENU + "<article><p><a href=/s>The whole paragraph is one long link to the source of the story.</a></p></article>" + _FOOT, "0010"),
    (_MENU + "<article><h1>Open</h1>" + _P + _W, "00111"),
    ("<article>" + _W + _S + _P + _P, "1111"),
    (_P + "<article>" + _P + _S + "</article>" + _P, "0110"),
    ("<div>" + _P + _S + "</div><main>" + _P + "<p><a href=/q>Quoted</a> by all of them that day.</p></main><div>" + _P + "</div>", "00110"),
    ("<article>" + _W + "</article>" + _S, "10"),
    ("<div>" + _P + "</div><div>" + _P + _S + "</div>", "111"),
    # hints on wrappers, on the article itself and on parts of it
    ("<form>" + _MENU + "<div><h1>Title of it</h1>" + _P + _S + _P + "</div><div class=comments>" + _S + _P + "</div>" + _FOOT + "</form>", "001111000"),
    ("<div class='content share-enabled'>" + _P + _W + _P + "<div class=share><a href=/f>Share this</a></div></div>", "1110"),
    ("<article class='post tag-login'>" + _P + _S + "</article><article class=comment>" + _P + "</article>", "110"),
    ("<div class=comments-open><article>" + _P + "<div class=related>" + _S + "</div>" + _S + "</article><div class=comments-area><article>" + _P + "</article></div></div>", "1010"),
    ("<div>Daily</div>" + "<article>" + _P + "</article>" + "<p>Terms and conditions apply to each and every use of this page as they are set out there.</p>", "010"),
)


@dataclass
class Tree:
    """A binary decision tree: inner nodes ask whether a feature is at most a cut."""

    label: bool
    place: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def tell(self, rows: np.ndarray) -> np.ndarray:
        if self.place < 0:
            return np.full(len(rows), self.label)
        out = np.empty(len(rows), bool)
        low = rows[:, self.place] <= self.cut
        out[low] = self.low.tell(rows[low])
        out[~low] = self.high.tell(rows[~low])
        return out


def _impurity(y: np.ndarray) -> float:
    share = y.mean() if len(y) else 0.0
    return len(y) * share * (1 - share)


def train(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Tree:
    """The cut with the least Gini impurity at each node, until its rows agree."""
    node = Tree(bool(y.mean() >= 0.5))
    best = None
    for place in range(x.shape[1]) if depth and 0 < y.sum() < len(y) else ():
        values = np.unique(x[:, place])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, place] <= cut
            cost = _impurity(y[low]) + _impurity(y[~low])
            if best is None or cost < best[0] - 1e-9:
                best = (cost, place, cut)
    if best is None or best[0] >= _impurity(y) - 1e-9:
        return node
    low = x[:, best[1]] <= best[2]
    node.place, node.cut = best[1], float(best[2])
    node.low, node.high = train(x[low], y[low], depth - 1), train(x[~low], y[~low], depth - 1)
    return node


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of all labelled pages."""
    x, y = [], []
    for page, labels in LABELLED:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {[b.text[:30] for b in found]}")
        x.append(features(found))
        y += [c == "1" for c in labels]
    return np.vstack(x), np.array(y)
