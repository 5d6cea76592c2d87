"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block-level tags. Each block has its number of words and link density, those of
the blocks before and after it and of its container, whether it ends as a sentence does, and what its enclosing
elements say. A decision tree, trained on the blocks of the small labelled table below, tells main text from the rest.

A map without shuffle: the labelled table is part of this module, and the tree (a few nodes) goes to the tasks with
the function. A worker holds one page's blocks at a time. Reading a page takes time in proportion to its length,
whatever its markup.

Defined cases: a null page counts as empty, and a page without main text gives an empty text; unclosed comments,
scripts and styles reach the end of the page, as does a tag that never ends; unclosed elements reach to the end of
what encloses them; an attribute whose quote is never closed, or is closed by a quote that more letters follow, ends
with the first > after it; a line break is white space inside its block; repeated rows are extracted alike; pages
of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video textarea select head title".split())
#: Elements that hold what stands around an article.
AROUND = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Elements that hold an article.
CENTRE = frozenset("article main".split())
#: Words in class, id or role that name what stands around an article.
AROUND_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
#: Words in class, id or role that name an article.
CENTRE_WORDS = frozenset("article body content entry main post story text".split())

#: Elements that end an open one of the same name before them, unless a container stands between.
FOLLOWS = frozenset("p li dt dd tr td th option".split())
#: Those containers.
CONTAINER = frozenset("ul ol dl table div section article main nav aside form body".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe template".split())

OPENS = re.compile(r"<(?:!|\?|/?[a-zA-Z])")
#: A whole tag whose attributes are plain; everything else is read attribute by attribute.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>=/]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+)\s*+/?+>""")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
BETWEEN = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*+(\s*+=\s*+)?+")
UNQUOTED = re.compile(r"[^\s>]*+")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Words that begin the name of a state, which names nothing itself.
STATES = frozenset("has have is no not with without".split())
HIDES = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def named(names: str) -> Iterator[str]:
    """What class, id or role names say: of each name the first and the last word, as the kind of thing stands at
    either end of a compound (ad-slot, main-nav); names of states say nothing."""
    for name in names.split():
        found = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if found and found[0] not in STATES:
            yield found[0]
            yield found[-1]


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    inner: int  # the number of the nearest element that may stand around an article, -1 for none
    centre: int
    named_centre: int
    heading: int
    container: int  # the number of the nearest container
    around: int = 0  # whether an enclosing element stands around an article
    named_around: int = 0  # whether a class, id or role says so


class Surroundings:
    """The elements whose tag or name says that they stand around an article, each with the next such one outside.

    One that holds more than half of the page's plain words, and the article's mark (an element or name for articles, or
    a first heading), is a frame of the page whatever it is called; so is one that holds them where no such mark is."""

    def __init__(self):
        self.parent: list[int] = []
        self.tagged: list[int] = []
        self.named: list[int] = []
        self.centre: list[bool] = []
        self.any_centre = False

    def add(self, parent: int, tagged: bool, named: bool) -> int:
        self.parent.append(parent)
        self.tagged.append(int(tagged))
        self.named.append(int(named))
        self.centre.append(False)
        return len(self.parent) - 1

    def mark(self, inner: int) -> None:
        """An article's mark inside of an element."""
        self.any_centre = True
        if inner >= 0:
            self.centre[inner] = True

    def tell(self, found: list[Block]) -> None:
        """Sets the blocks' marks of what stands around them; one pass in, one pass out."""
        plain = [0] * len(self.parent)
        for b in found:
            if b.inner >= 0:
                plain[b.inner] += b.words - min(b.linked, b.words)
        total = sum(b.words - min(b.linked, b.words) for b in found)
        for i in range(len(self.parent) - 1, -1, -1):
            if (up := self.parent[i]) >= 0:
                plain[up] += plain[i]
                self.centre[up] = self.centre[up] or self.centre[i]
        tagged, named = list(self.tagged), list(self.named)
        for i, up in enumerate(self.parent):
            if 2 * plain[i] > total and (self.centre[i] or not self.any_centre):
                tagged[i] = named[i] = 0
            if up >= 0:
                tagged[i] |= tagged[up]
                named[i] |= named[up]
        for b in found:
            if b.inner >= 0:
                b.around, b.named_around = tagged[b.inner], named[b.inner]


class Page:
    """Reads tags one after the other; remembers what does not occur again, so that no search is repeated in vain."""

    def __init__(self, page: str):
        self.page, self.n, self.last = page, len(page), {}

    def find(self, what: str, at: int) -> int:
        """Where something is found from a place on, -1 if nowhere."""
        if what not in self.last:
            self.last[what] = self.page.rfind(what)
        return self.page.find(what, at) if at <= self.last[what] else -1

    def skip(self, what: str, at: int) -> int:
        i = self.find(what, at)
        return self.n if i < 0 else i + len(what)

    def tag(self, at: int) -> tuple[str, str, str, int]:
        """(/ or nothing, name, attributes, place after it) of the tag that begins at a place."""
        if m := TAG.match(self.page, at):
            return m[1], m[2], m[3], m.end()
        m = TAG_NAME.match(self.page, at)
        begin = i = m.end()
        while True:
            i = BETWEEN.match(self.page, i).end()
            if i >= self.n:
                return m[1], m[2], "", self.n  # it never ends
            if self.page[i] == ">":
                return m[1], m[2], self.page[begin:i], i + 1
            a = ATTRIBUTE.match(self.page, i)
            i = a.end()
            if a[1] is None or i >= self.n:
                continue
            if (quote := self.page[i]) in "\"'":
                close = self.find(quote, i + 1)
                if close >= 0 and (close + 1 == self.n or self.page[close + 1] in " \t\n\r\f/>"):
                    i = close + 1
                    continue
                end = self.skip(">", i)
                return m[1], m[2], self.page[begin : end - 1], end
            i = UNQUOTED.match(self.page, i).end()


class Open:
    """The open elements; a search by name goes to the last of that name at once."""

    def __init__(self):
        self.stack: list[tuple] = []  # tag; marks: inner, centre, named centre, hidden; container
        self.by: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def last(self, tag: str) -> int:
        return self.by[tag][-1] if self.by.get(tag) else -1

    def push(self, tag: str, marks: tuple, container: int) -> None:
        self.by.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINER:
            self.containers.append(len(self.stack))
        self.stack.append((tag, marks, container))

    def cut(self, i: int) -> None:
        for tag, _, _ in self.stack[i:]:
            self.by[tag].pop()
            if tag in CONTAINER:
                self.containers.pop()
        del self.stack[i:]

    @property
    def marks(self) -> tuple:
        return self.stack[-1][1] if self.stack else (-1, 0, 0, 0)

    @property
    def container(self) -> int:
        return self.stack[-1][2] if self.stack else 0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    reader, open_, beside = Page(page), Open(), Surroundings()
    parts: list[str] = []
    links: list[str] = []
    link, heading, containers, at, n = -1, 0, 0, 0, len(page)  # link: open elements when the link began

    def close():
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(text.split()), len(html.unescape("".join(links)).split()), *open_.marks[:3], heading, open_.container))
            parts, links = [], []

    def say(text: str):
        if text and not open_.marks[3]:
            parts.append(text)
            if link >= 0:
                links.append(text)

    while at < n:
        m = OPENS.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        if m[0][1] in "!?":
            at = reader.skip("-->", m.start() + 4) if page.startswith("<!--", m.start()) else reader.skip(">", m.start())
            continue
        ends, tag, rest, at = reader.tag(m.start())
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                say(" ")
            elif tag == "a":
                link = -1 if ends else len(open_.stack)
                if links:
                    links.append(" ")
            continue
        close()
        if ends:
            if (i := open_.last(tag)) >= 0:
                open_.cut(i)
                link = -1 if len(open_.stack) < link else link
            heading = 0
            continue
        heading = int(len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in FOLLOWS and (i := open_.last(tag)) > (open_.containers[-1] if open_.containers else -1):
            open_.cut(i)
            link = -1 if len(open_.stack) < link else link
        own = set()
        if rest:
            for _, x, y, z in NAMES.findall(rest):
                own.update(named(x or y or z))
        inner, above = open_.marks[0], open_.marks
        tagged, called = tag in AROUND, bool(own & AROUND_WORDS) and tag not in ("html", "body", "article", "main")
        if tag in CENTRE or own & CENTRE_WORDS or tag == "h1":
            beside.mark(inner)
        if tagged or called:
            inner = beside.add(inner, tagged, called)
        hidden = int(tag in HIDDEN or bool(rest and HIDES.search(rest)))
        marks = (inner, above[1] | (tag in CENTRE), above[2] | int(bool(own & CENTRE_WORDS)), above[3] | hidden)
        if tag in CONTAINER:
            containers += 1
        open_.push(tag, marks, containers if tag in CONTAINER else open_.container)
    close()
    beside.tell(out)
    return out


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "plain_near", "plain_here", "density_here", "sentence", "heading", "around", "named_around", "centre", "named_centre", "outside"]
#: What a sentence ends with.
STOPS = (".", "!", "?", "\u2026", ":", ";", "\u3002", "\uff01", "\uff1f", '."', ".\u201d", ".)", "\u00bb")
MANY = 30  # words of a block, beyond which more words tell nothing
LEAST = 2  # blocks of the table on either side of a split
NEAR = 3  # blocks on either side among which the longest without links is looked for


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of each block, of those beside it and of its container, and marks of what encloses it."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in found], np.float64)
    linked = np.minimum([b.linked for b in found], words)
    x[:, 0], x[:, 1] = np.minimum(words, MANY), linked / words
    x[1:, 2:4] = x[:-1, :2]
    x[:-1, 4:6] = x[1:, :2]
    plain = words - linked
    for d in range(1, NEAR + 1):
        x[d:, 6] = np.maximum(x[d:, 6], plain[:-d])
        x[:-d, 6] = np.maximum(x[:-d, 6], plain[d:])
    _, here = np.unique([b.container for b in found], return_inverse=True)
    all_words, all_linked = np.bincount(here, words), np.bincount(here, linked)
    x[:, 6] = np.minimum(x[:, 6], MANY)
    x[:, 7], x[:, 8] = np.minimum(all_words - all_linked, 2 * MANY)[here], (all_linked / all_words)[here]
    x[:, 9] = [b.text.endswith(STOPS) for b in found]
    x[:, 10:15] = [(b.heading, b.around, b.named_around, b.centre, b.named_centre) for b in found]
    inside = (x[:, 13] > 0) | (x[:, 14] > 0)
    x[:, 15] = inside.any() & ~inside  # beside an article
    return x


#: The labelled table: pages whose texts begin with + (main text) or - (the rest). W12 stands for 12 words, S12 for a
#: sentence of 12 words.
LABELLED = [
    # articles with what stands around them, by element and by name
    "<nav><ul><li><a>-W1</a><li><a>-W1</a><li><a>-W2</a></ul></nav><div class=ad>-S9</div><article><h1>+W8</h1><p>+S60<p>+W1<p>+S25</article><footer>-W12</footer>",
    "<header><h1>-W4</h1><a>-W2</a></header><main><h2>+W6</h2><p>+S90<p>+W3<p>+S40 <a>+W2</a></main><aside><h3>-W3</h3><p>-S30<p><a>-W8</a></aside><footer><p>-S40</footer>",
    "<div id=menu><a>-W1</a><a>-W1</a></div><div class=content><h1>+W7</h1><p>+S50<p>+W2<p>+S80</div><div class=sidebar><p>-S25<p><a>-W5</a></div><div id=footer><p>-S20</div>",
    "<article><h1>+W5</h1><p>+S30<div class=share><a>-W1</a><a>-W1</a></div><p>+W2<div class=advert><p>-S20</div><p>+S45<section class=comments><h3>-W2</h3><p>-S30<p>-S50</section></article>",
    "<div class=cookie><p>-S25<button>-W1</button></div><article><h1>+W9</h1><p>+S4<p>+W1<p>+S2</article><form><p>-S8<label>-W2</label></form><footer>-W6</footer>",
    "<article><p>+W1</article>",
    "<article><header><p>-W5</header><h1>+W3</h1><ul><li>+W5<li>+S12<li><a>+W2</a></ul><blockquote>+S20</blockquote><p>+W3<aside>-S40</aside><footer>-W15</footer></article>",
    "<main><div class=notice><p>-S30</div><p>+S12<table><tr><td>+W1<td>+W2</table><p>+S25<div id=comments><p>-S80<p>-W2</div></main><nav><a>-W2</a></nav>",
    "<article><p><a>+W4</a><p>+S20<p><a>+W6</a></article><div><p>-S40</div><div>-W6</div>",
    "<article><p><a>+W1</a><p>+W2<p><a>+W1</a><ul><li><a>+W1</a><li><a>+W15</a></ul></article><footer>-W3</footer>",
    "<article><p>+S12<p><a>+W20</a><p>+W3</article>",
    "<article><p>+S12<p><a>+W20</a><p>+S30</article>",
    "<div>-S60</div><article><h2>+W5</h2><p>+S35</article><div>-S80</div><p>-W5",
    "<article><h1>+W12</h1><p>+S7<p>+S150<p>+S3<p>+W1<p>+S1<p>+S200</article><div>-S15</div><footer>-S9</footer>",
    "<div>-S12</div><article><p>+W4<p>+S8</article><div>-S30</div>",
    "<article><h1>+W2</h1><p>+W1<p><a>+W1</a><p>+S30<p>+W2<p><a>+W5</a><p>+S12<p>+W2<p><a>+W1</a></article>",
    "<article><p>+S60<p><a>+W5</a><p>+S80<p><a>+W2</a><p>+S30<p>+W2<p><a>+W9</a></article>",
    "<main><h1>+W5</h1><p><a>+W3</a><p>+S120<p><a>+W1</a><p>+S9<p><a>+W14</a><p>+S70</main><div>-S40</div>",
    "<article><p>+S90<h2><a>+W4</a></h2><p>+S75<h2><a>+W6</a></h2><p>+S55<p><a>+W2</a></article>",
    "<article><h1>+W2</h1><p>+W20 <a>+W9</a> +S12<p>+W15 <a>+W12</a> +S9<p>+W40 <a>+W30</a> +S6<p>+W3 <a>+W4</a> +S2<p><a>+W20</a> +S30</article>",
    "<div><h1>+W2</h1><p>+W30 <a>+W9</a> +S12<p>+W25 <a>+W12</a> +S9<p>+W40 <a>+W20</a> +S6<p>+W3 <a>+W2</a> +S2</div><div><a>-W3</a></div>",
    "<article><h1>+W3</h1><p>+S4<p>+S2</article><div>-W8</div>",
    "<article><p>+W2<p>+W2</article>",
    "<main><h1>+W1</h1><ul><li>+W1<li>+W1<li>+W2</ul></main><footer>-W9</footer>",
    "<article><p><a>+W2</a></article><div>-S20</div>",
    "<article><h1>+W6</h1><p>+W2<p><a>+W3</a></article>",
    "<article><table><tr><td>+W1<td>+W1<tr><td>+W2<td>+W1</table><p>+S14</article>",
    "<main><p>+S20<p>+W1<p><a>+W12</a><p>+W1</main>",
    # menus inside articles, told by links beside links
    "<article><h1>+W6</h1><p>+S40<p>+S70<p>+S30<ul><li><a>-W3</a><li><a>-W2</a><li><a>-W4</a><li><a>-W2</a></ul></article>",
    "<article><ul><li><a>-W2</a><li><a>-W1</a><li><a>-W3</a><li><a>-W2</a></ul><h1>+W7</h1><p>+S55<h2>+W3</h2><p>+S80<p>+S20</article>",
    "<main><h1>+W5</h1><p>+S90<div><a>-W1</a></div><div><a>-W1</a></div><div><a>-W2</a></div><p>+S60<p>+S5</main>",
    "<article><p>+S40<ul><li>+W6<li>+W4<li>+W9<li>+S14</ul><p>+S30<ol><li>+S5<li>+S8</ol></article>",
    "<article><h1>+W4</h1><p>+S50<ul><li><a>-W1</a><li><a>-W2</a><li><a>-W1</a></ul><p>+S55<p>+S20</article>",
    "<main><p>+S30<ul><li><a>-W2</a><li><a>-W1</a><li><a>-W3</a><li><a>-W1</a></ul><p>+S70<p>+S35</main>",
    # articles of one link
    "<article><p><a>+W1</a></article>",
    "<article><a>+W2</a></article>",
    "<main><p><a>+W3</a></main>",
    # sources inside articles: links of many words after the text
    "<article><h1>+W5</h1><p>+S60<p>+S45<h2>+W1</h2><ul><li><a>+W9</a><li><a>+W12</a><li><a>+W7</a></ul></article><div><a>-W2</a></div>",
    "<main><p>+S80<p>+S30<ol><li><a>+W14</a><li><a>+W8</a><li><a>+W6</a><li><a>+W11</a></ol></main><footer>-W9</footer>",
    "<article><p>+S25<p>+S50<ul><li><a>+W10</a><li><a>+W6</a></ul><ul><li><a>-W1</a><li><a>-W2</a><li><a>-W1</a></ul></article>",
    # pages without any hint but their text: long blocks with few links, and what stands between them
    "<body><p>+S70<p>+S45<p>+S9<p>+S33</body>",
    "<p><a>-W2</a><p><a>-W3</a><p><a>-W1</a><p>+S60<p>+S80<p>+S5<p>+S30<p><a>-W2</a><p><a>-W4</a><p><a>-W5</a>",
    "<div><a>-W3</a></div><div><p>+S55</div><div><p>+S30</div><div><a>-W6</a></div><div>-W3</div>",
    "<div><a>-W9</a> <a>-W12</a></div><div><a>-W14</a></div><p>+S40<p>+S8<p>+S22<div><a>-W10</a><a>-W11</a></div><div>-W2</div>",
    "<ul><li><a>-W8</a><li><a>-W16</a><li><a>-W20</a></ul><h1>+W9</h1><div>+S30 <a>+W2</a></div><div>+S18</div><ul><li><a>-W7</a><li><a>-W12</a></ul>",
    "<table><tr><td><a>-W25</a><td><a>-W30</a></table><p>+S15<p>+S12<p>+S28<table><tr><td><a>-W18</a><td>-W1</table>",
    "<div><a>-W3</a> -W1</div><h2>+W4</h2><p>+S65<p>+S50<h2>+W3</h2><p>+S44<div><a>-W2</a> -W1 <a>-W3</a></div>",
    "<div><h1>+W1</h1><p>+S2<p>+S12</div>",
    "<div><h1>+W4</h1><p>+S3<p>+S25<p>+S6</div><div><a>-W2</a><a>-W2</a></div>",
    "<div><ul><li><a>-W1</a><li><a>-W1</a><li><a>-W2</a></ul></div><div><h1>+W5</h1><p>+S4<p>+S40<p>+S2<h2>+W2</h2><p>+S30</div><div>-W4</div>",
    "<div><a>-W1</a></div><div><a>-W2</a></div><div><h2>+W6</h2>+S120</div><div>-W5 <a>-W2</a></div>",
    "<div><h1>+W3</h1><p>+S18<p>+S9 <a>+W3</a><p>+S20<ul><li>+W5<li>+S7<li>+W3</ul><p>+S16</div><div><ul><li><a>-W2</a><li><a>-W3</a></ul></div>",
    "<p>+S25",
    "+S13",
    "<h1>+W4</h1><p>+S3<p>+S30<p>+S11",
    "<div><div><a>-W1</a> <a>-W1</a> <a>-W1</a></div><div><h1>+W6</h1><div>+S35</div><div>+S4</div><div>+S50</div></div><div><a>-W4</a> -W2 <a>-W3</a></div></div>",
    "<table><tr><td><a>-W2</a><td><a>-W1</a><td><a>-W2</a></table><table><tr><td><h1>+W5</h1><p>+S45<p>+S6<p>+S70</table><table><tr><td>-W6<td><a>-W1</a></table>",
    "<div><a>-W2</a></div><div><a>-W1</a></div><div><a>-W2</a></div><div>-W3</div>",
    "<ul><li><a>-W4</a><li><a>-W6</a><li><a>-W3</a></ul>",
    "<div><p>+S30<p>+S22<p>+W4<p>+S31</div><div><a>-W2</a> <a>-W2</a> <a>-W2</a> -W2</div><div>-W6</div>",
]


@dataclass
class Node:
    """A split (feature, threshold) with what lies below and above, or a leaf's answer."""

    feature: int = -1
    threshold: float = 0.0
    below: Node | None = None
    above: Node | None = None
    answer: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by Gini impurity; thresholds stand midway between values."""
    node = Node(answer=bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, None, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, j] <= t
            if min(low.sum(), (~low).sum()) < LEAST:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = low.mean() * 2 * p * (1 - p) + (1 - low.mean()) * 2 * q * (1 - q)
            if impurity < best[0]:
                best = (impurity, j, t)
    if best[1] is None:
        return node
    low = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def _filled(m: re.Match) -> str:
    return " ".join([m[1] + "w"] + ["w"] * (int(m[3]) - 1)) + ("." if m[2] == "S" else "")


def train(labelled: list[str] | None = None) -> Node:
    """The tree of a labelled table in the form of ``LABELLED``."""
    xs, ys = [], []
    for page in labelled or LABELLED:
        found = blocks(re.sub(r"([+-])([WS])(\d+)", _filled, page))
        if any(b.text[0] not in "+-" for b in found):
            raise ValueError(f"a block without a label: {page}")
        xs.append(features(found))
        ys += [b.text.startswith("+") for b in found]
    return grow(np.concatenate(xs), np.array(ys, np.float64))


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.feature < 0:
            out[rows] = node.answer
        elif len(rows):
            low = x[rows, node.feature] <= node.threshold
            todo += [(node.below, rows[low]), (node.above, rows[~low])]
    return out


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    keep = classify(tree, features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(p, tree) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
