"""Leaf blocks of an HTML page, with what the labeller reads of each.

A block is the text between two boundaries: the tags of elements that aren't
inline, or two line breaks in a row.  Markup, scripts, styles, comments and the
head's contents are no text; formulas and the fallback text of media are part of
the text around them.  Character references are decoded, white space becomes one
space, and the ends are trimmed; empty blocks vanish.

A page is read in time proportional to its length, however deep its elements
nest and whatever is left open: no tag, quote or end tag is searched for twice.
What looks like a tag but never ends is text.  Of deeply nested elements a
block's path has the ``OUTER`` outermost and the ``INNER`` innermost; all text
is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

# Element names with fixed roles in HTML.
INLINE = frozenset("a abbr acronym annotation audio b bdi bdo big canvas cite code data del dfn em embed font i img ins kbd label map mark math noembed object param picture q s samp small source span strike strong sub sup svg time track tt u var video wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title iframe svg noembed noframes datalist annotation annotation-xml".split())
RAW = frozenset("script style title iframe noembed noframes".split())
#: An opening tag ends an open element of the listed kinds, up to the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("table ul ol dl article section aside main nav header footer div form body html td th select".split())
#: Elements whose contents have names of their own, and tags that end one left open.
FOREIGN = frozenset({"math", "svg"})
BREAKOUT = frozenset("body blockquote center dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre table ul".split())
OUTER, INNER = 8, 24

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_READ = ("class", "id", "role", "itemprop", "aria-label")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # features of the elements around it, outermost first
    linked: int  # characters inside links
    mark: str | None = None  # of training pages


class _Reader:
    """Finds what markup starts with and where it ends; remembers what the rest of the page lacks."""

    def __init__(self, html: str):
        self.html, self.lacks, self.quotes = html, set(), True

    def find(self, what: str, at: int) -> int:
        """Place of ``what``, or -1; a search that fails isn't made again."""
        if what in self.lacks:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.lacks.add(what)
        return found

    def until(self, what: str, at: int) -> int:
        """Place behind ``what``, or the page's end."""
        found = self.find(what, at)
        return len(self.html) if found < 0 else found + len(what)

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, outside of quotes as long as quotes are closed; -1 if there is none."""
        if self.quotes:
            if m := _REST.match(self.html, at):
                return m.end() - 1
            self.quotes = False
        return self.find(">", at)


def _element(tag: str, attributes: str) -> tuple[str, tuple[str, ...], str | None]:
    """Name, features and training mark of an opening tag."""
    features, mark = ["t:" + tag], None
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name in _READ:
                value = (m[2] or m[3] or m[4] or "").lower()
                features += ["n:" + w for w in _NAME.findall(value) if not w.isdigit()]
            elif name == "data-mark":
                mark = m[2]
    return tag, tuple(features), mark


class _Open:
    """The open elements: a stack, and how many of each name lie above the innermost scope."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...], str | None]] = []
        self.above: list[Counter] = [Counter()]
        self.scopes: list[str] = []
        self.all: Counter = Counter()

    def push(self, element: tuple) -> None:
        self.stack.append(element)
        self.all[element[0]] += 1
        if element[0] in SCOPES:
            self.scopes.append(element[0])
            self.above.append(Counter())
        else:
            self.above[-1][element[0]] += 1

    def pop(self) -> tuple:
        element = self.stack.pop()
        self.all[element[0]] -= 1
        if element[0] in SCOPES:
            self.scopes.pop()
            self.above.pop()
        else:
            self.above[-1][element[0]] -= 1
        return element

    def ends(self, tag: str) -> bool:
        """Whether an end tag ends an open element; that of an inline element doesn't end the block around it."""
        return (self.above[-1][tag] if tag in INLINE else self.all[tag]) > 0

    def ended(self, names: set[str]) -> bool:
        """Whether one of the names is open, up to the nearest scope."""
        return any(self.above[-1][n] for n in names) or bool(self.scopes) and self.scopes[-1] in names

    def around(self) -> tuple:
        return tuple(self.stack) if len(self.stack) <= OUTER + INNER else (*self.stack[:OUTER], *self.stack[-INNER:])


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order."""
    if not html:
        return []
    out: list[Block] = []
    read, nest = _Reader(html), _Open()
    hidden = links = formulas = breaks = 0
    pieces: list[str] = []
    linked = 0
    where: tuple | None = None

    def flush() -> None:
        nonlocal linked, where, breaks
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and where is not None:
                marks = [e[2] for e in where if e[2] is not None]
                out.append(Block(text, tuple(e[1] for e in where), linked, marks[-1] if marks else None))
            pieces.clear()
        linked, where, breaks = 0, None, 0

    def say(text: str) -> None:
        nonlocal linked, where, breaks
        if hidden or not text:
            return
        if "&" in text:
            text = unescape(text)
        pieces.append(text)
        if not text.isspace():
            breaks = 0
            if where is None:
                where = nest.around()
            if links:
                linked += len(text)

    def end(names: set[str] | frozenset[str]) -> None:
        """Ends elements up to one of the names."""
        nonlocal hidden, links, formulas
        while True:
            gone = nest.pop()[0]
            hidden -= gone in HIDDEN or gone == "head"
            links -= gone == "a"
            formulas -= gone in FOREIGN
            if gone not in INLINE and not formulas:
                flush()
            if gone in names:
                return

    at = 0
    while (m := _MARKUP.search(html, at)) is not None:
        say(html[at : m.start()])
        if m[2] is None:
            opening = m[0]
            at = read.until("-->" if opening == "<!--" else "]]>" if opening == "<![CDATA[" else ">", m.end())
            continue
        close = read.tag_end(m.end())
        if close < 0:  # no tag ends any more
            at = m.start()
            break
        tag, closing, attributes, at = m[2].lower(), bool(m[1]), html[m.end() : close], close + 1
        if formulas and not closing and tag in BREAKOUT:
            while formulas:
                end(FOREIGN)
        inline = tag in INLINE or formulas > 0
        if closing:
            if nest.ends(tag):
                end({tag})
            if not inline:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            breaks += 1
            if breaks >= 2:
                flush()
            continue
        if not inline:
            flush()
            ended = CLOSES.get(tag, frozenset()) | ({"p"} if tag not in VOID or tag == "hr" else frozenset())
            while nest.ended(ended):
                end(ended)
                if tag != "tr":
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
            close = read.tag_end(stop.end()) if stop else -1
            at = close + 1 if close >= 0 else len(html)
            continue
        if not attributes.endswith("/") or tag not in HIDDEN | FOREIGN:
            nest.push(_element(tag, attributes))
            hidden += tag in HIDDEN or tag == "head"
            links += tag == "a"
            formulas += tag in FOREIGN
    say(html[at:])
    flush()
    return out
