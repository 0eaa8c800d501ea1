"""Web pages as trees: block elements and the stretches of text between their tags, in page order.

Inline elements are no nodes of their own; what stands in a link is counted. End tags that authors leave out are implied
for paragraphs, list items, table cells and the like. Scripts, styles and comments leave nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of HTML: elements without content, with text that is no markup, inside a line, and what ends a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An element of the first kind ends an open one of the second, unless one of the third stands between them.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ())}
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.I | re.S)
_ATTR = re.compile(r"""(?<![-\w])(class|id|role|itemprop|hidden|style|aria-hidden)(?![-\w])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {name: re.compile(f"</{name}(?![a-z0-9])", re.I) for name in RAW}
TEXT = "#text"


@dataclass
class Page:
    """Nodes in page order; node 0 is the page itself. A node's parent stands before it."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    marks: list[str] = field(default_factory=lambda: [""])  # class, id and the like
    text: list[str] = field(default_factory=lambda: [""])  # of stretches of text
    linked: list[int] = field(default_factory=lambda: [0])  # characters inside links
    noted: set[int] = field(default_factory=set)  # nodes with the attribute that ``parse`` was asked to note

    def add(self, parent: int, tag: str, marks: str = "", text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.marks.append(marks)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def _marks(attributes: str) -> str:
    found = []
    for name, *values in _ATTR.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.append("hidden")
        elif name != "style":
            found.append(value)
    return unescape(" ".join(found))


def parse(html: str | None, note: str | None = None) -> Page:
    """Null and empty pages have the page's node alone."""
    page, html = Page(), html or ""
    open_nodes, names, count = [0], [""], {}  # names and counts of the open elements
    pieces: list[str] = []
    linked, link_at = 0, 0  # characters in links so far, and where a link opened: 0 for none

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(open_nodes[-1], TEXT, text=text, linked=min(linked, len(text)))
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal link_at
        flush()
        for name in names[to:]:
            count[name] -= 1
        del open_nodes[to:], names[to:]
        if link_at > to:
            link_at = 0

    def innermost(wanted: tuple[str, ...], barrier: tuple[str, ...]) -> int:
        if any(count.get(w) for w in wanted):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in wanted:
                    return k
                if names[k] in barrier:
                    break
        return 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            piece = m[0]
            if piece == "<" or piece[0] != "<":
                piece = unescape(piece) if "&" in piece else piece
                pieces.append(piece)
                if link_at:
                    linked += len(" ".join(piece.split()))
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "a":
                link_at = 0
            elif name not in INLINE and name not in ("html", "body") and count.get(name):
                close(innermost((name,), ()))
            elif name in ("p", "html", "body"):
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            found = _RAW_END[name].search(html, at)
            at = found.start() if found else end
            continue
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                link_at = len(names)
            continue
        if name in ENDS_P and count.get("p"):
            close(innermost(("p",), ("button", "table", "td", "th")) or len(names))
        if name in IMPLIED:
            while k := innermost(*IMPLIED[name]):
                close(k)
        elif name in _HEADS and names[-1] in _HEADS:
            close(len(names) - 1)
        flush()
        if name in ("html", "body") and count.get(name) or name in VOID:
            continue
        open_nodes.append(page.add(open_nodes[-1], name, _marks(attributes) if attributes.strip() else ""))
        if note and note in attributes:
            page.noted.add(open_nodes[-1])
        names.append(name)
        count[name] = count.get(name, 0) + 1
    flush()
    return page
