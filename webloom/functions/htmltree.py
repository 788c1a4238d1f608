"""An HTML tree with implied end tags, after the public parsing rules, on the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open paragraph.
BLOCK = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A start tag ends these open ones, up to a boundary.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "caption", "button", "html", "body"}
INLINE = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u"}
HEAD_ONLY = {"title", "meta", "link", "style", "script", "base", "noscript"}
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def squeeze(text: str) -> str:
    """White space runs as one space, none at the ends."""
    return SPACES.sub(" ", text).strip(" ")


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        """All text below, scripts and styles too."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.body: Node | None = None
        self.open = [self.root]

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)

    def _close_paragraph(self) -> list[Node]:
        """Ends an open ``p``; gives the inline elements that go on after it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == "p":
                on = [n for n in self.open[k + 1 :] if n.tag in INLINE]
                del self.open[k:]
                return on
            if self.open[k].tag in SCOPE:
                break
        return []

    def handle_starttag(self, tag: str, attrs) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body", "head"):
            if tag == "body":
                while len(self.open) > 1 and self.open[-1].tag != "html":
                    self.open.pop()
            if not any(n.tag == tag for n in self.open):
                self._push(tag, given)
                self.body = self.open[-1] if tag == "body" else self.body
            return
        if tag not in HEAD_ONLY and any(n.tag == "head" for n in self.open):
            while self.open[-1].tag != "head":
                self.open.pop()
            self.open.pop()
        on: list[Node] = []
        if tag in BLOCK:
            on = self._close_paragraph()
        if tag in ENDS:
            ended, stop = ENDS[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ended:
                    del self.open[k:]
                    if tag != "tr":
                        break
                elif self.open[k].tag in stop:
                    break
        self._push(tag, given)
        if tag in VOID:
            self.open.pop()
            return
        if tag in ("noscript", "textarea", "title"):
            try:
                self.set_cdata_mode(tag, escapable=tag != "noscript")
            except TypeError:
                self.set_cdata_mode(tag)
        for n in on:
            self._push(n.tag, n.attrs)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._push("br", {})
                self.open.pop()
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in SCOPE and tag not in ("html", "body", "table", "tbody", "thead", "tr"):
                break
        if tag == "p":
            self._push("p", {})
            self.open.pop()

    def handle_data(self, data: str) -> None:
        tag = self.open[-1].tag
        self.open[-1].children.append(unescape(data) if tag in ("title", "textarea") and self.convert_titles else data)

    #: Whether this version's tokenizer leaves references in titles as they are.
    convert_titles = False


def parse(html: str) -> Node:
    """The document's tree; any text parses."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_Builder.convert_titles = "&" in parse("<title>&lt;</title>").text()


def title_of(root: Node) -> str:
    """The first title's text, trimmed."""
    return next((n.text().strip() for n in root.walk() if n.tag == "title"), "")
