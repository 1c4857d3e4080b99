"""A page as a tree, made by one tolerant pass over its markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from .pages import VOID

#: Elements that end an open element of the same group (fixed values).
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Elements that end an open paragraph (fixed values).
BLOCKS = {"article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "ol", "pre", "section", "table", "ul"}
#: Elements whose text is no text of the page (fixed values).
UNREAD = {"script", "style", "noscript", "template"}


class Node:
    """An element; ``children`` are elements and strings in order."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, without=None) -> str:
        """The text below, without that of UNREAD and of elements for which ``without`` holds."""
        out, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n")
            elif n.tag not in UNREAD and not (without and without(n)):
                stack += reversed(n.children)
        return "".join(out)

    def up(self) -> Iterator[Node]:
        """The element and those around it, up to the body."""
        n: Node | None = self
        while n is not None and n.tag not in ("body", "html", ""):
            yield n
            n = n.parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open: list[Node] = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in CLOSES[tag]:
                    del self.open[i:]
                    break
                if self.open[i].tag in BLOCKS:
                    break
        elif tag in BLOCKS and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    if html:
        t.feed(html)
        t.close()
    return t.root
