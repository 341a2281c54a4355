"""HTML as a tree, with the standard library's parser: enough to walk elements in document order."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


class Node:
    def __init__(self, name: str):
        self.name = name
        self.children: list[Node | str] = []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self, hidden: frozenset[str] = HIDDEN):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.name not in hidden:
                yield from c.strings(hidden)

    def text(self, sep: str = " ") -> str:
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag, attrs):
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.open[0]


def title(root: Node) -> str:
    return next((n.text() for n in root.walk() if n.name == "title"), "")


def plain(html: str) -> str:
    """Text without scripts and styles, white space collapsed."""
    gone = HIDDEN | {"noscript"}
    return re.sub(r"\s+", " ", " ".join(tree(html).strings(gone))).strip()
