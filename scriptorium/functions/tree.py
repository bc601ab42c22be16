"""A small element tree of a page that may be broken: unclosed and stray tags, attributes in any quoting. No recursion, so nesting has no limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Fixed values of the format: elements without content, those that hold no text to read, and those that end a paragraph.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the page's order."""
        stack = list(reversed([c for c in self.children if isinstance(c, Node)]))
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed([c for c in node.children if isinstance(c, Node)]))

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def above(self, tag: str) -> Node | None:
        node = self
        while node is not None and node.tag != tag:
            node = node.parent
        return node

    def has(self, name: str) -> bool:
        return name in (self.attributes.get("class") or "").split()

    def before(self) -> Node | None:
        """The element before this one under the same parent."""
        last = None
        for c in self.parent.children if self.parent else ():
            if c is self:
                return last
            last = c if isinstance(c, Node) else last
        return None

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append("\n")
            elif c.tag not in SILENT:
                stack.extend(reversed(c.children))
        return "".join(out)


class Builder(HTMLParser):
    """Builds the tree: an end tag closes what is open inside its element, and one that matches nothing is passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.open: dict[str, int] = {}

    def _close(self, tag: str) -> None:
        while self.at.tag != tag:
            self._up()
        self._up()

    def _up(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent or self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and self.open.get("p"):
            self._close("p")
        for other in SIBLINGS.get(tag, ()):
            if self.at.tag == other:
                self._up()
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        node = Node(tag, given, self.at)
        self.at.children.append(node)
        if tag not in EMPTY:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag not in SILENT:
            self._up()

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str) -> Node:
    builder = Builder()
    builder.feed(page)
    builder.close()
    return builder.root
