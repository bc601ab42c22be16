"""A supplied book page prepared for reading: scripts, styles and event attributes go, headings go one level down, landmarks get their attributes, and
what a reader needs is put beside them. The page is read as a tree, so quoting and broken markup make no difference."""

from __future__ import annotations

import html
from collections.abc import Callable

from scriptorium.functions.tree import EMPTY, Node, parse

# Landmarks of a book page by class or id, the attributes that they get, and what is put beside them. Places: in front of an element,
# behind it, or as its first child.
ATTRIBUTES = [
    ("main.reader", {"id": "main-content", "data-pagefind-body": "", "data-pagefind-meta": "type:电子书", "data-pagefind-filter": "type:电子书"}),
    (".sidebar", {"data-pagefind-ignore": "", "id": "book-toc"}), (".mobile-bar", {"data-pagefind-ignore": ""}), (".progress", {"data-pagefind-ignore": ""}), (".chapter-nav", {"data-pagefind-ignore": ""}), ("dialog", {"data-pagefind-ignore": ""}),
    (".sidebar>nav", {"aria-label": "全书章节"}), ("#menuToggle", {"aria-controls": "book-toc", "aria-expanded": "false"}), ("#searchOpen", {"aria-haspopup": "dialog", "aria-controls": "searchDialog"}), ("#mobileSearch", {"aria-haspopup": "dialog", "aria-controls": "searchDialog"}),
    ("#searchInput", {"aria-describedby": "searchStatus"}), ("#searchStatus", {"role": "status", "aria-live": "polite"}), (".book-front h1", {"data-pagefind-meta": "title"}),
]
PIECES = [
    ("#searchDialog", "first", '<h2 class="reader-sr-only" id="searchLabel">搜索全书</h2>'), (".search-head", "first", '<label class="reader-sr-only" for="searchInput">搜索问题、回答或主题</label>'),
    (".sidebar-brand", "before", '<div class="reader-sidebar-top"><a class="reader-home" href="/">← 影像目录</a></div>'), (".sidebar-actions", "after", '<a class="reader-resume" hidden href="#chapter-01">继续上次阅读</a>'),
    (".book-meta", "after", '<div class="reader-front-actions" data-pagefind-ignore><a class="reader-start" href="#chapter-01">开始阅读第一章</a></div>'), ("body", "first", '<a class="reader-skip" href="#main-content">跳到正文</a>'),
]
COLON, SUBTITLE = "：", "reader-book-subtitle"


def matcher(selector: str) -> Callable[[Node], bool]:
    """A test for ``tag.class``, ``.class``, ``#id`` or a tag, also below (space) or right below (>) another one."""
    for sign, up in (((">"), False), ((" "), True)):
        if sign in selector:
            outer, inner = (matcher(s) for s in selector.split(sign, 1))

            def both(n: Node) -> bool:
                p = n.parent
                while up and p is not None and not outer(p):
                    p = p.parent
                return inner(n) and p is not None and outer(p)

            return both
    tag, dot, name = selector.partition(".")
    if selector.startswith("#"):
        return lambda n: n.attributes.get("id") == selector[1:]
    return lambda n: (not tag or n.tag == tag) and (not dot or n.has(name))


def written(nodes: list[Node | str]) -> str:
    """The nodes as markup again."""
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(html.escape(n, quote=False))
        else:
            out.append(f"<{n.tag}{''.join(f' {k}="{html.escape(v)}"' for k, v in n.attributes.items())}>")
            if n.tag not in EMPTY:
                stack += [(f"</{n.tag}>",), *reversed(n.children)]
    return "".join(out)


def put(node: Node, place: str, piece: str) -> None:
    made = parse(piece).children
    for m in made:
        if isinstance(m, Node):
            m.parent = node if place == "first" else node.parent
    siblings = node.children if place == "first" or node.parent is None else node.parent.children
    at = 0 if place == "first" else siblings.index(node) + (place == "after")
    siblings[at:at] = made


def prepared(page: str | None) -> tuple[str, str, str, str]:
    """(markup of the body, styles, title, subtitle)."""
    root = parse(page or "")
    css = "\n".join("".join(c for c in n.children if isinstance(c, str)) for n in root.walk() if n.tag == "style").replace(".chapter-header h1", ".chapter-header h2")
    for n in [root, *root.walk()]:
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in ("script", "style")]
        n.attributes = {k: v for k, v in n.attributes.items() if not k.startswith("on")}
    nodes = list(root.walk())
    for selector, values in ATTRIBUTES:
        test = matcher(selector)
        for n in nodes:
            if test(n):
                n.attributes |= values
    title = subtitle = ""
    front, chapter = matcher(".book-front h1"), matcher(".chapter-header h1")
    for n in nodes:
        if front(n) and not title:
            title, colon, subtitle = n.text().partition(COLON)
            if colon:
                title += colon
                n.children = [Node("span", {}, n), Node("span", {"class": SUBTITLE}, n)]
                n.children[0].children, n.children[1].children = [title], [subtitle]
    for n in [n for n in nodes if chapter(n)]:
        n.tag = "h2"
    for selector, place, piece in PIECES:
        test = matcher(selector)
        for n in nodes:
            if test(n):
                put(n, place, piece)
    body = next((n for n in nodes if n.tag == "body"), root)
    return written(body.children), css, title, subtitle
