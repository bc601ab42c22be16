"""Main text of HTML pages by line-block distribution.

1. The page becomes lines: the text of every block element, with white space turned into one space and character
   references decoded. Comments, scripts, styles and forms are left out, and so are containers that a page marks as something else
   than its article: navigation, headers and footers outside the article, asides, dialogs, and elements
   whose class, id or role names a menu, sidebar, notice, advert, share bar or reader comments. A name that only mentions such a word
   (as ``has-sidebar`` or ``share-price``) may be that of a wrapper: the element stays if it holds the page's only content
   containers, or ``WRAPS`` times the text that stands outside all elements named so. Inside an article names decide little: headings, paragraphs, items and cells stay whatever
   they are called; a division called an advert, a notice to sign up or reader comments goes, one called anything else only if half of
   its text or more is in links.
2. The text lengths of the lines are summed over a sliding window. The distribution surges where the main text starts
   and dives where it ends; the stretches between a surge and its dive are the article's core. Text in links weighs nothing, and
   a line counts at most LINE_CAP characters here, so that one very long line doesn't hide the others.
3. The core picks the containers that hold it: the innermost content container (article, main or the like) around all core lines that
   stand in one, or each outermost one where they have none in common; on pages whose core mostly stands outside such containers also
   the innermost division around all of it or else around each stretch, if it holds little else, or else the innermost with nearly
   all of the stretch. All lines of these containers stay, short ones too, and so does every line of the core.

Pages are independent rows: nothing is shuffled, a task holds one Arrow batch.

Results for odd rows: a null or empty page and a page without text outside boilerplate have the empty text; very long
pages are read whole; unclosed or stray tags end with their parent; repeated rows repeat; an empty table gives an empty result; other columns
than the key and address are dropped.
"""

from __future__ import annotations

import heapq
import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import table, tune

#: Lines whose text is summed around each line, and the share of the largest sum that a surge needs.
WINDOW, SURGE = 3, 0.2
#: Characters of a line that count towards a surge, and the share of a division's text that the core needs.
LINE_CAP, PURE = 240, 0.8
#: Text inside a wrapper for each character outside.
WRAPS = 4
#: A tag ends before the next "<" outside its quoted values, so that a broken one costs no more than its own length.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?][^<>]*>", re.S)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "noframes", "xmp")}
BLOCKS = frozenset("xmp address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select dialog menu head script style".split())
CONTENT = frozenset(["article", "main"])
DIVISIONS = frozenset(["div", "section", "td"])
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
NOISE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar aside ad ads advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay share sharing social comment comments disqus respond reply replies related recommended footer header masthead newsletter subscribe signup login pagination pager widget toolbar skip copyright disclaimer alert".split())
#: Words in front of which a noise word says something else, as in "article-header".
OWN = frozenset("article post entry content story main".split())
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?:[-_]?(?:body|content|text))?(?:$|\s)|main[-_]?(?:content|text)|content[-_]?main|articleBody", re.I)
#: Words that leave a noise word's name what it is, as in "comments-area" or "left-sidebar".
PLAIN = frozenset("area list section box container block wrap wrapper inner outer item items bar left right top bottom site main global user reader primary secondary mobile desktop sticky fixed small big new inline links link nav text icon icons button buttons form count title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where an unclosed item stops looking for the element it closes.
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}


#: Names that stand for the same inside an article, for its divisions; and those that do for all its elements but headings.
UNWANTED = frozenset("comment comments commentlist disqus respond reply replies cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion".split())
BOXES = frozenset("div section ul ol dl table center details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)} if "=" in raw or raw.strip() else {}


def is_noise(tag: str, attrs: dict[str, str], in_content: bool) -> int:
    """Whether the page marks this element as something else than its article: 2 yes, 1 if only its name mentions such a thing, 0 no."""
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in NOISE_ROLES:
        return 2
    if tag == "header":
        return 0 if in_content else 2
    if tag in ("body", "html", "article", "main") or not ("class" in attrs or "id" in attrs):
        return 2 if "display:none" in attrs.get("style", "").replace(" ", "") else 0
    found = 0
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w.lower() for w in WORDS.findall(name)]
        if NOISE.intersection(words) and not (words[0] in OWN and words[-1] in ("header", "content")):
            level = 2 if NOISE.union(PLAIN).issuperset(words) else 1
            if in_content:
                # Inside an article a name counts for divisions, and that of an advert for paragraphs and items too.
                sure = level == 2 and (tag in BOXES and UNWANTED.intersection(words) or tag not in HEADINGS and ADVERTS.intersection(words))
                sure = sure or tag in BOXES and words[0] in ADVERTS and len(words) == 2  # as in "ad-slot"
                level = 2 if sure else 1 if tag in BOXES else 0
            found = max(found, level)
    return found


def lines(page: str) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """(text, characters that weigh, numbers of the innermost content container and of the innermost division around it, 0
    for none) of each block outside boilerplate; and by a container's number that of the next one of its kind around it.
    Containers are numbered from outside in."""
    out: list[tuple[str, int, int, int, int, int]] = []
    parents = [0]
    #: By a doubtful element's number: the doubtful one around it, whether a content container lies in it, and whether it lies in one.
    doubts, holding, inside = [0], [False], [False]
    stack: list[tuple[str, bool, list[int] | None]] = []  # tag, noise, where it is noted
    count: dict[str, int] = {}
    endless: set[str] = set()
    parts: list[str] = []
    state = {"noise": 0, "links": 0, "free": 0, "outside": False}
    content: list[int] = []
    divisions: list[int] = []
    doubtful: list[int] = []
    at = 0

    def text(raw: str) -> None:
        if raw and not state["noise"]:
            plain = references.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if not state["links"]:
                state["free"] += len(plain)

    def flush() -> None:
        line = " ".join("".join(parts).split())
        if line:
            # Links weigh nothing but inside an article.
            out.append((line, len(line) if content else min(state["free"], len(line)), min(state["free"], len(line)), content[-1] if content else 0, divisions[-1] if divisions else 0, doubtful[-1] if doubtful else 0))
        parts.clear()
        state["free"] = 0

    def pop() -> None:
        tag, noise, holds = stack.pop()
        count[tag] -= 1
        state["noise"] -= noise
        state["links"] -= tag == "a"
        if holds is doubtful:
            flush()
        if holds is not None:
            holds.pop()

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(references.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1] and tag in RAW and not m[3].rstrip().endswith("/"):
            end = None if tag in endless else RAW[tag].search(page, at)
            if tag == "xmp":
                flush()
                text(references.escape(page[at : end.start() if end else len(page)]))
                flush()
                at = end.end() if end else len(page)
                continue
            if not end:
                endless.add(tag)
            at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br":
            text(" ")
        if m[1]:
            if count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in CLOSES or tag in BLOCKS and any(t == "p" for t, _, _ in stack[-3:]):
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
            for k in range(len(stack) - 1, -1, -1) if any(count.get(t) for t in ends) else ():
                t = stack[k][0]
                if t in ends:
                    while len(stack) > k:
                        pop()
                    break
                if t in SCOPES.get(tag, ()) or t in BLOCKS and t not in ("p",) and tag not in SCOPES:
                    break
        attrs = attributes(m[3])
        noise = 0 if state["noise"] else is_noise(tag, attrs, bool(content))
        holds = tag in CONTENT or attrs.get("role", "").lower() in ("main", "article") or tag in ("div", "section", "td") and bool(CONTENT_NAME.search(attrs.get("class", "")) or CONTENT_NAME.search(attrs.get("id", "")) or attrs.get("itemprop") == "articleBody")
        if noise == 1:
            # A doubtful element is no division, so that its text can be told apart.
            flush()
            doubts.append(doubtful[-1] if doubtful else 0)
            holding.append(False)
            inside.append(bool(content))
            doubtful.append(len(doubts) - 1)
            noted = doubtful
        else:
            noted = content if holds else divisions if tag in DIVISIONS else None
        if holds and not noise and not state["noise"]:
            if doubtful and not content:
                holding[doubtful[-1]] = True
            elif not doubtful:
                state["outside"] = True
        stack.append((tag, noise == 2, noted))
        count[tag] = count.get(tag, 0) + 1
        state["noise"] += noise == 2
        state["links"] += tag == "a"
        if noted is not None and noted is not doubtful:
            parents.append(noted[-1] if noted else 0)
            noted.append(len(parents) - 1)
    text(page[at:])
    flush()
    return told(out, doubts, holding, inside, state["outside"]), parents


def told(found: list[tuple], doubts: list[int], holding: list[bool], inside: list[bool], outside: bool) -> list[tuple[str, int, int, int]]:
    """The lines without those in doubtful elements that are no wrappers and, inside an article, mostly links."""
    if len(doubts) == 1:
        return [(*row[:2], *row[3:5]) for row in found]
    weights, sizes, frees, free = [0] * len(doubts), [0] * len(doubts), [0] * len(doubts), 0
    for row in found:
        weights[row[5]] += row[1]
        sizes[row[5]] += len(row[0])
        frees[row[5]] += row[2]
        free += 0 if row[5] else row[1]
    holds = list(holding)
    for i in range(len(doubts) - 1, 0, -1):
        if doubts[i]:
            for sums in (weights, sizes, frees):
                sums[doubts[i]] += sums[i]
            holds[doubts[i]] |= holds[i]
    kept = [True]
    for i in range(1, len(doubts)):
        own = 2 * frees[i] > sizes[i] if inside[i] else holds[i] and not outside or weights[i] >= WRAPS * max(free, 1)
        kept.append(kept[doubts[i]] and own)
    return [(*row[:2], *row[3:5]) for row in found if kept[row[5]]]


def stretches(sizes: list[int]) -> list[tuple[int, int]]:
    """All stretches of lines between a surge and a dive of the windowed lengths."""
    capped = [min(x, LINE_CAP) for x in sizes]
    sums = [sum(capped[i : i + WINDOW]) for i in range(len(sizes))]
    least = SURGE * max(sums)
    out, i = [], 0
    while i < len(sizes):
        if sums[i] < least or not sizes[i]:
            i += 1
            continue
        j = i
        # The dive: from here on a whole window has next to no text.
        while j < len(sizes) and sums[j] >= least:
            j += 1
        j = min(len(sizes), j + WINDOW - 1) if j == len(sizes) else j
        while j > i + 1 and not sizes[j - 1]:
            j -= 1
        out.append((i, j))
        i = j + 1
    return out


def core(sizes: list[int]) -> tuple[int, int]:
    """The heaviest stretch."""
    return max(stretches(sizes), key=lambda x: sum(sizes[x[0] : x[1]]), default=(0, len(sizes)))


def common(numbers: set[int], parents: list[int]) -> int:
    """The innermost container around all of these, 0 for none."""
    heap = [-n for n in numbers]
    heapq.heapify(heap)
    while heap:
        last = -heapq.heappop(heap)
        while heap and heap[0] == -last:
            heapq.heappop(heap)
        if not heap:
            return last
        heapq.heappush(heap, -parents[last])
    return 0


def within(holders: set[int], parents: list[int]) -> list[bool]:
    """By a container's number: whether it is one of the holders or lies in one."""
    out = [False] * len(parents)
    for i in range(1, len(parents)):
        out[i] = i in holders or out[parents[i]]
    return out


def pure(rows: list[tuple], found: list[tuple], parents: list[int]) -> int:
    """The innermost division around all of these lines, if it holds little else; else 0."""
    inner = common({row[3] for row in rows}, parents)
    inside = within({inner}, parents)
    return inner if sum(len(row[0]) for row in rows) >= PURE * sum(len(row[0]) for row in found if inside[row[3]]) else 0


def most(rows: list[tuple], parents: list[int]) -> int:
    """The innermost division with nearly all of these lines' text, 0 for none."""
    weights = [0] * len(parents)
    for row in rows:
        weights[row[3]] += row[1]
    least = 0.8 * sum(weights)
    for i in range(len(parents) - 1, 0, -1):
        if weights[i] >= least:
            return i
        weights[parents[i]] += weights[i]
    return 0


def main_text(page: str | None) -> str:
    found, parents = lines(page or "")
    if not found:
        return ""
    sizes = [row[1] for row in found]
    if not any(sizes):
        return "\n".join(row[0] for row in found if row[2])
    whole = stretches(sizes)
    # Lines in front of a stretch that are mostly links, as of a menu, are no reason to leave a container.
    cuts = [(next((i for i in range(a, b) if 2 * sizes[i] >= len(found[i][0])), a), b) for a, b in whole]
    parts = [found[a:b] for a, b in cuts]
    rows = [row for part in parts for row in part]
    marked = {row[2] for row in rows if row[2]}
    if inner := common(marked, parents):
        content = {inner}
    else:
        roots = [*range(len(parents))]
        for i in range(1, len(parents)):
            roots[i] = roots[parents[i]] or i
        content = {roots[i] for i in marked}
    divisions: set[int] = set()
    if sum(row[1] for row in rows if row[2]) < 0.5 * sum(row[1] for row in rows):
        inner = pure(rows, found, parents)
        divisions = {inner} if inner else {pure(part, found, parents) or most(part, parents) for part in parts}
    in_content, in_divisions = within(content, parents), within(divisions, parents)
    kept = {i for a, b in (cuts if any(content | divisions) else whole) for i in range(a, b)}
    return "\n".join(row[0] for i, row in enumerate(found) if i in kept or in_content[row[2]] or in_divisions[row[3]])


def extract(pages: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url_col)}
    return pages.select(key, url_col, html_col).mapInArrow(emit, f"{key} {kinds[key]}, {url_col} {kinds[url_col]}, text string, n_chars long")


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_line_blocks": op9_line_blocks}
SQL: dict[str, str] = {}
