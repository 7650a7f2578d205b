"""Main text of web pages by composite text density.

A node's density is its characters per tag, corrected for links by a logarithm whose base grows with the share of
linked text. Sums of the children's densities are largest at the node that holds the article. The smallest density on the
path from there to the body is the threshold for subtrees beside it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.storage import ship

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select".split())
#: Read as text up to their end tag, so that tags inside them do not count.
VERBATIM = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Parts of a page that are not its article, by tag, role or a whole class or id.
ASIDE = frozenset("nav footer aside form menu dialog button search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer footnav gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: What a form asks with, beside what is never text.
CONTROLS = frozenset("button label legend datalist output meter progress".split())
FORM = frozenset({"form"})
SECTIONS = frozenset("article main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_ENDS = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary", "figcaption"}
#: A start tag ends an open element of these, if no border lies between.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BORDERS = frozenset("table td th button object html body article section div aside nav footer header main form".split())


class Node:
    __slots__ = ("tag", "items", "parent", "aside", "chars", "tags", "link_chars", "link_tags", "density", "sum", "mark")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False):
        self.tag, self.parent, self.aside = tag, parent, aside
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.mark = ""


def aside_of(tag: str, attributes: str, in_article: bool, in_form: bool) -> str:
    """How an element is an aside: never (empty), always, or unless it holds the article ("part", "concealed", "beside")."""
    if tag in RAW or tag in CONTROLS and in_form:
        return "always"
    if tag in ("html", "body"):
        return ""
    found = {name.lower(): value.strip("\"'").lower() for name, value in reversed(ATTRIBUTE.findall(attributes))} if attributes.strip() else {}
    if tag == "dialog" or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("role") in ("dialog", "alert", "alertdialog"):
        return "concealed"
    if tag in ("nav", "footer", "aside"):
        return "beside"
    if tag in ASIDE or tag == "header" and not in_article or found.get("role") in ROLES:  # the header of an article belongs to it
        return "part"
    named = tag not in ("article", "main") and any(w in WORDS for name in ("class", "id") for w in found.get(name, "").split())
    return "part" if named else ""


def judge_asides(root: Node) -> None:
    """Makes asides of the elements that are marked as such, but for those that hold the article: main or the page's first article, or
    most of its text out of links, which is over half of it, over four fifths for what is concealed, and never enough for nav, footer and aside,
    whose text does not count. Beside a marked article or main, it takes thrice that one's text as well."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, linked, within = stack.pop()
        order.append((node, linked, within := within or bool(node.mark)))
        stack += [(x, linked or x.tag == "a", within) for x in reversed(node.items) if isinstance(x, Node) and not x.aside]
    if not any(n.mark for n, _, _ in order):
        return
    articles = [(within, n) for n, _, within in order if n.tag == "article"]
    first = next((n for within, n in articles if not within), articles[0][1] if articles else None)
    text: dict[int, int] = {}
    holds: set[int] = set()
    for node, linked, _ in reversed(order):
        text[id(node)] = sum(text[id(x)] if isinstance(x, Node) else 0 if linked else len(" ".join(x.split())) for x in node.items if not isinstance(x, Node) or not x.aside)
        if node is first or node.tag == "main" or any(id(x) in holds for x in node.items):
            holds.add(id(node))
    enough = {"part": 0.5, "concealed": 0.8, "beside": 1.0}
    inner, stack = set(), [(root, False)]
    marked = 0
    while stack:
        node, counted = stack.pop()
        if node.mark == "beside" and id(node) not in holds:
            inner.add(id(node))
        if not counted and node.tag in ("article", "main") and not node.mark:
            counted, marked = True, marked + text[id(node)]
        stack += [(x, counted) for x in node.items if isinstance(x, Node) and not x.aside and not x.mark]
    whole = text[id(root)] - sum(text[i] for i in inner)
    for node, _, _ in order:
        n = text[id(node)]
        node.aside = bool(node.mark) and id(node) not in holds and (n <= enough[node.mark] * whole or node.mark == "beside" or n < 3 * marked)


def tree(page: str) -> Node:
    """The DOM as browsers repair it, near enough: void elements, implied ends, raw text, stray end tags.

    Where the open elements of each tag stand is kept, so an end tag without its element costs nothing, and the whole is linear
    in the page however deep or broken it is.
    """
    root = Node("#root", None)
    at, n, path = 0, len(page), [root]
    places: dict[str, list[int]] = {"#block": []}

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def open_(node: Node) -> None:
        for t in (node.tag, "#block") if node.tag in BLOCK else (node.tag,):
            places.setdefault(t, []).append(len(path))
        path.append(node)

    def close(k: int) -> None:
        """End the open elements from place k on."""
        while len(path) > k:
            x = path.pop()
            places[x.tag].pop()
            if x.tag in BLOCK:
                places["#block"].pop()

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            path[-1].items.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            path[-1].items.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                path[-1].items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            held = places.get(tag)
            # An inline end tag does not end a block.
            if held and (tag in BLOCK or not places["#block"] or places["#block"][-1] < held[-1]):
                close(held[-1])
            continue
        for tags, borders in ([({"p"}, BORDERS)] if tag in P_ENDS else []) + ([SIBLINGS[tag]] if tag in SIBLINGS else []):
            if (k := last(tags)) and k > last(borders):
                close(k)
        node = Node(tag, path[-1])
        mark = aside_of(tag, m[3], last(SECTIONS) > 0, last(FORM) > 0)
        node.aside, node.mark = mark == "always", mark if mark != "always" else ""
        path[-1].items.append(node)
        if tag in VERBATIM:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                at = page.find(">", at) + 1 or n
        elif tag not in VOID and not (m[3].endswith("/") and tag in RAW):
            open_(node)
    judge_asides(root)
    return root


def measure(root: Node) -> list[Node]:
    """Counts, densities and their sums, children first; asides count as nothing."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append((node, linked))
        stack += [(x, linked or x.tag == "a") for x in node.items if isinstance(x, Node) and not x.aside]
    for node, linked in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                node.chars += n
                node.link_chars += n * linked
            elif not x.aside:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    body = next((n for n, _ in order if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node, _ in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            inner = c / max(1, lc) * t / lt
            node.density = c / t * max(0.0, math.log(inner) / math.log(base)) if base > 1 and inner > 0 else c / t
    for node, _ in order:
        node.sum = sum(x.density for x in node.items if isinstance(x, Node) and not x.aside)
    return [n for n, _ in order]


def chosen(root: Node) -> list[Node]:
    """The subtrees of the article in page order: that of the largest sum, and those beside its path that are as dense as the path."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    below = []
    stack = [body]
    while stack:
        x = stack.pop()
        below.append(x)
        stack += [y for y in x.items if isinstance(y, Node) and not y.aside]
    best = max(below, key=lambda x: x.sum)
    # Marked articles are whole, also where one of their parts is denser.
    x = best
    while x is not body and x is not None:
        if x.tag in ("article", "main"):
            best = x
        x = x.parent
    if not best.sum:
        best = body
    keep, threshold, x = {id(best)}, best.density, best
    while x is not body and x.parent is not None:
        threshold, x = min(threshold, x.parent.density), x.parent
    x = best
    while x is not body and x.parent is not None:
        beside = [y for y in x.parent.items if isinstance(y, Node) and not y.aside]
        kept = [i for i, y in enumerate(beside) if y is x or y.chars and y.density >= threshold]
        dense = set(kept)
        # Headings are short, so those between kept blocks stay whatever their density.
        keep.update(id(y) for i, y in enumerate(beside) if y is not x and (i in dense or kept[0] < i < kept[-1] and y.tag in HEADINGS))
        x = x.parent
    out, stack = [], [body]
    while stack:
        x = stack.pop()
        if id(x) in keep:
            out.append(x)
        else:
            stack += [y for y in reversed(x.items) if isinstance(y, Node) and not y.aside]
    return out


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, white space within one as one blank."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(run).split()):
            blocks.append(line)
        run.clear()

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif not x.aside:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.items)
        flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    return text_of(chosen(tree(page))) if page else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the article of each page, whole; empty for null or empty html and for pages without text.

    One row per row, repeated rows too, and no shuffle; other columns of pages are left out, whatever their names. White space is what Unicode
    takes for it, so no-break spaces and the separators U+001C to U+001F become one blank as well.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    key = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")


def op6(spark, pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html"))
