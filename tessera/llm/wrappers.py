"""Main text of web pages by wrapper induction.

Pages of one host are dealt, by a hash, into groups of bounded size, so that a host with a third of all pages
is spread like any other. In a group, the trees of the pages are aligned with a growing template by simple
tree matching: the largest top-down alignment that keeps the order of children. Pages that align poorly with the templates there
are start another, so each layout of a host has its own. A template node is a slot: it knows in how many pages it was met, and
the different texts it had. Copies of a page, which have its longest text, count once.

A template of MANY different pages decides what is content. Prose counts once for each different text, so what is the same on all
pages weighs next to nothing. From the root of the template, the way leads down as long as one child holds more than half of the
prose, and stops where it would leave a title or a paragraph behind that differs between pages; the slot it ends in is the article's, whatever its tag or class. A page's
main text is that of the node that was aligned with it, without slots that have the same text on nearly all pages they were met in
(template inside the article, unless that would be most of it, as in near copies).

Where a layout has fewer pages, or a page has nothing at that slot, tags break the tie: the article or main element with most
prose, or else the subtree with most of it. In either case elements inside the article are left out that say themselves they are something else:
forms, menus, asides, reader comments and the like, by tag, role or class; the article's own class is never asked. Scripts,
styles and comments of the markup never become text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, stage

# Elements of HTML by their roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("head nav header footer aside form button select option input menu dialog script style noscript template svg iframe object textarea canvas audio video map title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
# Elements that the head of a page may have.
IN_HEAD = frozenset("title meta link base style script noscript template".split())
# Words in class and id names of what is not the article.
NAMES = re.compile(
    r"(^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|nav|navbar|navigation|menu|"
    r"sidebar|side|aside|rail|footer|foot|header|masthead|topbar|breadcrumbs?|comments?|commentlist|respond|replies|reply|disqus|discussion|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|widget|pagination|pager|tags|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
# Names that say what a page has or how it is laid out, and not what the element is.
STATES = re.compile(r"(?<!\S)(?:(?:no|not|has|with|without|layout)[-_]\S*|\S+[-_](?:open|closed|enabled|disabled))(?!\S)", re.I)
MAIN = re.compile(r"(^|[\s_-])(article|content|main|post|entry|story|text|body)(?=$|[\s_-])", re.I)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl div article section main body td th blockquote".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


class Node:
    __slots__ = ("tag", "names", "role", "children", "shape", "at", "prose", "up", "title")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role = tag, "", ""
        self.children: list[Node | str] = []
        self.shape, self.at, self.prose, self.up, self.title = 0, None, 0, None, False
        if attributes and ("=" in attributes or "hidden" in attributes):
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or "").strip("\"'")
                if key == "role":
                    self.role = value.lower()
                elif key in ("class", "id"):
                    self.names = f"{self.names} {value}" if self.names else value
                elif key == "hidden" or value == "true":
                    self.role = "menu"

    def furniture(self, half: float = math.inf) -> bool:
        """Whether an element says it is no article; names do not count for one with a title and more than half of the prose."""
        if self.tag in FURNITURE or self.role in ROLES:
            return True
        if not self.names or (self.title and self.prose > half):
            return False
        return bool(NAMES.search(self.names) and NAMES.search(STATES.sub(" ", self.names)))

    def kids(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(html: str) -> list[Node]:
    """The nodes of a page, parents first; missing or stray end tags are mended, inline markup is left out of the tree."""
    root = Node("html")
    stack, place, nodes = [root], 0, [root]
    links = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            if stack[-1].tag == "head":  # text ends the head
                del stack[1:]
            stack[-1].children.append(("\x01" if links else "") + unescape(piece))
        elif piece:
            stack[-1].children.append(" ")

    find = TAG.search
    while m := find(html, place):
        text(html[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = 0
            if tag in INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            links = 0
            continue
        if tag in ("html", "body") or stack[-1].tag == "head" and tag not in IN_HEAD:
            if stack[-1].tag == "head":
                del stack[1:]
            if tag in ("html", "body"):
                continue
        if tag in INLINE:
            if tag == "br":
                stack[-1].children.append(" ")
            elif tag == "a":
                links = 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, place)
            place = end.end() if end else len(html)
            continue
        closes = CLOSES.get(tag) or ({"p"} if stack[-1].tag == "p" else None)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and not (tag in ("td", "th", "tr") and stack[k].tag in ("td", "th")):
                    break
        links = 0
        node = Node(tag, m[3])
        node.up = stack[-1]
        nodes.append(node)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    text(html[place:])
    for node in reversed(nodes):  # children before their parents
        kids = node.kids()
        node.shape = hash((node.tag, *(k.shape for k in kids)))
        node.prose = 0 if node.tag in FURNITURE or node.role in ROLES else len(prose(node)) + sum(k.prose for k in kids)
        node.title = node.tag in ("h1", "h2", "article", "main") or any(k.title for k in kids)
    return nodes


def own_text(node: Node) -> str:
    return " ".join("".join(c for c in node.children if isinstance(c, str)).replace("\x01", "").split())


def prose(node: Node) -> str:
    """A node's own text outside links."""
    return "".join(c for c in node.children if isinstance(c, str) and c[0] != "\x01").strip()


def blocks(root: Node, skip: Callable[[Node], bool]) -> Iterator[tuple[str, int, Node]]:
    """(text, how much of it is links, node) for each block in page order; skip(node) leaves out a subtree."""
    held: list[str] = []
    way: list[tuple[Node, Iterator]] = [(root, iter(root.children))]
    while way:
        node, children = way[-1]
        child = next(children, None)
        if isinstance(child, str):
            held.append(child)
            continue
        if held:
            yield from finished(held, node)
            held = []
        if child is None:
            way.pop()
        elif not skip(child):
            way.append((child, iter(child.children)))


def finished(held: list[str], node: Node) -> Iterator[tuple[str, int, Node]]:
    text = " ".join("".join(held).replace("\x01", "").split())
    if text:
        yield text, sum(len(x) for x in held if x[0] == "\x01"), node


class Slot:
    """A template node: children, pages it was met in, and for hashes of the texts it had their number and length of prose."""

    __slots__ = ("tag", "children", "pages", "texts", "prose", "title")

    def __init__(self, tag: str):
        self.tag, self.children, self.pages, self.texts, self.prose, self.title = tag, [], 0, {}, 0, False

    def constant(self) -> bool:
        """Whether the text is the template's: the same in nine tenths of at least five different pages."""
        return self.pages >= 5 and max((n for n, _ in self.texts.values()), default=0) >= 0.9 * self.pages


#: Levels of a tree that are aligned; what lies deeper is content of the slot above.
DEPTH = 150
#: Elements of the article itself, one of which says that its parent is not to be left.
PARAGRAPHS = frozenset("h1 h2 h3 p pre blockquote".split())
#: Different pages that make a template.
MANY = 3


def match(a: Node, b: Slot, known: dict[tuple[int, int], int], depth: int = 0) -> int:
    """Simple tree matching: nodes in the largest alignment of two trees with equal roots."""
    if a.tag != b.tag:
        return 0
    if depth == DEPTH:
        return 1
    key = (a.shape, id(b))
    got = known.get(key)
    if got is None:
        got = known[key] = 1 + sum([n for _, _, n in aligned(a, b, known, depth)])
    return got


def aligned(a: Node, b: Slot, known: dict[tuple[int, int], int], depth: int = 0) -> list[tuple[Node, Slot, int]]:
    """Pairs of children in the best order-keeping alignment, with the size of their own alignments."""
    x, y = a.kids(), b.children
    lo, far = 0, min(len(x), len(y))
    while lo < far and x[lo].tag == y[lo].tag:  # equal tags in front and at the end align with each other
        lo += 1
    end = 0
    while end < far - lo and x[-1 - end].tag == y[-1 - end].tag:
        end += 1
    pairs = [(i, i) for i in range(lo)]
    if lo + end < far:
        pairs += [(lo + i, lo + j) for i, j in best_pairs(x[lo : len(x) - end], y[lo : len(y) - end], known, depth)]
    pairs += [(len(x) - k, len(y) - k) for k in range(end, 0, -1)]
    return [(x[i], y[j], match(x[i], y[j], known, depth + 1)) for i, j in pairs]


#: Cells of a table of sums that are held at once.
CELLS = 1 << 20


def best_pairs(x: list[Node], y: list[Slot], known: dict[tuple[int, int], int], depth: int) -> list[tuple[int, int]]:
    """Places of the pairs of an order-keeping alignment with the largest sum of their matches.

    Children of one shape share a row of matches. Sums are made row by row; where all of them are too many to hold, the upper half's sums from the front and the lower half's
    from the end say where the best alignment crosses the middle, and both halves are solved by themselves: the time goes with the product of
    both widths, in vectors, the memory with their sum.
    """
    tags = np.array([c.tag for c in y])
    rows: dict[int, np.ndarray] = {}

    def row(node: Node) -> np.ndarray:
        if node.shape not in rows:
            own = (tags == node.tag).astype(np.int32)
            if node.kids():
                for j in np.flatnonzero(own):
                    if y[j].children:
                        own[j] = match(node, y[j], known, depth + 1)
            if len(rows) >= 512:  # shapes beyond that are made anew where they come again
                rows.clear()
            rows[node.shape] = own
        return rows[node.shape]

    def sums(i: int, k: int, j: int, m: int, back: bool) -> np.ndarray:
        """Best sums of the rows i to k with the columns j to m: up to each column from the front, or from each column to the end."""
        best = np.zeros(m - j + 1, np.int32)
        for r in range(k - 1, i - 1, -1) if back else range(i, k):
            own = row(x[r])[j:m]
            if back:
                best[:-1] = np.maximum(best[:-1], best[1:] + own)
                best = np.maximum.accumulate(best[::-1])[::-1].copy()
            else:
                best[1:] = np.maximum(best[1:], best[:-1] + own)
                best = np.maximum.accumulate(best)
        return best

    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if (k - i + 1) * (m - j + 1) > CELLS and k - i > 1:
            middle = (i + k) // 2
            cut = j + int((sums(i, middle, j, m, False) + sums(middle, k, j, m, True)).argmax())
            todo += [(middle, k, cut, m), (i, middle, j, cut)]
            continue
        best = np.zeros((k - i + 1, m - j + 1), np.int32)
        for r in range(k - i - 1, -1, -1):
            best[r, :-1] = np.maximum(best[r + 1, :-1], best[r + 1, 1:] + row(x[i + r])[j:m])
            best[r] = np.maximum.accumulate(best[r, ::-1])[::-1]
        r = c = 0
        while r < k - i and c < m - j:
            if best[r, c] == best[r + 1, c]:
                r += 1
            elif best[r, c] == best[r, c + 1]:
                c += 1
            else:
                out.append((i + r, j + c))
                r, c = r + 1, c + 1
    return out


def align(page: Node, template: Slot, known: dict[tuple[int, int], int], counts: bool) -> None:
    """Give each node of a page its slot; if the page counts, its texts do, and what has no slot gets a new one."""
    todo = [(page, template, 0)]
    while todo:
        node, slot, depth = todo.pop()
        node.at = slot
        if counts:
            slot.pages += 1
            if text := own_text(node):
                n, size = slot.texts.get(h := hash(text), (0, len(prose(node))))
                slot.texts[h] = (n + 1, size)
        if depth == DEPTH:
            continue
        pairs = {id(x): y for x, y, _ in aligned(node, slot, known, depth)}
        at = 0
        for kid in node.kids():
            own = pairs.get(id(kid))
            if own is None:
                if not counts:
                    continue
                own = Slot(kid.tag)
                slot.children.insert(at, own)
            at = slot.children.index(own, at) + 1
            todo.append((kid, own, depth + 1))


def main_slot(template: Slot) -> Slot:
    """The slot that the article is in."""
    slots = [template]
    for slot in slots:  # grows while it is read: parents first
        slots.extend(slot.children)
    for slot in reversed(slots):
        own = sum(size for _, size in slot.texts.values())
        slot.prose = own + sum(c.prose for c in slot.children)
        slot.title = slot.tag in PARAGRAPHS and not slot.children and len(slot.texts) > 1
    at = template
    while True:
        best = max(at.children, key=lambda c: c.prose, default=None)
        if best is None or not best.children or 2 * best.prose <= at.prose or any(c.title for c in at.children):
            return at
        at = best


def content_root(nodes: list[Node]) -> Node:
    """Without a template: the article or main element with most prose, or the subtree with most prose for its size."""
    total = nodes[0].prose
    marked = [n for n in nodes if n.tag in ("article", "main") or n.role == "main"]
    if not marked:
        marked = [n for n in nodes if n.names and MAIN.search(n.names) and not n.furniture() and 2 * n.prose >= total]
    if marked:
        return max(marked, key=lambda n: n.prose)
    at = nodes[0]
    while True:  # from the outside in, as long as nearly all prose is inside
        kids = [k for k in at.kids() if k.prose and not k.furniture()]
        best = max(kids, key=lambda k: k.prose, default=None)
        if best is None or not best.kids() or 5 * best.prose < 4 * total or any(k.tag in PARAGRAPHS and not k.kids() for k in kids):
            return at
        at = best


def text_of(root: Node, marked: bool, template: bool) -> str:
    """The blocks of a root; marked: titles in headers, and blocks of links, are the article's; template: without constant slots."""
    half = root.prose / 2
    skip = lambda n: n.furniture(half) and not (marked and n.tag == "header" and not n.names and not n.role)
    own = [(text, node) for text, linked, node in blocks(root, skip) if marked or 2 * linked <= len(text)]
    if template:
        kept = [(text, node) for text, node in own if node.at is None or not node.at.constant()]
        if 2 * sum(len(t) for t, _ in kept) >= sum(len(t) for t, _ in own):
            own = kept
    return "\n".join(t for t, _ in own)


def extract(htmls: list[str | None], induce: bool = True) -> list[str]:
    """Main texts of some pages of one host; without induce, by tags alone."""
    pages = [parse(h or "") for h in htmls]
    layouts: list[tuple[Slot, int, list[int]]] = []  # template, nodes of its first page, pages
    known: dict[tuple[int, int], int] = {}
    seen, of = set(), {}
    for i, nodes in enumerate(pages if induce else []):
        longest = max((prose(n) for n in nodes if n.prose and not n.furniture()), key=len, default="")
        fits = [(match(nodes[0], t, known) / min(len(nodes), size), -k) for k, (t, size, _) in enumerate(layouts)]
        score, k = max(fits, default=(0, 0))
        if score < 0.6:
            k = -len(layouts)
            layouts.append((Slot("html"), len(nodes), []))
        of[i] = -k
        template, _, own = layouts[-k]
        counts = (longest, -k) not in seen  # copies say nothing about what is template
        align(nodes[0], template, known, counts)
        if counts:
            seen.add((longest, -k))
            own.append(i)
            known.clear()  # the template may have grown
    mains = [main_slot(t) if len(own) >= MANY else None for t, _, own in layouts]
    out = []
    for i, nodes in enumerate(pages):
        main = mains[of[i]] if induce else None
        root = next((n for n in nodes if n.at is main), None) if main else None
        if root is not None:
            out.append(text_of(root, True, True))
        else:
            root = content_root(nodes)
            out.append(text_of(root, root.tag in ("article", "main") or root.role == "main", main is not None))
    return out


def host(url: Column) -> Column:
    """The lower-case host of a URL without user and port; null and other texts have the host ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_texts(pages: DataFrame, group: int = 64) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html).

    Null and empty pages have an empty text. Repeated rows each give a row; pages without a host are
    aligned with each other; other columns do not matter. A host's groups hold about `group` pages, in the order of their ids, nulls
    last; a lone page is judged without a template.
    """
    of = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    sizes = of.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group)).cast("int").alias("groups"))
    large = small(stage(sizes.where("groups > 1"), "large-hosts"))
    groups = F.coalesce("groups", F.lit(1))
    of = of.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id())), groups).cast("int")).drop("groups")

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
        order = sorted(range(len(rows)), key=lambda i: tuple((x is None, "" if x is None else x) for x in rows[i]))
        table = table.take(pa.array(order, pa.int64()))
        texts = extract(table.column("html").to_pylist())
        return pa.Table.from_arrays([table.column("page_id"), table.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = f"page_id {of.schema['page_id'].dataType.simpleString()}, url string, text string"
    return of.groupBy("host", "part").applyInArrow(run, schema)
