"""Main text of web pages by tree scoring.

Each paragraph-like block passes points (one, one for each comma, one for each
hundred characters up to three) in full to its parent, half to the
grandparent and a third to the ancestor above.  A container's points are
discounted by its link density.  The container with the most points is kept,
with those of its siblings that score well or read like running text.

Elements that never hold the article are left out before scoring: scripts,
styles, forms, menus, asides, page headers and footers, hidden elements, and
elements whose class, id or role names such a part (adverts, sidebars,
cookie notices, comments).

Defined results: a null or empty page has the empty text, as has a page
without any block outside those parts; broken and unclosed tags are closed as
their parents close; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp svg template".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option menu dialog object audio video canvas map fieldset label input".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body blockquote center dd details div html li main section td th tr tbody table ul ol dl figure header".split())
#: What an open element of the key closes when it starts.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Words of class names and ids that name what is no part of a text: all of the
#: element goes unless it holds half of the page's running text.
FOREIGN = re.compile(
    r"ads?|advert\w*|adsbygoogle|adslot|banners?|breadcrumbs?|comments?|commentlist|commenters?|consent|cookies?|disqus|discussions?|gdpr|masthead|menus?|modal|nav|navbar|navigation"
    r"|newsletters?|notices?|outbrain|pager|pagination|popup|promo\w*|related|remarks?|replies|respond|shoutbox|sidebars?|signup|sponsor\w*|subscribe|subscription|taboola|toolbar|widgets?",
    re.I,
)
#: Two words that do so together, and words that do so outside articles.
FOREIGN_PAIRS = re.compile(r"(?:site|page|article|post)[_-]footer|author[_-](?:box|bio|card)|about[_-]author|sign[_-]up|reader[_-]\w*mail", re.I)
FOREIGN_OUTSIDE = re.compile(r"header|footer|byline|skip", re.I)
#: Words that may do so: the element goes if none of its blocks is running text.
DOUBTFUL = re.compile(r"shar(?:e|es|ing)|social|authors?|footer|skip|follow|tools?", re.I)
#: Running text has so many characters at least, and few of them in links.
RUNNING = 50
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNLIKELY_ROLES = frozenset("navigation banner complementary contentinfo search menu menubar alert alertdialog dialog".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w-])", re.S)
SPACE = re.compile(r"\s+")
COMMAS = re.compile(r"[,،﹐﹑⹁⸲，、]")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "suspect", "doubtful", "box", "order", "score", "length", "linked", "kept")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, order: int = 0):
        self.tag, self.parent, self.dropped, self.order = tag, parent, dropped, order
        self.children: list[Node | str] = []
        #: The nearest element of an unlikely name, itself or above.
        self.suspect: Node | None = parent.suspect if parent else None
        self.doubtful = False
        #: The nearest container above.
        self.box: Node | None = parent and (parent if parent.tag in CONTAINERS else parent.box)
        self.score, self.length, self.linked = 0.0, 0, 0
        self.kept: bool | None = None


def _unlikely(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in UNLIKELY_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


#: Names that say what a layout has or lacks do not name the part itself.
STATES = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[_-]\S*", re.I)


def _doubt(tag: str, attributes: str, inside_article: bool) -> int:
    """What the names of an element say: 2 that it is foreign, 1 that it may be, 0 nothing."""
    if not attributes or tag in ("html", "body", "article", "main") or inside_article and tag in HEADINGS:
        return 0
    doubt = 0
    for name, a, b, c, _ in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            value = STATES.sub(" ", a or b or c)
            words = re.split(r"[\s_-]+", value)
            if FOREIGN_PAIRS.search(value) or any(FOREIGN.fullmatch(w) or not inside_article and FOREIGN_OUTSIDE.fullmatch(w) for w in words):
                return 2
            doubt = doubt or int(any(DOUBTFUL.fullmatch(w) for w in words))
    return doubt


class _Open:
    """The stack of open elements, with the places of each tag and of blocks in it."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.articles = 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.articles += node.tag in ("article", "main")
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
            self.articles -= node.tag in ("article", "main")

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        """An end tag; an inline one does not close the block around it."""
        at = self.last(tag)
        if at and not (tag in INLINE and self.blocks and self.blocks[-1] > at):
            self.cut(at)

    def start(self, tag: str) -> None:
        """Closes what a start tag closes."""
        p = self.last("p")
        if tag in BLOCKS and p and self.blocks[-1] == p:
            self.cut(p)
        for other in CLOSES.get(tag, ()):
            at = self.last(other)
            if at and at > max(map(self.last, ("ul", "ol", "dl", "table"))):
                self.cut(at)


def tree(page: str) -> Node:
    root = Node("html", None)
    at, count = 0, 0
    opened = _Open(root)
    suspects: list[Node] = []
    while at < len(page):
        node = opened.stack[-1]
        m = TOKEN.search(page, at)
        if not m:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<":
            node.children.append("<")
        elif m[1]:
            tag = m[1].lower()
            if tag == "br":
                node.children.append(" ")
            elif tag not in VOID:
                opened.end(tag)
        elif m[2]:
            tag, attributes = m[2].lower(), m[3] or ""
            if tag in ("br", "hr", "img", "wbr"):
                node.children.append("" if tag == "wbr" else " ")
                if tag == "hr":
                    node.children.append(Node("hr", node))
                continue
            if tag in VOID or tag in ("html", "body"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            opened.start(tag)
            parent = opened.stack[-1]
            count += 1
            node = Node(tag, parent, _unlikely(tag, attributes, opened.articles > 0), count)
            doubt = 0 if node.dropped else _doubt(tag, attributes, opened.articles > 0)
            if doubt:
                node.suspect, node.doubtful = node, doubt == 1
                suspects.append(node)
            parent.children.append(node)
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                opened.push(node)
    _drop_suspects(root, suspects)
    return root


def points_of(text: str) -> float:
    return 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)


def _drop_suspects(root: Node, suspects: list[Node]) -> None:
    """Drops elements of foreign names, unless they hold an article or main
    element or at least half of the page's points of paragraphs with few links;
    of doubtful names, only if none of their blocks is running text."""
    if not suspects:
        return
    points, whole, holds, running = {id(n): 0.0 for n in suspects}, 0.0, set(), set()
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            if node.tag in ("article", "main") and node.suspect:
                holds.add(id(node.suspect))
            todo += [c for c in node.children if isinstance(c, Node)]
    for node, text, linked in blocks(root):
        if node.suspect and node.tag not in HEADINGS and len(text) >= RUNNING and 4 * linked < len(text):
            running.add(id(node.suspect))
        if node.tag == "p" and 2 * linked < len(text):
            score = points_of(text)
            whole += score
            if node.suspect:
                points[id(node.suspect)] += score
    for node in reversed(suspects):  # those inside others come first
        above = node.parent.suspect if node.parent else None
        if above:
            points[id(above)] += points[id(node)]
            for held in (holds, running):
                if id(node) in held:
                    held.add(id(above))
    for node in suspects:
        stays = id(node) in holds or whole and points[id(node)] * 2 >= whole or node.doubtful and id(node) in running
        node.dropped = not stays


def decoded(parts: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(parts))).strip()


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """Innermost blocks below top, in order: node, text, characters in links."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links: list[str] = []

    def flush(node: Node) -> None:
        if parts:
            text = decoded(parts)
            if text:
                out.append((node, text, len(decoded(links))))
            parts.clear()
            links.clear()

    # (node, next child, in a link); a loop, as pages may nest deeper than Python calls.
    todo: list[list] = [[top, 0, False, top]]
    while todo:
        frame = todo[-1]
        node, k, linked, owner = frame
        if k == len(node.children):
            todo.pop()
            if node.tag in BLOCKS:
                flush(node)
            continue
        frame[1] += 1
        child = node.children[k]
        if isinstance(child, str):
            parts.append(child)
            if linked:
                links.append(child)
        elif not child.dropped:
            if child.tag in BLOCKS:
                flush(owner)
                todo.append([child, 0, linked, child])
            else:
                todo.append([child, 0, linked or child.tag == "a", owner])
    flush(top)
    return iter(out)


def ancestors(node: Node) -> Iterator[Node]:
    """The containers of a block, nearest first."""
    box = node if node.tag in CONTAINERS and node.tag != "li" else node.box
    while box is not None:
        yield box
        box = box.box


def main_blocks(page: str) -> list[str]:
    root = tree(page)
    found = list(blocks(root))
    if not found:
        return []
    containers: list[Node] = []
    seen: set[int] = set()
    for node, text, linked in found:
        points = points_of(text)
        if node.tag in HEADINGS or node.tag in ("li", "td", "th", "dt"):
            points = min(points, 1) * 0.2
        elif len(text) < 25:
            points *= 0.5
        for depth, container in enumerate(ancestors(node)):
            if not depth:
                container.length += len(text)
                container.linked += linked
            if depth < 3:
                container.score += points / (depth + 1)
            elif id(container) in seen:
                break  # and so are all above it
            if id(container) not in seen:
                seen.add(id(container))
                containers.append(container)
    for container in sorted(containers, key=lambda c: -c.order):  # those inside others come first
        if container.box is not None:
            container.box.length += container.length
            container.box.linked += container.linked
    rated = {id(c): (c.score + 5 * (c.tag in ("article", "main"))) * (1 - c.linked / max(1, c.length)) for c in containers}
    best = max(containers, key=lambda c: rated[id(c)])
    # An article or main element around the best container holds all of it.
    for above in ancestors(best):
        if above.tag in ("article", "main"):
            best = above
            break
    least = max(10, rated[id(best)] * 0.2)
    kept = {id(best)}
    for other in best.parent.children if best.parent else []:
        if isinstance(other, Node) and not other.dropped and other is not best:
            text_like = other.tag == "p" and (inside := list(blocks(other))) and (n := sum(len(t) for _, t, _ in inside)) > 80 and sum(x for _, _, x in inside) < 0.25 * n
            if rated.get(id(other), 0) >= least or text_like:
                kept.add(id(other))
    out = []
    for node, text, _ in found:
        path, above = [], node
        while above is not None and above.kept is None and id(above) not in kept:
            path.append(above)
            above = above.parent
        stays = above is not None and (above.kept or id(above) in kept)
        for x in path:
            x.kept = stays
        if stays:
            out.append(text)
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
