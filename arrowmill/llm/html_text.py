"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each node's density is its characters per
tag, adjusted for links: where link text or link tags prevail, the logarithm's
base grows and the density falls. A node's density sum adds the densities of
its children. The content grows from the node of the largest sum towards the body:
an element around it is taken if it adds text beside it, through wrappers that
add none. The body, and what stands around an article, is taken if it adds
running text or a part of like density or size, as sibling sections and
articles are. Lists of links beside the way are not taken with it. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, known by tag, role, class or id, count as
no text and are left out; nothing else of the content is dropped. A class or id
tells by whole tokens and by compounds of names and places (site-footer), not
on headings. A name, role or form drops nothing that holds the page's article or
main element or, where none of weight stands elsewhere, most of its text; if
else no text is left, all of these stay.

Edge cases: null or empty html, and pages without text, give an empty string;
unclosed and stray tags are repaired as browsers do for paragraphs, list items
and table cells; text without any element is content; comments, doctypes and
processing instructions are skipped; a page cut off inside a tag loses only
that tag. Depth is unbounded, as no walk recurses.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ships

ships(__name__)

#: No part gives back what it took, and a quote without its like stands for itself, so a page is read in linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.S)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that are never the article's text.
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu noframes noembed xmp title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended recommendations trending share sharing social "
    "comment comments commentlist respond reply replies disqus discussion footer header masthead topbar toolbar copyright legal tags tagcloud search searchbox side-bar skip-link toc".split()
)
#: Names of reader comments, which may hold more text than the article, and article elements.
_COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: What stands beside a name in a compound that says the same, as in site-footer or comment-list; the second only before it, as in page-header.
_PLACES = frozenset("site global primary secondary top bottom left right upper lower inner outer list lists box boxes container block blocks area section item items link links bar unit slot group row panel form button buttons posts articles stories news wrap wrapper mobile desktop sticky fixed".split())
_BEFORE = frozenset("main page post article entry blog".split())
#: Names that a part of an article may have by its subject: running text so named stays.
_AMBIGUOUS = frozenset("discussion related recommended legal share sharing social tags trending search".split())
PROSE = 140
#: Names that the heading of an article's section may give it.
_SUBJECTS = frozenset("discussion related search legal notice notices consent copyright tags social sharing share promotion subscription navigation trending".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[_-]+")
#: Why a node is left out: never text; by a name, role or form, unless it holds the article; the same of a section's id; reader comments; by a name that may be a subject, unless it holds running text.
HARD, SOFT, SUBJECT, COMMENTS, VAGUE = 1, 2, 3, 4, 5
#: A start tag of the left closes an open element of the right, up to the barrier.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_PARAGRAPH_BARRIER = frozenset("div article section main body td th li aside nav header footer form blockquote table ul ol dd button object".split())


#: The groups of `_CLOSES` by tag: of each the elements closed and the barrier.
_GROUPS = {tag: i for i, tags in enumerate((("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",))) for tag in tags}
#: Elements that some group looks for, with the groups.
_SOUGHT: dict[str, list[int]] = {}
for _tag, _i in _GROUPS.items():
    for _x in _CLOSES[_tag][0] | _CLOSES[_tag][1]:
        if _i not in _SOUGHT.setdefault(_x, []):
            _SOUGHT[_x].append(_i)
_CELLS = frozenset("td th tr tbody thead tfoot table".split())
#: Elements of running text; what stands in one is part of a longer text.
_TEXTS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl dd dt figure figcaption".split()) | _CELLS | INLINE


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "chars", "tags", "link_chars", "link_tags", "sum", "density", "why", "block", "inline", "near", "edge")

    def __init__(self, tag: str, parent: "Node | None", drop: bool, why: int = 0) -> None:
        self.tag, self.parent, self.drop, self.why = tag, parent, drop, why
        self.children: list = []
        # While the tree is built: the block this stands in (itself, if it is one), a block's open inline elements by tag, and for each
        # group of tags, and for paragraphs, the nearest element that it closes or that bars it; so no step walks the open elements.
        if parent is None:
            self.block, self.inline, self.near, self.edge = self, {}, (None,) * 5, None
        else:
            self.block, self.near, self.edge = parent.block, parent.near, parent.edge
            if tag not in INLINE:
                self.block, self.inline = self, {}
            if tag in _SOUGHT:
                near = list(parent.near)
                for i in _SOUGHT[tag]:
                    near[i] = self
                self.near = tuple(near)
            if tag == "p" or tag in _PARAGRAPH_BARRIER:
                self.edge = self
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.sum = self.density = 0.0


def _named(value: str) -> int:
    """Whether a token of a class or id names what isn't the article's text; names that may be a subject count least."""
    found = 0
    for token in value.split():
        parts = [token] if token in _NAMES else [x for x in _PARTS.split(token) if x and not x.isdigit()]
        if any(x in _NAMES for x in parts) and all(x in _NAMES or x in _PLACES or not i and x in _BEFORE for i, x in enumerate(parts)):
            found = _stronger(found, COMMENTS if not _COMMENTS.isdisjoint(parts) else VAGUE if token in _AMBIGUOUS else SOFT)
    return found


def _stronger(a: int, b: int) -> int:
    """Of two reasons the one that decides: comments, then names, then names that may be a subject, then those of a section's id."""
    return max(a, b, key=(0, SUBJECT, VAGUE, SOFT, COMMENTS).index)


def _dropped(tag: str, attributes: str) -> int:
    """Why a node may be left out, or 0."""
    if tag in DROPPED:
        return SOFT if tag == "form" else HARD
    if "=" not in attributes and "hidden" not in attributes:
        return 0
    if tag in ("body", "html", "article", "main"):
        return 0
    found = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        if name == "role" and value in _ROLES:
            found = _stronger(found, SOFT)
        elif name in ("class", "id") and tag not in _HEADINGS and (why := _named(value)):
            found = _stronger(found, SUBJECT if tag == "section" and name == "id" and value in _SUBJECTS and not found else why)
    return HARD if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _ATTRIBUTE.sub(" ", attributes)) else found


def parse(source: str) -> Node:
    """The tree under a root node; text is kept as strings among the children, with references decoded."""
    root = node = Node("#root", None, False)
    at, n = 0, len(source)
    opened: dict[str, int] = {}

    def text(chunk: str) -> None:
        if chunk:
            node.children.append(html.unescape(chunk) if "&" in chunk else chunk)

    def close(outer: Node) -> None:
        """Ends what is open inside of `outer`, each element once."""
        nonlocal node
        while node is not outer:
            opened[node.tag] -= 1
            if node.tag in INLINE:
                node.block.inline[node.tag] -= 1
            node = node.parent

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            tail = source[at:]
            cut = re.search(r"<[a-zA-Z/!?]", tail)
            text(tail if cut is None else tail[: cut.start()])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[1] is not None:
            node.children.append(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            # An inline end tag closes nothing beyond the block it stands in.
            if (node.block.inline if tag in INLINE else opened).get(tag, 0):
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up.parent)
            continue
        if tag not in INLINE:
            # A block ends an open paragraph, with the inline elements still open in it.
            if node.edge is not None and node.edge.tag == "p":
                close(node.edge.parent)
            if tag in _GROUPS:
                closed, group = _CLOSES[tag][0], _GROUPS[tag]
                while (up := node.near[group]) is not None and up.tag in closed:
                    close(up.parent)
                    if tag != "tr":
                        break
            if tag == "body":
                up = node
                while up is not root and up.tag != "html":
                    up = up.parent
                close(up)
        why = _dropped(tag, m[4] or "")
        child = Node(tag, node, node.drop or why == HARD, why)
        node.children.append(child)
        if tag in VOID or (m[4] or "").rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        opened[tag] = opened.get(tag, 0) + 1
        if tag in INLINE:
            child.block.inline[tag] = child.block.inline.get(tag, 0) + 1
        node = child
    return root


def _settled(root: Node) -> None:
    """Drops what names, roles and forms tell, unless it holds the article; all of it stays if else no text is left."""
    order, stack, matched = [], [root], False
    while stack:
        node = stack.pop()
        order.append(node)
        matched = matched or node.why > HARD
        stack += [c for c in node.children if isinstance(c, Node) and not c.drop]
    if not matched:
        return
    # Of each node: characters, those in links, and those of the largest article or main element, itself included.
    sizes: dict[Node, tuple[int, int, int]] = {}
    for node in reversed(order):
        chars = links = article = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(_SPACE.sub(" ", c).strip())
            elif not c.drop:
                n, k, a = sizes[c]
                chars, links, article = chars + n, links + k, max(article, a)
        sizes[node] = chars, chars if node.tag == "a" else links, chars if node.tag in ("article", "main") else article
    # The largest article outside of all matches.
    free, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            free = max(free, sizes[node][0])
        stack += [c for c in node.children if isinstance(c, Node) and not c.drop and c.why <= HARD]
    chars, links, _ = sizes[root]
    own = 10 * free >= chars - free
    kept, dropped, stack = 0, [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        n, k, article = sizes[node]
        if node.why > HARD:
            holds = article > free or not own and 2 * (n - k) > chars - links
            prose = 2 * k <= n and (node.why == SUBJECT and inside or node.why == VAGUE and n - k >= PROSE)
            if node.why == COMMENTS or not (holds or prose):
                dropped.append(node)
                continue
        inside = inside or node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, str):
                kept += not c.isspace()
            elif not c.drop:
                stack.append((c, inside))
    if kept:
        for node in dropped:
            node.drop = True


def _measured(root: Node) -> list[Node]:
    """All kept nodes, parents first, with densities and sums."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.drop]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = root
    for node in order:
        if node.tag == "body":
            body = node
            break
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
            # A body without any link has base 1 throughout; then density alone counts.
            node.density = c / t * (math.log(max(c / lc * t / lt, 1.0)) / math.log(base) if base > 1 else 1.0)
    for node in order:
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and not c.drop)
        # Text that stands in a node itself weighs like a child of it.
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        if own and node.tag not in INLINE:
            node.sum += own
    return order


def _linked(node: Node) -> bool:
    """Whether a node is a list of links."""
    return node.link_tags > 1 and 2 * node.link_chars > node.chars


def _joins(node: Node, text: Node) -> bool:
    """Whether a sibling of the text, or of an element around it, belongs to it too: plain text or blocks of text, or a part of like density or size."""
    return 2 * node.link_chars <= node.chars and (node.tag in _TEXTS or 2 * node.density >= text.density or 5 * node.chars >= text.chars)


def content(root: Node) -> Node:
    """The subtree that holds the main text; lists of links beside the way to the densest node are marked as dropped."""
    _settled(root)
    order = _measured(root)
    blocks = [x for x in order if x.tag not in INLINE and x.chars] or [root]
    body = next((x for x in order if x.tag == "body"), root)
    up = max(blocks, key=lambda x: x.sum)
    while up.tag in _TEXTS and up.tag not in _CELLS and up.parent is not None and up is not body:
        up = up.parent
    # The highest node on the way to the body that adds text which belongs to it; wrappers that add none are passed.
    top, beside, spared = up, [], []
    while up is not body and up.parent is not None:
        others = [x for x in up.parent.children if x is not up and not isinstance(x, str) and not x.drop and x.chars]
        beside += [x for x in others if _linked(x)]
        others = [x for x in others if not _linked(x)]
        plain = any(isinstance(x, str) and re.search(r"\w", x) for x in up.parent.children)
        strict = up.parent is body or up.tag in ("article", "main")
        if plain or any(not strict or _joins(x, top) for x in others):
            top, spared = up.parent, list(beside)
        up = up.parent
    for x in spared:
        x.drop = True
    return top


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under `node` in page order."""
    found: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            found.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.drop:
            continue
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in INLINE:
            stack += reversed(x.children)
        else:
            flush()
            stack.append(None)
            stack += reversed(x.children)
    flush()
    return found


def main_text(source: str | None) -> str:
    """The main text of a page, its blocks parted by an empty line."""
    return "\n\n".join(blocks(content(parse(source)))) if source else ""


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id and url (of any type), text and n_chars of every page."""
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(_extract, T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
