"""The main text of a web page by composite text density over its element tree.

A node's density is its characters per tag, damped by how much of it is link text. The subtree whose children's
densities have the largest sum is the main part; the lowest density on the way from the body to it is the
threshold that other parts must reach to belong to the text as well. What cannot be main text by its element or its
declared role (menus, headers, footers, sidebars, notices, adverts, forms, scripts) is left out of the tree beforehand. A class or
id that names such a part, or reader comments, only counts against parts that do not hold the page's text (``_judge``).
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr option legend".split())
# an opening tag ends an open element of these, up to one of the second set
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}

# elements, roles and words of class or id that mark what is no main text
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe object svg canvas menu "
    "dialog title xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORDS = (
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|comments?|commentlist|respond|disqus|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscribe|signup|login|sidebars?|side|widgets?|"
    r"navs?|navbar|navigation|menus?|breadcrumbs?|pager|pagination|footers?|headers?|masthead|toolbars?|social|share|sharing|related|"
    r"recommended|recommendations|skip|search|forms?|toc)"
)
MARKS = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-]|\d)", re.IGNORECASE)
# a name made of such words alone: "comments", but not "comments-open"
WHOLE = re.compile(rf"(?:^|\s){_WORDS}\d*(?:[_-]+(?:{_WORDS}\d*|\d+))*(?=\s|$)", re.IGNORECASE)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "chars", "link_chars", "tags", "link_tags", "density", "mark", "plain")

    def __init__(self, name: str, parent: Node | None, dropped: bool):
        self.name, self.parent, self.dropped = name, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = 0.0
        # 1: a word of class or id is in MARKS, 2: a whole name is
        self.mark = self.plain = 0


def _unwanted(name: str, attributes: str, parent: Node) -> bool:
    if name in DROPPED:
        # the heading part of the article itself is text
        return not (name == "header" and _within(parent, "article"))
    if attributes and name not in ("html", "body", "main", "article"):
        # marks of class and id are judged later, with the text
        for found in _ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "role" and value.strip().lower() in ROLES:
                return True
    return False


def _mark(name: str, attributes: str) -> int:
    if not attributes or name in ("html", "body", "main"):
        return 0
    values = [html.unescape(x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(attributes) if x[1].lower() in ("class", "id")]
    if any(WHOLE.search(x) for x in values):
        return 2
    # an article is one unless a whole name says what else it is
    return int(name != "article" and any(MARKS.search(x) for x in values))


def _within(node: Node | None, name: str) -> bool:
    while node is not None:
        if node.name == name:
            return True
        node = node.parent
    return False


def parse(source: str) -> Node:
    """The element tree of a page; what is malformed is repaired roughly as browsers do."""
    root = node = Node("html", None, False)
    place, end = 0, len(source)
    while place < end:
        at = source.find("<", place)
        if at < 0:
            at = end
        if at > place:
            node.children.append(html.unescape(source[place:at]))
        if at == end:
            break
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4) if not source.startswith(("<!-->", "<!--->"), at) else source.index(">", at) - 2
            place = end if stop < 0 else stop + 3
            continue
        follow = source[at + 1 : at + 2]
        if follow in ("!", "?") or follow == "/" and not source[at + 2 : at + 3].isalpha():
            stop = source.find(">", at)
            place = end if stop < 0 else stop + 1
            continue
        if not ((follow.isascii() and follow.isalpha()) or follow == "/"):
            node.children.append("<")
            place = at + 1
            continue
        tag = _TAG.match(source, at)
        if tag:
            closing, name, attributes, place = tag[1], tag[2].lower(), tag[3], tag.end()
        else:  # an attribute's quote is never closed: end at the next bracket
            stop = source.find(">", at)
            if stop < 0:
                break
            closing = "/" if follow == "/" else ""
            name = re.match(r"[^\s/>]*", source[at + 1 + len(closing) : stop])[0].lower()
            attributes, place = "", stop + 1
        if closing:
            node = _closed(node, name)
            continue
        if name in ("html", "body"):
            continue
        node = _implied(node, name)
        child = Node(name, node, node.dropped or _unwanted(name, attributes, node))
        child.mark = 0 if child.dropped else _mark(name, attributes)
        node.children.append(child)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW and _within(node, "svg"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(source, place)
            if not child.dropped:
                child.children.append(html.unescape(source[place : stop.start() if stop else end]))
            if not stop:
                break
            close = source.find(">", stop.end())
            place = end if close < 0 else close + 1
            continue
        node = child
    return root


def _implied(node: Node, name: str) -> Node:
    """Where a new element goes: inside this node, or after what it ends by starting."""
    if name in CLOSES_P:
        walk = node
        while walk.parent is not None and walk.name not in ("article", "aside", "td", "th", "button", "object", "caption") and walk.name != "p":
            walk = walk.parent
        if walk.name == "p" and walk.parent is not None:
            node = walk.parent
    if name in SAME:
        ends, until = SAME[name]
        walk, last = node, None
        while walk.parent is not None and walk.name not in until:
            if walk.name in ends:
                last = walk
            walk = walk.parent
        if last is not None:
            node = last.parent
    return node


def _closed(node: Node, name: str) -> Node:
    walk = node
    while walk.parent is not None and walk.name != name:
        if walk.name in ("table", "td", "th") and name not in BLOCK:
            return node
        walk = walk.parent
    return walk.parent if walk.parent is not None else node


def _judge(root: Node) -> None:
    """Drops the marked parts, except those that hold the page's text whatever their name says.

    A part that holds an article or main stays. Inside one, a part stays if it has most of its text outside of links and
    its name also has other words, or if there is no other text. On pages without article or main, a part
    with most of the page's text outside of links stays.
    """
    order, waiting, marked = [], [(root, False, None)], False
    while waiting:
        node, linked, named = waiting.pop()
        linked = linked or node.name == "a"
        order.append((node, linked, named))
        marked = marked or node.mark > 0
        if node.mark == 2:
            named = node
        waiting += [(x, linked, named) for x in node.children if isinstance(x, Node) and not x.dropped]
    if not marked:
        return
    for node, linked, _ in reversed(order):
        for x in node.children:
            if isinstance(x, str):
                node.plain += 0 if linked else len(_SPACE.sub(" ", x).strip())
            elif not x.dropped:
                node.plain += x.plain
    most = lambda node, whole: node.plain * 2 > whole.plain
    articles = [(node, named) for node, _, named in order if node.name in ("article", "main") and not node.mark]
    # reader comments hold articles too: one under a whole name (the innermost is the smallest) counts if there is no other and it is most of the page
    told = [node for node, named in articles if named is None] or [node for node, named in articles if most(named, root)]
    holding: set[int] = set()
    for node in told:
        walk = node.parent
        while walk is not None and id(walk) not in holding:
            holding.add(id(walk))
            walk = walk.parent
    known = {id(x) for x in told}
    waiting = [(root, None)]
    while waiting:
        node, scope = waiting.pop()
        if node.mark and id(node) not in holding:
            if scope is not None:
                stays = 0 < node.plain == scope.plain or node.mark == 1 and most(node, scope)
            else:
                stays = not told and most(node, root)
            if not stays:
                node.dropped = True
                continue
        if id(node) in known:
            scope = node
        waiting += [(x, scope) for x in node.children if isinstance(x, Node) and not x.dropped]


def _measured(root: Node) -> list[Node]:
    """Characters, tags and densities of all kept nodes; returned children first."""
    order, waiting = [], [(root, False)]
    while waiting:
        node, linked = waiting.pop()
        order.append((node, linked or node.name == "a"))
        waiting += [(x, linked or node.name == "a") for x in node.children if isinstance(x, Node) and not x.dropped]
    order.reverse()
    for node, linked in order:
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(_SPACE.sub(" ", x).strip())
            elif not x.dropped:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.name == "a")
        if linked:
            node.link_chars = node.chars
    chars, links = root.chars, root.link_chars
    for node, _ in order:
        if not node.chars:
            continue
        tags, link_tags, link_chars = max(1, node.tags), max(1, node.link_tags), max(1, node.link_chars)
        plain = node.chars - node.link_chars
        base = math.log(node.chars / max(1, plain) * node.link_chars + links / chars * node.chars + math.e)
        damped = math.log(max(math.e, node.chars / link_chars * (tags / link_tags)), max(base, 1 + 1e-9))
        node.density = node.chars / tags * (damped if plain > 0 else 0)
    return [node for node, _ in order]


def _selected(root: Node) -> list[Node]:
    """The main parts in page order."""
    order = _measured(root)
    sums = {id(n): sum(x.density for x in n.children if isinstance(x, Node) and not x.dropped) for n in order}
    best = max(order, key=lambda n: (sums[id(n)], n.chars))
    if sums[id(best)] <= 0:
        return [root]
    path, walk = [], best
    while walk is not None:
        path.append(walk)
        walk = walk.parent
    # a page that says what its article is: the outermost such element around the best part
    told = [n for n in path if n.name in ("article", "main")]
    threshold = min(n.density for n in path)
    if told and told[-1].name == "article" and told[-1].parent is not None:
        # articles side by side are parts like any other
        beside = [x for x in told[-1].parent.children if isinstance(x, Node) and x.name == "article" and not x.dropped]
        return [x for x in beside if x is told[-1] or x.density >= threshold]
    if told:
        return [told[-1]]
    on_path = {id(n) for n in path}
    chosen, waiting = [], [(root, False)]
    while waiting:
        node, run = waiting.pop()
        if run:
            chosen += _own(node, threshold)
        elif node is best or id(node) not in on_path and node.density >= threshold:
            chosen.append(node)
        elif id(node) in on_path:
            waiting += reversed(_parts(node, on_path))
    return chosen


def _parts(node: Node, on_path: set[int]) -> list[tuple[Node, bool]]:
    """Children in page order as (part, whether it is a run of text and inline elements that stands directly in the node)."""
    parts: list[tuple[Node, bool]] = []
    run: list[Node | str] = []

    def flush() -> None:
        if any(isinstance(x, Node) or x.strip() for x in run):
            held = Node("div", node, False)
            held.children = list(run)
            parts.append((held, True))
        run.clear()

    for x in node.children:
        if isinstance(x, str) or not x.dropped and id(x) not in on_path and _inline(x):
            run.append(x)
        elif not x.dropped:
            flush()
            parts.append((x, False))
    flush()
    return parts


def _inline(node: Node) -> bool:
    waiting = [node]
    while waiting:
        x = waiting.pop()
        if x.name in BLOCK:
            return False
        waiting += [y for y in x.children if isinstance(y, Node) and not y.dropped]
    return True


def _own(run: Node, threshold: float) -> list[Node]:
    """What of a run is text: all of it, or without words of its own or mostly links only elements that are dense enough, and the words."""
    own = [x for x in run.children if isinstance(x, str)]
    elements = [x for x in run.children if isinstance(x, Node)]
    words = any(c.isalnum() for x in own for c in x)
    plain = sum(len(x.strip()) for x in own) + sum(x.chars - x.link_chars for x in elements)
    if words and plain >= sum(x.link_chars for x in elements):
        return [run]
    run.children = [x for x in run.children if (words if isinstance(x, str) else x.name == "br" or x.density >= threshold)]
    return [run]


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    waiting: list[Node | str | None] = [node]
    while waiting:
        item = waiting.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped:
            if item.name in BLOCK:
                flush()
                waiting.append(None)
            elif item.name == "br":
                run.append(" ")
            waiting += reversed(item.children)
    flush()
    return out


def main_text(source: str | None) -> str:
    """Blocks of the main part joined by line feeds; empty for null, empty or text-free pages."""
    root = parse(source or "")
    _judge(root)
    return "\n".join(block for part in _selected(root) for block in _blocks(part))


def extract_pages(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """All columns of ``pages`` with the main text of each page's whole html (null or empty: the empty text).

    Repeated rows each get their text; an existing column of that name is replaced, other columns may
    have any names; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def extracted(sources):
        return sources.map(main_text, na_action=None)

    return pages.withColumn(name, extracted(F.coalesce(F.col(html_column).cast("string"), F.lit(""))))
