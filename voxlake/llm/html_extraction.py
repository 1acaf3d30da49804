"""Operator 1, HTML extraction: tree scoring.

A page becomes a tree of elements. Paragraphs pass points for length and commas to their ancestors (all to the parent; each container passes half of
its own on), discounted by the share of their text that is link text. The container with the most points, and those of its siblings
that score near it or are prose themselves, are the article. What can't be article text never enters the tree: scripts, styles,
forms, menus, page headers and footers, sidebars, adverts, notices and reader comments, by element or by class, id and role. A block whose token is made of such words goes, and
one of which a longer token has a plain one as a part ('left-sidebar', 'comment-list'); other parts ('main-nav') discard what is mostly links, and else
take three quarters of the points. No name discards a wrapper whose elements hold more than half of the page's prose, or of the prose inside article and main
elements, nor a part of a sentence, nor a table's cell, and a paragraph or list item only goes by a plain word or as links. Article and main elements weigh half as
much again, and the one around the container with the most points is taken whole. Outside of those, a list that is link text nearly all over and in short pieces is a menu without
the name. A heading of the page that stands before the container, and parts beside it with a whole paragraph of prose, belong to the article.

The text of the article comes in page order, one line per block: character references decoded, white space runs turned into one
space, blocks trimmed, empty ones left out. Nothing else is dropped or cut.

Defined cases: null or empty html, and html without text, give an empty text and 0 characters; broken markup is read as browsers do
(unclosed paragraphs, list items and cells end where the next one starts, stray end tags are ignored, '<![' and '<?' up to the next '>' are
comments, a tag or comment that the end of the page cuts off is dropped); equal rows get equal results; an
empty table gives an empty result; input columns named like an output column are replaced. Pages are read whole; the work
grows with the page's length, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre blockquote li dd dt td h1 h2 h3 h4 h5 h6 figcaption".split())
#: Never article text, whatever they hold.
SKIPPED = frozenset("script style noscript template iframe svg canvas head title form button select textarea input label nav aside footer menu dialog".split())
#: Words of class, id or role that mark what isn't article text.
WORDS = (
    r"(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|contentinfo|disqus|footer|gdpr"
    r"|(?:site|page|top|global)[_-]?header|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promos?|promoted|related|replies|search|share|sharing"
    r"|sidebar|sidenav|skip|social|sponsors?|sponsored|subscribe|toolbar|topbar|widgets?|complementary|aside)"
)
#: A whole token of such words discards an element; one among other words of a token only makes it weigh less.
UNWANTED = re.compile(rf"(?:^|\s){WORDS}(?:[_-]+{WORDS})*\d*(?:$|\s)", re.IGNORECASE)
DOUBTFUL = re.compile(rf"(?:^|[\s_-]){WORDS}(?:$|[\s_-]|\d)", re.IGNORECASE)
#: Words that mark a block wherever they stand in a token, and those that mark a paragraph as a whole token.
PLAIN = r"(?:ads?|adverts?|advertisements?|advertising|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|gdpr|newsletter|notices?|sidebar|sponsors?|sponsored)"
PART = re.compile(rf"(?:^|[\s_-]){PLAIN}(?:$|[\s_-]|\d)|(?:^|[\s_-])related[_-]?(?:articles?|content|items|links?|news|pages|posts?|reading|stories)(?:$|[\s_-])", re.IGNORECASE)
PARAGRAPH = re.compile(rf"(?:^|\s){PLAIN}(?:$|\s)", re.IGNORECASE)
#: What readers wrote may be longer than the article.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies)\d*(?:$|[\s_-])", re.IGNORECASE)
#: Such a token says that a wrapper has comments beside its text, not that it is one.
BESIDE = re.compile(r"(?:^|\s)(?:with|has|no|without)[_-]\S*", re.IGNORECASE)
#: Characters of a paragraph that make a part beside the container one of the article.
WHOLE_PARAGRAPH = 80
DOUBT = 0.25
NAMED = ("article", "main")
NAMED_WEIGHT = 1.5
#: An element of the first kind ends an open one of the second, inside the nearest of the third.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
CLOSES_P = BLOCK - frozenset("body caption html tbody td tfoot th thead tr li dd dt".split())
SPACE = re.compile(r"\s+")
#: Their content is no markup: it ends at their end tag, or (the second kind, where it has none) isn't special.
RAW, RAW_IF_CLOSED = frozenset(["script", "style"]), frozenset("title textarea iframe noembed noframes".split())
#: Menu entries have no more characters than this on average.
MENU_ENTRY = 40
_tag_name, _tag_end = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[\s/]*>")
_attribute = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_unclosed_value = re.compile(r"""[\s/]*[^\s/>][^\s/>=]*\s*=\s*["']""")
_comment_end = re.compile(r"--!?>")


class Node:
    __slots__ = ("tag", "parent", "items", "points", "length", "links", "commas", "n_links", "wanted", "named", "marked", "partly", "readers", "weight", "titled", "longest")

    def __init__(self, tag: str, parent: Node | None, wanted: bool = True):
        self.tag, self.parent, self.wanted = tag, parent, wanted
        self.items: list[Node | str] = []
        self.points = 0.0
        self.length = self.links = self.commas = self.n_links = 0
        self.named = tag in NAMED or parent is not None and parent.named
        self.marked = self.partly = self.readers = self.titled = False
        self.longest = 0
        self.weight = NAMED_WEIGHT if tag in NAMED else 1.0


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Class, id, role, hidden, aria-hidden and style of the tag whose attributes start at a position, and where the tag ends (-1: it is cut off)."""
    found = {}
    while not (end := _tag_end.match(html, at)):
        one = _attribute.match(html, at)
        if one is None or one[2] is one[3] is one[4] is None and _unclosed_value.match(html, at):
            return found, -1
        found.setdefault(one[1].lower(), next((v for v in one.groups()[1:] if v is not None), ""))
        at = one.end()
    return found, end.end()


class Tree:
    """Builds the tree. A skipped or hidden element and all below it is kept out of the text, a marked one until the page is known."""

    def __init__(self, html: str):
        self.root = self.at = Node("#root", None)
        self.nodes: list[Node] = []
        self.path = [self.root]
        #: For each tag the places on the path where it is open.
        self.open: dict[str, list[int]] = defaultdict(list)
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        never_ended = set()
        while at < n:
            mark = html.find("<", at)
            if mark < 0:
                mark = n
            if self.at.wanted and mark > at:
                self.at.items.append(unescape(html[at:mark]))
            at = mark
            if mark == n:
                return
            follows = html[mark + 1 : mark + 2]
            if html.startswith("<!--", mark):
                end = _comment_end.search(html, mark + 2)
                at = end.end() if end else n
            elif follows in ("!", "?") or follows == "/" and not _tag_name.match(html, mark + 2):
                at = self._after(html, mark)
            elif follows == "/":
                self._end((_tag_name.match(html, mark + 2)[0].lower(),), ())
                at = self._after(html, mark)
            elif name := _tag_name.match(html, mark + 1):
                attributes, at = _attributes(html, name.end())
                if at < 0:
                    return
                tag = name[0].lower()
                self._start(tag, attributes)
                if tag in RAW or tag in RAW_IF_CLOSED and tag not in never_ended:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                    at = end.start() if end else n if tag in RAW else at
                    if not end:
                        never_ended.add(tag)
                elif html[at - 2] == "/" and tag in ("svg", "math"):
                    self._end((tag,), ())
            else:
                if self.at.wanted:
                    self.at.items.append("<")
                at = mark + 1

    @staticmethod
    def _after(html: str, mark: int) -> int:
        end = html.find(">", mark)
        return len(html) if end < 0 else end + 1

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in CLOSES_P:
            self._end(("p",), ("button", "td", "th", "table", "object"))
        if tag in ENDED_BY:
            self._end(*ENDED_BY[tag])
        wanted = self.at.wanted and tag not in SKIPPED
        marked = partly = readers = doubtful = False
        if wanted and tag not in ("html", "body", "article", "main"):
            values = [attributes[k] for k in ("class", "id", "role") if attributes.get(k)]
            marks = unescape(" ".join(values)) if values else ""
            hidden = any(attributes.get(k, "false") != "false" for k in ("hidden", "aria-hidden")) or "display:none" in attributes.get("style", "").replace(" ", "")
            bare = any(v.strip().lower() == "header" for v in values)
            wanted = not hidden and not ((bare or tag == "header") and not self.at.named)
            if marks:
                told = BESIDE.sub(" ", marks)
                doubtful, readers = bool(DOUBTFUL.search(marks)), bool(READERS.search(told))
                whole = bool(UNWANTED.search(marks))
                if tag in PROSE:
                    marked, partly = bool(PARAGRAPH.search(marks)) and tag not in ("td", "th"), whole and tag not in ("td", "th")
                else:
                    marked, partly = whole or tag in BLOCK and bool(PART.search(told)), tag in BLOCK and doubtful
        node = Node(tag, self.at, wanted)
        node.marked, node.partly, node.readers = marked, partly, readers
        if doubtful:
            node.weight = DOUBT
        self.at.items.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag].append(len(self.path))
            self.path.append(node)

    def _end(self, tags, within) -> None:
        """Closes up to the nearest open element of these tags, if none of within stands before it."""
        place = max((self.open[t][-1] for t in tags if self.open[t]), default=0)
        if place <= max((self.open[t][-1] for t in within if self.open[t]), default=0):
            return
        while len(self.path) > place:
            self.open[self.path.pop().tag].pop()
        self.at = self.path[-1]


def _discard(tree: Tree) -> None:
    """Marked elements and all below them become unwanted, as do partly marked ones that are links for the greater part, but for wrappers: those with elements below them that hold more than half of the page's
    prose, or of the prose inside article and main elements. What readers wrote doesn't count as prose, unless the page has no other: then nothing is discarded."""
    if not any(node.marked or node.partly for node in tree.nodes):
        return
    # Prose at and below each node, and the part of it inside article and main elements; where a node stands: in a link, in a named element, apart.
    prose, places, own = {id(tree.root): [0, 0, 0]}, {id(tree.root): (False, False, False)}, {}
    for node in tree.nodes:
        linked, named, apart = places[id(node.parent)]
        linked, named, apart = places[id(node)] = linked or node.tag == "a", named or node.tag in NAMED, apart or node.readers or not node.wanted
        n = sum(len(item.strip()) for item in node.items if isinstance(item, str)) if node.wanted else 0
        said = 0 if linked or apart else n
        own[id(node)] = (said, said if named else 0)
        prose[id(node)] = [*own[id(node)], n if linked else 0]
    for node in reversed(tree.nodes):
        above = prose[id(node.parent)]
        for k, n in enumerate(prose[id(node)]):
            above[k] += n
    whole = prose[id(tree.root)][:2]
    for node in tree.nodes:
        said, _, links = prose[id(node)]
        most = any(2 * (part - mine) > all_of_it for part, mine, all_of_it in zip(prose[id(node)], own[id(node)], whole))
        goes = node.marked or node.partly and links > said
        if goes and node.tag not in BLOCK:  # a part of a sentence stays
            goes = not any(isinstance(item, str) and item.strip() for item in node.parent.items)
        if not node.parent.wanted or whole[0] and goes and not most:
            node.wanted = False


def _measure(tree: Tree) -> None:
    """Text length, link text length and commas of every wanted node, from the leaves up: nodes stand after their parents."""
    for node in reversed(tree.nodes):
        if not node.wanted:
            continue
        for item in node.items:
            if isinstance(item, str):
                text = SPACE.sub(" ", item).strip()
                node.length += len(text)
                node.commas += text.count(",") + text.count("、") + text.count("，")
            elif item.wanted:
                node.length += item.length
                node.links += item.links
                node.commas += item.commas
                node.n_links += item.n_links
                node.titled |= item.titled
                node.longest = max(node.longest, item.longest)
        if node.tag == "a":
            node.links, node.n_links = node.length, 1
        prose = node.links < 0.25 * node.length
        if node.tag == "h1":
            node.titled = prose
        elif node.tag == "p" and prose:
            node.longest = node.length


def _article(tree: Tree) -> list[Node]:
    _measure(tree)
    # From the leaves up, as nodes stand after their parents: what a container has when its turn comes, all below it have given.
    for node in reversed(tree.nodes):
        if not node.wanted or not node.length:
            continue
        node.parent.points += node.points / 2
        own_text = node.tag in BLOCK and any(isinstance(i, str) and i.strip() for i in node.items)
        if node.tag in PROSE or own_text:
            points = (1 + node.commas + min(node.length / 100, 3)) * (1 - node.links / node.length)
            if node.tag not in PROSE:
                node.points += points
                points /= 2
            node.parent.points += points
    scored = [node for node in (tree.root, *tree.nodes) if node.points]
    if not scored:
        return [tree.root]
    for node in scored:
        node.points *= node.weight
    best = max(scored, key=lambda n: n.points)
    named = best
    while named is not None and named.tag not in NAMED:
        named = named.parent
    best = named or best  # the article or main element around the container is the article
    while best.parent is not None and best.tag not in BLOCK:
        best = best.parent  # an inline element that a broken page wraps around paragraphs isn't the container
    if best.parent is None:
        return [best]
    keep = []
    for item in best.parent.items:
        if isinstance(item, str) or not item.wanted:
            continue
        near = item.points >= max(0 if item.tag in NAMED else 10, 0.2 * best.points) and item.tag in BLOCK
        prose = item.weight >= 1 and item.longest > WHOLE_PARAGRAPH and item.links < 0.25 * item.length
        if item is best or near or prose or item.titled and item.links < 0.25 * item.length:
            keep.append(item)
    if not any(item.titled for item in keep):
        keep = _title_before(best.parent) + keep
    return keep


def _title_before(node: Node) -> list[Node]:
    """The heading that stands nearest before a node, beside it or one of the two elements around it, in a part that isn't links."""
    for _ in range(3):
        if node.parent is None:
            break
        found = None
        for item in node.parent.items:
            if item is node:
                break
            if not isinstance(item, str) and item.wanted and item.titled and item.weight >= 1 and item.tag not in NAMED and item.links < 0.25 * item.length:
                found = item
        if found is not None:
            while found.tag != "h1":
                found = next(i for i in reversed(found.items) if not isinstance(i, str) and i.wanted and i.titled)
            return [found]
        node = node.parent
    return []


def _link_list(node: Node) -> bool:
    """A list or table outside of article and main elements that is link text nearly all over, in short pieces: a menu without the name."""
    menu = node.tag in ("ul", "ol", "table", "dl") and not node.named
    return menu and node.n_links > 0 and node.links > 0.8 * node.length and node.links <= MENU_ENTRY * node.n_links


def _blocks(nodes: list[Node]) -> list[str]:
    out, line = [], []

    def flush():
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                line.append(item)
            elif item.wanted and not _link_list(item):
                if item.tag == "br":
                    line.append(" ")
                block = item.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(item.items)
        flush()
    return out


def main_text(html: str | None) -> str:
    """The article's text, one block per line."""
    if not html:
        return ""
    tree = Tree(html)
    _discard(tree)
    return "\n".join(_blocks(_article(tree)))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars instead of the html."""
    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([main_text(h) for h in html], dtype=object)

    out = without(pages.withColumn("__text", texts(F.col(f"`{html_col}`"))), "text", "n_chars", html_col)
    return out.withColumn("n_chars", F.length("__text").cast("long")).withColumnRenamed("__text", "text").select(
        *[F.col(f"`{c}`") for c in out.columns if c != "__text"], "text", "n_chars"
    )
