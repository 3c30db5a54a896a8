"""Main text of web pages by tree scoring.

The page is parsed into a tree with the usual leniency (implied ends, unclosed tags). Parts that are never main text
go: scripts, forms, navigation, footers, and elements whose role, class or id marks them as menus, notices, adverts,
sidebars or comments. A class or id marks an element only if all words of one of its tokens are on the list; it stays
if it holds an article or main element, or most of the points of a page without one elsewhere, and if hardly any text
is left without the marked elements, they all stay. Each paragraph then passes points for its length and its commas to its ancestors, less with each
level; a container's points are discounted by its share of linked text. The best container, or the article or main
element that holds it, is the main text; unless that lies right under the body, all its siblings that are not mostly links
belong to it. Blocks are joined in page order.

Defined results: a null or empty page, or one without text outside dropped parts, has the empty string and 0 code
points; malformed markup is read as far as it goes; very long pages are read whole, in time that grows with their length,
whatever they hold; ties go to the container that starts first; repeated rows are
handled by themselves; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas form button select option textarea input nav footer aside menu dialog title audio video noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td blockquote html".split())
CLOSES_P = BLOCKS - frozenset(("caption", "td", "th", "tr", "tbody", "thead", "tfoot"))
#: What an opening tag ends, up to the nearest of the tags that hold it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark what is not main text.
UNLIKELY = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer foot masthead topbar sidebar side rail aside comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget widgets skip disclaimer".split())
HEADERS = frozenset("header site-header page-header".split())
LIKELY = frozenset("article body content entry main post story text".split())

OPENING = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
NAME_END, MARK, OPEN_END = re.compile(r"[\s/>]"), re.compile(r"[>\"']"), re.compile(r"<[/a-zA-Z!?]")
#: A part beside the best container goes if as much of its text is linked.
LINKED = 0.25
#: Containers above a paragraph that get points from it.
POINT_LEVELS = 64
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Tags:
    """The tags, comments and declarations of a page, in one pass: what was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[object, tuple[int, int]] = {}
        self.unclosed: set[int] = set()  # quotes that no tag's end follows

    def ahead(self, what: object, at: int) -> int:
        """The next place of a string or pattern from ``at`` on, -1 for none."""
        since, found = self.known.get(what, (1, 0))
        if since <= at and (found < 0 or at <= found):
            return found
        if isinstance(what, str):
            found = self.page.find(what, at)
        else:
            m = what.search(self.page, at)
            found = m.start() if m else -1
        self.known[what] = at, found
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, outside of quotes; -1 for none. ``at`` follows the name."""
        passed = []
        at = self.ahead(MARK, at)
        while at >= 0 and self.page[at] != ">":
            stop = -1 if at in self.unclosed else self.page.find(self.page[at], at + 1)
            passed.append(at)
            m = MARK.search(self.page, stop + 1) if stop >= 0 else None
            at = m.start() if m else -1
        if at < 0:
            self.unclosed.update(passed)
        return at

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """Start, end, name (none for comments and the like) and attributes of what comes next."""
        page = self.page
        while (start := self.ahead(OPENING, at)) >= 0:
            if page[start + 1] in "!?":
                if page.startswith("<!--", start):
                    stop = page.find("-->", start + 4)
                    return start, stop + 3 if stop >= 0 else len(page), "", ""
                if page.startswith("<![CDATA[", start) and (stop := self.ahead("]]>", start)) >= 0:
                    return start, stop + 3, "", ""
                stop = self.ahead(">", start)
                return start, stop + 1 if stop >= 0 else len(page), "", ""
            if self.ahead(">", start) < 0:
                return None
            name = start + 2 if page[start + 1] == "/" else start + 1
            follows = self.ahead(NAME_END, name)
            stop = self.tag_end(follows)
            if stop >= 0:
                return start, stop + 1, page[name:follows].lower(), page[follows:stop]
            at = start + 1
        return None


class Node:
    __slots__ = ("tag", "words", "parent", "items", "dropped", "marked", "links", "length", "score", "order", "within")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.words: set[str] = set()
        self.items: list = []
        self.dropped, self.marked, self.score = False, False, 0.0
        self.links = self.length = 0
        #: Whether an article or main element holds it.
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))


def unwanted(node: Node, attrs: dict[str, str]) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    return node.tag == "header" and not node.within


def marked(node: Node, tokens: list[str]) -> bool:
    """Whether a class or an id says that an element is not main text; such words may mislead, see ``main_text``."""
    if node.tag in ("html", "body"):
        return False
    if node.tag in ("article", "main"):
        return not {"comment", "comments", "reply", "related"}.isdisjoint(tokens)
    if any(all(w in UNLIKELY for w in re.findall("[a-z]+", t)) for t in tokens if re.search("[a-z]", t)):
        return True
    return not HEADERS.isdisjoint(tokens) and not node.within


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its elements in page order."""
    root = Node("html", None, 0)
    nodes = [root]
    here = root
    at = 0
    opened = Counter({"html": 1})  # elements from the root to here, so that no search goes up in vain
    tags = Tags(page)

    def add_text(start: int, stop: int) -> None:
        if stop > start and not here.dropped:
            here.items.append(entities.unescape(page[start:stop]))

    def go_up(to: Node) -> Node:
        x = here
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        return to

    while True:
        found = tags.next(at)
        if found is None:
            stop = len(page)
            cut = OPEN_END.search(page, max(at, page.rfind(">") + 1))  # a tag that the page's end cuts off
            add_text(at, cut.start() if cut else stop)
            break
        start, stop, tag, rest = found
        add_text(at, start)
        at = stop
        if not tag:
            continue
        if page[start + 1] == "/":
            x = here if opened[tag] else None
            while x is not None and x.tag != tag:
                # A stray end tag reaches no further than the block it is in, unless it ends a block itself.
                x = None if x.tag in BLOCKS and tag not in BLOCKS else x.parent
            if x is not None and x.parent is not None:
                here = go_up(x.parent)
            continue
        if tag in CLOSES_P and opened["p"]:
            x = here
            while x is not None and x.tag != "p":
                x = None if x.tag in BLOCKS else x.parent
            if x is not None:
                here = go_up(x.parent)
        if tag in IMPLIED and any(opened[t] for t in IMPLIED[tag][0]):
            ended, holders = IMPLIED[tag]
            x = here
            while x is not None and x.tag not in holders:
                if x.tag in ended:
                    here = go_up(x.parent or here)
                    if tag not in ("tr",):
                        break
                x = x.parent
        attrs = {a[1].lower(): entities.unescape(next((v for v in a.groups()[1:] if v is not None), "")) for a in ATTRIBUTE.finditer(rest)} if rest else {}
        if tag == "html":
            continue
        node = Node(tag, here, len(nodes))
        marks = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        if not marks.isspace():
            node.words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower())) | set(marks.split())
            node.marked = marked(node, marks.split())
        node.dropped = here.dropped or unwanted(node, attrs)
        nodes.append(node)
        here.items.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = page.find(">", stop.end()) + 1 if stop else 0
            at = at or len(page)
            continue
        if not rest.endswith("/") or tag in BLOCKS:
            here = node
            opened[tag] += 1
    return root, nodes


def measure(nodes: list[Node]) -> None:
    """Lengths of text and of linked text, bottom up; children come after their parents."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.length = node.links = 0
        for x in node.items:
            if isinstance(x, str):
                node.length += len(" ".join(x.split()))
            elif not x.dropped:
                node.length += x.length
                node.links += x.length if x.tag == "a" else x.links


def flat(node: Node, nested: bool) -> str:
    """Text of a node in page order, with its blocks parted by a space; without ``nested``, none of the blocks in it."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.dropped or (x is not node and not nested and x.tag in BLOCKS):
            continue
        else:
            if x.tag in BLOCKS or x.tag == "br":
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.items))
    return " ".join("".join(out).split())


def density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def points(node: Node) -> float:
    """The points of a block for its own text."""
    text = flat(node, False)
    return 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3) if text else 0.0


def drop_marked(nodes: list[Node]) -> bool:
    """Drop the marked elements, except those that hold main text; whether any went."""
    found = [x for x in nodes if x.marked and not x.dropped]
    if not found:
        return False
    total = dict.fromkeys(nodes, 0.0)
    holds: set[Node] = set()
    plain = False
    for node in reversed(nodes):
        if node.dropped:
            continue
        if node.tag in BLOCKS and node.length:
            total[node] += points(node)
        own = node.tag in ("article", "main") and not node.marked
        if node.parent is not None:
            total[node.parent] += total[node]
            if own or node in holds:
                holds.add(node.parent)
        plain = plain or own
    whole = total[nodes[0]]
    went = False
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.marked and not node.dropped and node not in holds and (plain or total[node] * 2 <= whole):
            node.dropped = went = True
    return went


def main_text(page: str | None) -> str:
    if not page or page.isspace():
        return ""
    root, nodes = parse(page)
    measure(nodes)
    all_length = root.length
    kept = [x.dropped for x in nodes]
    if not drop_marked(nodes):
        return chosen_text(nodes)[0]
    measure(nodes)
    text, sure = chosen_text(nodes)
    if sure or len(text) * 10 >= all_length:
        return text
    for node, dropped in zip(nodes, kept, strict=True):
        node.dropped, node.score = dropped, 0.0
    measure(nodes)
    return chosen_text(nodes)[0]


def chosen_text(nodes: list[Node]) -> tuple[str, bool]:
    """The main text of what is not dropped, and whether an article or main element holds it."""
    for node in nodes:
        if node.dropped or node.tag not in BLOCKS or not node.length:
            continue
        own = points(node)
        if not own:
            continue
        # A block with text of its own outside paragraphs is a paragraph in its own right.
        above, level = node.parent if node.tag not in ("div", "article", "section", "main", "td", "body", "html") else node, 0
        while above is not None and level < POINT_LEVELS:
            if above.tag in CONTAINERS:
                above.score += own / (1 if level == 0 else 2 if level == 1 else level * 3)
                level += 1
            above = above.parent
    best = None
    for node in nodes:
        if node.dropped or node.score <= 0:
            continue
        bonus = (25 if node.tag in ("article", "main") else 0) + (10 if node.words & LIKELY else 0)
        node.score = (node.score + bonus) * (1 - density(node))
        if best is None or node.score > best.score:
            best = node
    if best is None:
        return "", False
    holder = best
    while holder is not None and holder.tag not in ("article", "main"):
        holder = holder.parent
    best = holder or best
    if best.parent is None or (best.tag in ("article", "main") and best.parent.tag in ("body", "html")):
        return flat(best, True), holder is not None
    keep = Node(best.parent.tag, None, 0)
    for x in best.parent.items:
        if isinstance(x, str):
            keep.items.append(x)
        elif x is best or (x.tag != "a" and density(x) < LINKED):
            keep.items.append(x)
    return flat(keep, True), holder is not None


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points, for every page."""
    def run(batches):
        for batch in small_batches(batches, 500):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
