"""Main text of web pages by a maximum-scoring subsequence.

A page is read as words and tags. A word scores by what encloses it, a tag costs;
one linear scan finds the contiguous region of the highest sum, and its blocks
are the text. Inside an ``article`` or ``main`` nothing costs and each word scores
above zero, so lists of links, pictures and empty cells there end no region; between
two paragraphs of one parent nothing costs either. The weights are log odds counted
on labelled pages: those with an ``article`` or ``main`` element, whose inside is the
content; tags of boilerplate, which is known by its names, are left out of them. At
most ``max_labelled`` pages serve, from the twice as many whose ids have the smallest hashes.

Nulls: null html is empty and gives empty text. Pages without words that score
above zero give empty text. Repeated rows give repeated results; an empty table
gives an empty one; broken, cut or unclosed markup is read as far as it goes.
Of regions with equal sums the first counts. Very long and deeply nested pages
are read whole, in time that grows with their length. Of the input's columns
only the id, the html and those named in ``keep`` are read and returned; others,
whatever their names, change nothing.
"""

from __future__ import annotations

import html as chars
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

MAX_LABELLED = 2000
# Fixed values of HTML: elements whose content isn't text, elements without an end, and blocks.
RAW = {"script", "style", "textarea", "title", "iframe"}
INERT = {"noscript", "template", "svg", "object", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: An open one of these ends where another of its kind starts or its parent ends.
CLOSES = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
WALLS = BLOCK - CLOSES
BOILERPLATE = {"nav", "footer", "aside", "form", "head", "dialog", "menu"}
#: Blocks that are paragraphs of what holds them.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "li", "dt", "dd", "blockquote", "pre", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption"}
#: Whole names of class, id or role that mark menus, adverts, sidebars and comments; some also as leading part.
MARKS = re.compile(
    r"^(?:ads?|adsbygoogle|sponsor\w*|banner|consent|popup|modal|newsletter|subscribe|sidebar|menu|nav|navigation|footer|related|toolbar|copyright|complementary|contentinfo|"
    r"header|masthead|(?:site|page)[-_](?:header|footer|navigation)|ads?[-_](?:banner|box|container|slot|unit|wrapper)|respond|commentlist|comments?[-_](?:area|block|box|container|feed|form|list|respond|section|thread|wrapper)|"
    r"(?:(?!has|no|with|show|hide)[a-z0-9]+[-_])*comments|(?:advert\w*|cookies?|breadcrumbs?|disqus|gdpr|navbar)(?:[-_].*)?)$"
)
HEADER = {"header", "masthead", "site-header", "page-header"}
#: Whole names that stand on menus and on articles alike: their words have a learned weight of their own.
HINTS = {"widget", "share", "social", "notice", "alert", "search", "login", "signup", "promo", "recommended", "replies", "comment"}
CONTENT = {"article", "main"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|([^<]+|<)", re.DOTALL)
#: The same where no tag can end any more.
LOOSE = re.compile(r"<!--.*|()()()([^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
INERT_TAG = re.compile(rf"<(/?)({'|'.join(sorted(INERT))})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.IGNORECASE)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
#: Weights where no labelled page speaks for a feature.
WORD, TAG, BOILER = 1.0, -0.25, -2.0
#: The least that a word of an article scores.
INSIDE = 0.1
#: Words that a block which isn't a paragraph must have of its own to be one of its parent's.
OWN_WORDS = 8


class Node:
    """An element: what it inherits, and what it says of itself until the page is read."""

    __slots__ = ("tag", "parent", "block", "above", "solid", "hard", "soft", "hint", "article", "main", "exempt", "holds", "boiler", "content", "inert", "loose", "free", "words", "own", "first", "last", "reach")

    def __init__(self, tag: str, parent: Node | None, names: list[str]) -> None:
        self.tag, self.parent = tag, parent
        up = parent or self
        self.block = self if parent is None or tag in BLOCK else up.block  # the nearest block
        self.above = self if parent is None or tag not in PROSE else up.above  # the nearest that isn't a paragraph
        self.solid = self
        self.article = tag == "article" or (parent is not None and up.article)
        self.main = tag == "main" or (parent is not None and up.main)
        self.content = self.article or self.main
        self.hard = (parent is not None and up.hard) or (tag in BOILERPLATE and tag != "form")
        self.inert = tag in INERT or (parent is not None and up.inert)
        inside = parent is not None and up.content
        named = any(MARKS.match(w) and not (inside and w in HEADER) for w in names)
        self.soft = tag == "form" or (tag == "header" and not inside) or named
        self.hint = next((w for w in names if w in HINTS), "")
        self.exempt = tag in CONTENT or tag in ("html", "body")
        self.holds = self.boiler = self.loose = self.free = False
        self.words, self.own, self.first, self.last, self.reach = 0, 0, -1, -1, -1

    def settle(self) -> None:
        """Boilerplate and hint, once it is known which elements hold the content."""
        up = self.parent
        self.exempt = self.exempt or self.holds
        self.boiler = self.hard or (self.soft and not self.exempt) or (up is not None and up.boiler)
        self.hint = "" if self.exempt else self.hint or (up.hint if up is not None else "")


def names(attributes: str) -> list[str]:
    """The names in class, id and role."""
    return [w for key, *value in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id", "role") for w in "".join(value).lower().split()]


def enclose(nodes: list[Node], events: list[tuple[str, str, Node, bool]]) -> None:
    """Frees boilerplate inside an article or main, and finds how far the paragraphs of a parent reach.

    A paragraph counts for its parent, and through sections for theirs; another
    block with enough words of its own counts for itself and its parent, and so
    does an outer article.
    """
    texts = [(i, node, len(value.split())) for i, (kind, value, node, _) in enumerate(events) if not kind and not node.boiler]
    for _, node, n in texts:
        node.words += n > 0
        node.block.own += n
    for i, node, n in texts:
        if not n:
            continue
        block = node.block
        holders = [] if block.tag in PROSE else [block]
        if block.parent is not None and (block.tag in PROSE or block.own >= OWN_WORDS):  # past the item of a list, the cell of a table
            holders.append(block.parent.above)
        for holder in holders:
            holder.first = i if holder.first < 0 else holder.first
            holder.last = i
    for node in reversed(nodes):
        up = node.parent
        if up is None:
            continue
        up.words += node.words
        if (node.tag == "section" or (node.tag == "article" and not up.article)) and node.first >= 0:
            up.first = node.first if up.first < 0 else min(up.first, node.first)
            up.last = max(up.last, node.last)
    at = {}
    for i, (_, _, node, _) in enumerate(events):
        at.setdefault(node, i)
    for node in nodes:
        up = node.parent
        if up is None:
            continue
        node.solid = node if node.words or node.content else up.solid  # past what wraps boilerplate only
        if node.boiler:
            node.free = up.free if up.boiler else up.solid.content or up.solid.first < at[node] < up.solid.last
        # How far the paragraphs reach, beside whose first this element starts.
        node.reach = max(up.reach, up.last if 0 <= up.first < at[node] else -1)


def enclosed(i: int, node: Node) -> bool:
    """Whether event ``i`` of a node costs nothing."""
    if node.boiler:
        return node.free
    return node.content or i < node.reach or 0 <= node.first < i < node.last


class Stack:
    """Open elements, with the places of each tag, so that none is searched for."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {"": [0]}
        self.walls: list[int] = []  # blocks that an open paragraph doesn't end behind
        self.loose: list[int] = []

    def push(self, node: Node) -> None:
        i = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(i)
        if node.tag in WALLS:
            self.walls.append(i)
        if node.loose:
            self.loose.append(i)

    def cut(self, at: int) -> None:
        """Closes all from place ``at`` on."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        while self.walls and self.walls[-1] >= at:
            self.walls.pop()
        while self.loose and self.loose[-1] >= at:
            self.loose.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, -1 if none."""
        return places[-1] if (places := self.places.get(tag)) else -1


def ended(html: str) -> set[int]:
    """Where the inert elements start that have an end tag."""
    out: set[int] = set()
    open_at: dict[str, list[int]] = {}
    for m in INERT_TAG.finditer(html):
        starts = open_at.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[0].endswith("/>"):
                starts.append(m.start())
        elif starts:
            out.add(starts.pop())
    return out


def read_page(html: str) -> Iterator[tuple[str, str, bool, bool, bool, bool]]:
    """(kind, value, boilerplate, content, block, free): kind "tag" or what encloses a text.

    Names never make boilerplate of html, body, article, main or what holds a
    main or an outer article, and neither does a form around them. What the content
    goes on behind is free. An inert element without an end
    tag ends where a block starts or its parent ends.
    """
    root = Node("", None, [])
    nodes, stack, events = [root], Stack(root), []  # events: ("tag" or "", value, node, block)
    whole: set[int] | None = None
    pos, end = 0, len(html)
    last_close, endless = html.rfind(">"), set()
    while pos < end:
        # Behind the last ">" no tag can end: no pattern needs to look for one.
        m = TOKEN.match(html, pos) if pos < last_close else LOOSE.match(html, pos)
        pos = m.end()
        if m[4] is not None:
            events.append(("", m[4], stack.nodes[-1], False))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = stack.last(tag)
            node = stack.nodes[-1]
            if place >= 0 and node.inert and not stack.nodes[place].inert:
                node = stack.nodes[place]
            events.append(("tag", "/" + tag, node, tag in BLOCK))
            if place >= 0:
                stack.cut(place)
            continue
        closed = html.startswith("/>", pos - 2)
        if tag in RAW:
            stop = None if tag in endless or (closed and tag == "iframe") else RAW_END[tag].search(html, pos)
            if stop is None and not closed:
                endless.add(tag)
            pos = stop.end() if stop else pos if tag == "iframe" else end
            node = Node(tag, stack.nodes[-1], [])
            node.hard = True
            nodes.append(node)
            events.append(("tag", tag, node, tag in BLOCK))
            continue
        if tag in BLOCK:  # a block ends an open paragraph and what is inside it
            open_p = max(stack.last("p"), stack.last(tag) if tag in CLOSES else -1)
            if open_p >= 0 and not (stack.walls and stack.walls[-1] > open_p):
                stack.cut(open_p)
            if stack.loose:
                stack.cut(stack.loose[0])
        up = stack.nodes[-1]
        node = Node(tag, up, names(m[3]) if m[3] else [])
        if not up.hard and ((tag == "main" and not up.main) or (tag == "article" and not up.article)):
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        nodes.append(node)
        events.append(("tag", tag, node, tag in BLOCK))
        if tag in INERT:
            whole = ended(html) if whole is None else whole
            node.hard, node.loose = True, m.start() not in whole
        if tag not in VOID and not closed:
            stack.push(node)
    for node in nodes:
        node.settle()
    enclose(nodes, events)
    for i, (kind, value, node, block) in enumerate(events):
        yield kind or ("." + node.hint if node.hint else node.tag), value, node.boiler, node.content, block and not node.inert, enclosed(i, node)


def feature(kind: str, value: str, boiler: bool) -> str:
    if kind == "tag":
        return "tag " + value
    return ("in boilerplate " if boiler else "in ") + kind


def count_page(html: str) -> Counter:
    """Words by feature and by whether they are inside the content; tags by whether they are of it."""
    out: Counter = Counter()
    for kind, value, boiler, content, *_ in read_page(html):
        if kind == "tag":
            out[feature(kind, value, boiler), content] += not boiler
        else:
            out[feature(kind, value, boiler), content] += len(value.split())
    return out


def learn_weights(pages: DataFrame, id_col: str, html_col: str, max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Log odds of each feature on the labelled pages; words score up to 2, tags below 0, boilerplate at most 0."""
    ids = bounded(pages.select(F.col(id_col).alias("_id")).filter("_id is not null"), F.col("_id").cast("string"), 2 * max_labelled)
    labelled = pages.filter(F.col(html_col).rlike("(?i)<(?:article|main)[\\s>]"))
    sample = labelled.select(F.col(html_col).alias("html"), F.col(id_col).alias("_id")).join(F.broadcast(ids.distinct()), "_id")
    sample = sample.orderBy(F.xxhash64(F.col("_id").cast("string")), "html").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for x in batch.column(0):
                total.update(count_page(x.as_py()))
            rows = [(f, c, n) for (f, c), n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["f", "c", "n"])

    counted = sample.select("html").mapInArrow(run, "f string, c boolean, n long").groupBy("f").agg(F.sum(F.when(F.col("c"), F.col("n"))).alias("inside"), F.sum(F.when(~F.col("c"), F.col("n"))).alias("outside"))
    weights = {}
    for row in counted.collect():
        odds = math.log((row.inside or 0) + 1) - math.log((row.outside or 0) + 1)
        if row.f.startswith("tag "):
            weights[row.f] = max(-3.0, min(-0.05, odds / 4 + TAG))
        elif row.f.startswith("in boilerplate "):
            weights[row.f] = max(BOILER, min(0.0, odds))
        else:
            weights[row.f] = max(-1.0, min(2.0, odds))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous scores with the highest positive sum, the first of equal ones, in one scan."""
    best, best_from, best_to, run, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, best_from, best_to = run, start, i + 1
    return best_from, best_to


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, one line each; what is enclosed in it costs nothing."""
    pieces = []  # (text or None for the end of a block, boilerplate, score)
    for kind, value, boiler, content, block, free in read_page(html or ""):
        f = feature(kind, value, boiler)
        if kind == "tag":
            score = 0.0 if free else min(TAG, weights.get(f, TAG)) if boiler else weights.get(f, TAG)
            pieces.append((None if block else " " if value == "br" else "", boiler, score))
            continue
        score = weights.get(f, BOILER if boiler else WORD)
        if free:
            score = 0.0 if boiler else max(INSIDE if content else 0.0, score)
        pieces.append((value, boiler, score * len(value.split())))
    best_from, best_to = best_region([score for _, _, score in pieces])
    lines, line = [], []
    for text, boiler, _ in [*pieces[best_from:best_to], (None, False, 0.0)]:
        if text is None:
            if joined := " ".join(chars.unescape("".join(line)).split()):
                lines.append(joined)
            line = []
        elif not boiler:
            line.append(text)
    return "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, kept columns, text, n_chars)."""
    weights = learn_weights(pages, id_col, html_col, max_labelled)
    own = pages.select(html_col, id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(0)]
            cols = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[1:], "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(run, f"{fields}, text string, n_chars long")
