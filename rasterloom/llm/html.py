"""Main text of web pages by tree scoring.

A page becomes a tree of elements; runs of text between block boundaries are
paragraphs of their innermost block.  A paragraph earns points for its length
and its commas and passes them to its ancestors, less with each step up; only
article and main, which say what they are, get those of all paragraphs inside in
full.  An element's points are discounted by the share of its text that is in
links, and if its class or id hints at something else.  The best container is
kept with those of its siblings that score well too.  Left out are elements whose
tag, role, or whole class or id says that they are not the article, and lists
that look like menus.

Null and empty html give an empty text, as do pages without text.  Every row
gives a row; repeated rows each give theirs, and an empty table an empty result.
Unclosed and cut-off markup is closed where it ends.  Other columns are not read.
Very long or deeply nested pages take time in proportion to their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, record_batch, slices, table, texts

_CHUNK = 1 << 20
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "label", "canvas", "audio", "video", "map"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "ruby", "rb", "rt", "rp", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "mpadded", "semantics"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Parts of class and id names of what is no article, and words that stand beside them.
_NAME = re.compile(r"(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|paywall|sidebars?|rail|widgets?|comments?|respond|repl(?:y|ies)|disqus|shar(?:e|ing)|social|recommend\w*|related|search|newsletters?|subscribe|signup|login|menus?|nav\w*|topnav|masthead|footers?|breadcrumbs?|pagination|pager|toolbars?|skip|copyright|disclaimer)", re.I)
_BESIDE = re.compile(r"(?:\d+|[a-z]|left|right|top|bottom|upper|lower|main|site|page|post|posts|article|articles|stor(?:y|ies)|news|content|links?|items?|reading|box|block|bar|buttons?|area|section|container|wrap|wrapper|inner|outer|panel|slot|unit|side|list|count|form|field|input|icons?|header|head|title|body|user|reader|global|primary|secondary|mobile|desktop|sticky|fixed|more|up|in|only|print|tags?|js|the|us|media)", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=\D)(?=\d)")
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LISTS = {"ul", "ol", "dl", "table"}
_SHARE, _LEAST, _REACH, _HINT = 0.2, 10.0, 8, 0.25


class _Node:
    __slots__ = ("tag", "parent", "up", "drop", "hint", "level", "block", "group", "points", "inside", "chars", "linked", "container", "below")

    def __init__(self, tag: str, parent: _Node | None, drop: bool, hint: bool):
        self.tag, self.parent, self.drop, self.hint = tag, parent, drop, hint
        self.level = parent.level + 1 if parent else 0
        self.up = parent.block if parent else None  # the next block around
        self.block = self.up if parent and tag in _INLINE else self
        self.group = self if tag in _LISTS else parent.group if parent else None
        self.points, self.inside, self.chars, self.linked, self.container = 0.0, 0.0, 0, 0, False
        self.below: _Node | None = None

    def score(self) -> float:
        if not self.chars:
            return 0.0
        points = self.inside if self.tag in ("article", "main") else self.points
        return points * (1 - self.linked / self.chars) * (_HINT if self.hint else 1)


def _named(value: str, topics: bool) -> tuple[bool, bool]:
    """(a class or id that is wholly a name of what is no article, one that only holds such a name); topics: what sections and headings may be about does not count."""
    whole = some = False
    for token in value.split():
        parts = [p for p in _PARTS.split(token) if p]
        hits = [bool(_NAME.fullmatch(p)) and not (topics and p.lower() in ("related", "search")) for p in parts]
        if any(hits):
            some = True
            whole = whole or all(hit or _BESIDE.fullmatch(p) for hit, p in zip(hits, parts, strict=True))
    return whole, some


def _judged(tag: str, rest: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element goes, and whether its names hint that it might be no article."""
    if tag in _DROP_TAGS or tag == "header" and not inside_article:
        return True, False
    hint = False
    for m in _ATTRIBUTE.finditer(rest) if rest else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            whole, some = _named(value, inside_article and (tag == "section" or tag in _HEADINGS))
            if whole:
                return True, True
            hint = hint or some
        elif name == "role" and value.lower() in _DROP_ROLES or name == "hidden" and not value.startswith("until") or name == "aria-hidden" and value.lower() == "true":
            return True, hint
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, hint
    return False, hint


def _blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, parents first, and (innermost block, text, characters of it in links) of each run of text that isn't dropped."""
    root = _Node("#root", None, False, False)
    stack, nodes, out = [root], [root], []
    text: list[str] = []
    linked = links = articles = 0
    open_tags: Counter[str] = Counter()

    def end_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            node = stack[-1].block
            if joined and not node.drop:
                out.append((node, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal links, articles
        while len(stack) > i:
            tag = stack.pop().tag
            open_tags[tag] -= 1
            links -= tag == "a"
            articles -= tag in ("article", "main")

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].drop:
            said = html.unescape(raw) if "&" in raw else raw
            text.append(said)
            if links:
                linked += len(" ".join(said.split()))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in _INLINE:
            end_block()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag == "br":
            say(" ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in _CLOSES:
            same, stop = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in same:
                    pop_to(i)
                    break
        elif tag not in _INLINE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":  # a block ends an open paragraph
                    pop_to(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        parent = stack[-1]
        drop, hint = (True, False) if parent.drop else _judged(tag, m[3], articles > 0)
        stack.append(_Node(tag, parent, drop, hint))
        nodes.append(stack[-1])
        open_tags[tag] += 1
        links += tag == "a"
        articles += tag in ("article", "main")
    end_block()
    return nodes, out


def extract(page: str | None) -> str:
    """Main text of a page, blocks joined by two newlines; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = _blocks(page)
    nodes = [x for x in nodes if x.block is x]
    for node, _, _ in blocks:
        while (node := node.up) is not None and not node.container:
            node.container = True
    for node, text, linked in blocks:
        n = len(text)
        points = 1 + min(n / 100, 3) + (n > 300) * min((n - 300) / 1000, 10) + text.count(",")
        if n < 25 or linked > 0.5 * n:
            points = 0
        node.chars += n
        node.linked += linked
        own = node if node.container or node.up is None else node.up  # a paragraph itself is no container
        own.container = True
        own.inside += points
        for step in range(_REACH):
            own.points += points if step == 0 else points / 2 if step == 1 else points / (3 * step)
            own = own.up
            if own is None:
                break
    for node in reversed(nodes[1:]):
        node.up.chars += node.chars
        node.up.linked += node.linked
        node.up.inside += node.inside
    best = max((x for x in nodes if x.chars and x.container), key=lambda x: (x.score(), x.tag in ("article", "main"), x.level), default=None)
    if best is None:
        return ""
    named = best.tag in ("article", "main")
    top, least = best.up, max(_LEAST, _SHARE * best.score())
    for node in nodes[1:]:
        node.below = node if node.up is top else node.up.below  # the child of top that it is in

    def kept(below: _Node | None) -> bool:
        if top is None or below is best:
            return True
        if below is None or named:
            return False
        return below.linked < 0.5 * below.chars if below.tag == "p" else below.score() >= least

    items = Counter(id(node.group) for node, text, linked in blocks if linked > 0.5 * len(text))  # linked blocks of each list or table

    def menu(node: _Node) -> bool:
        """Whether a block that is mostly links stands in a list or table that is, too; outside an article any container counts.  Single items, headings and paragraphs don't."""
        if node.tag == "p" or node.tag in _HEADINGS:
            return False
        if node.group is None:
            return not named
        return items[id(node.group)] > 1 and node.group.linked > 0.5 * node.group.chars

    return "\n\n".join(text for node, text, linked in blocks if kept(node.below) and not (linked > 0.5 * len(text) and menu(node)))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(byte_sizes(b.column(2)).tolist(), _CHUNK):
                part = b.slice(i, j - i)
                found = [extract(t) for t in texts(part.column(2))]
                yield record_batch({"page_id": part.column(0), "url": part.column(1), "text": found, "n_chars": list(map(len, found))}, schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
