"""Pages as trees of block elements and blocks of text.

A small reader of tag soup: it closes elements that HTML lets stand open,
ignores ends that match nothing, and skips what no reader sees (head, scripts,
styles, form fields). Its work is linear in the page, however it nests.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Names of HTML elements.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style textarea title iframe noembed noframes noscript template svg select datalist button object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input svg button select textarea script style noscript template iframe object audio video canvas datalist".split()
)
#: An element that a new one of the same kind ends, and what stops the search.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",)),
}
#: An open paragraph ends before these.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?P<end>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|/(?=[^A-Za-z])[^>]*+(?:>|\Z)|(?P<start>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^=>]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")


@dataclass
class Page:
    """Nodes in page order: the root, block elements, and blocks of text, whose
    tag is ``#text``. A node's subtree is what lies before its ``end``."""

    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _attributes(raw: str) -> tuple[str, bool]:
    """The words of class, id, role and label, and whether it is hidden."""
    names, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), html.unescape("".join(values))
        if key in ("class", "id", "role", "aria-label", "itemprop"):
            names.append(value)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            hidden = True
    return " ".join(names), hidden


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[tuple[str, int]] = []  # open elements: tag, node or -1
        self.at: dict[str, list[int]] = {}  # by tag, where it is open
        self.nodes: list[int] = []
        self.unseen = self.links = 0
        self.buffer: list[tuple[str, bool]] = []
        self.node("#root", "", False)
        self.nodes.append(0)

    def node(self, tag: str, names: str, hidden: bool, text: str = "", linked: int = 0) -> int:
        p = self.page
        up = self.nodes[-1] if self.nodes else -1
        for column, value in ((p.tag, tag), (p.names, names), (p.hidden, hidden), (p.parent, up), (p.depth, len(self.nodes)), (p.end, len(p.tag) + 1), (p.text, text), (p.linked, linked)):
            column.append(value)
        return len(p.tag) - 1

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(t for t, _ in self.buffer).split())
            if text:
                self.node("#text", "", False, text, min(len(text), sum(len(t.strip()) for t, linked in self.buffer if linked)))
            self.buffer.clear()

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        while len(self.stack) > to:
            tag, node = self.stack.pop()
            self.at[tag].pop()
            if node >= 0:
                self.flush()
                self.nodes.pop()
                self.page.end[node] = len(self.page.tag)
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"

    def words(self, raw: str) -> None:
        if not raw:
            return
        if self.at.get("head") and not raw.isspace() and self.stack[-1][0] == "head":
            self.close(self.at["head"][-1])
        if not self.unseen:
            self.buffer.append((html.unescape(raw) if "&" in raw else raw, self.links > 0))

    def start(self, tag: str, raw: str) -> None:
        if self.at.get("head") and tag not in IN_HEAD and tag != "head":
            self.close(self.at["head"][-1])
        if tag in ENDS_P and self.at.get("p"):
            self.close(self.at["p"][-1])
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.close(len(self.stack) - 1)
        if tag in ENDS:
            same, within = ENDS[tag]
            found = self.last(same)
            if found > self.last(within):
                self.close(found)
        if tag == "a" and self.at.get("a") and self.at["a"][-1] == len(self.stack) - 1:
            self.close(len(self.stack) - 1)
        if tag == "br":
            self.buffer.append((" ", False))
        if tag in INLINE or tag in UNSEEN:
            node = -1
        else:
            self.flush()
            if tag in VOID or self.unseen:
                return
            node = self.node(tag, *_attributes(raw))
        if tag in VOID:
            return
        if node >= 0:
            self.nodes.append(node)
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def ended(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append((" ", False))
        elif tag in ("body", "html"):
            self.flush()
        elif self.at.get(tag):
            self.close(self.at[tag][-1])
        elif tag not in INLINE:
            self.flush()


def read(page: str | None) -> Page:
    """The page's tree; of a null page, the root alone."""
    page = page or ""
    reader, at = _Reader(), 0
    while found := _TAG.search(page, at):
        reader.words(page[at : found.start()])
        at = found.end()
        if found["start"]:
            tag = found["start"].lower()
            if tag in ("html", "body"):
                reader.close(reader.at["head"][-1]) if reader.at.get("head") and tag == "body" else None
                continue
            reader.start(tag, found["attributes"])
            if tag in RAW:
                over = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
                at = over.start() if over else len(page)
            elif tag == "plaintext":
                reader.words(page[at:])
                at = len(page)
        elif found["end"]:
            reader.ended(found["end"].lower())
    reader.words(page[at:])
    reader.close(0)
    reader.flush()
    reader.page.end[0] = len(reader.page.tag)
    return reader.page
