"""Tolerant HTML scanning into leaf text blocks with their tag paths."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from html import unescape

#: Elements that begin and end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements without content; those whose content is never markup and runs to the page's end if unclosed;
#: those whose content is hidden if they are closed (unclosed ones hide nothing).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea".split())
HIDDEN_TAGS = frozenset("template iframe svg".split())
#: Elements that a start tag of the same family closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT_NAMES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


@dataclass
class Block:
    """Text of a leaf block, how much of it is linked, and of its path: the marks of all entries, innermost tag, depth."""

    marks: tuple[int, ...]
    tag: str
    depth: int
    text: str
    linked: int


def names_of(tag: str, attributes: str) -> str:
    """One path entry: the tag and the words of its class, id and role."""
    if not attributes or not ("class" in attributes or "id" in attributes or "role" in attributes.lower() or "CLASS" in attributes or "ID" in attributes):
        return tag
    words = [w for m in ATTRIBUTE.finditer(attributes) for w in SPLIT_NAMES.split((m[2] or m[3] or m[4] or "").lower()) if w]
    return " ".join([tag, *dict.fromkeys(words)])


class OpenElements:
    """The open elements, with what a block or a tag asks of them at hand, whatever their number."""

    def __init__(self, marks_of: Callable[[str], tuple[int, ...]]):
        self.marks_of = marks_of
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.marks: dict[int, int] = {}

    def push(self, tag: str, entry: str) -> None:
        marks = self.marks_of(entry)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        for k in marks:
            self.marks[k] = self.marks.get(k, 0) + 1
        self.stack.append((tag, marks))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, marks = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            for k in marks:
                self.marks[k] -= 1
                if not self.marks[k]:
                    del self.marks[k]

    def last(self, tag: str) -> int | None:
        got = self.places.get(tag)
        return got[-1] if got else None

    def first_above(self, tags: Iterable[str], scopes: Iterable[str]) -> int | None:
        """Lowest open element of tags above the innermost of scopes."""
        floor = max((self.places[s][-1] for s in scopes if self.places.get(s)), default=-1)
        found = []
        for tag in tags:
            own = self.places.get(tag) or []
            at = bisect.bisect_right(own, floor)
            if at < len(own):
                found.append(own[at])
        return min(found, default=None)


def closed_at(html: str, tag: str) -> dict[int, int]:
    """Start of every closed element of a tag -> end of its closing tag, nested ones too."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>", html, re.I):
        if m[1]:
            if opened:
                out[opened.pop()] = m.end()
        elif not m[0].endswith("/>"):
            opened.append(m.start())
    return out


def blocks_of(html: str, marks_of: Callable[[str], tuple[int, ...]] = lambda entry: ()) -> list[Block]:
    """Leaf blocks in page order; character references decoded, white space collapsed.

    marks_of gives the marks of a path entry (a tag and the words of its class, id and role)."""
    out: list[Block] = []
    open_ = OpenElements(marks_of)
    parts: list[str] = []
    hidden: dict[str, dict[int, int]] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                stack = open_.stack
                out.append(Block(tuple(open_.marks), stack[-1][0] if stack else "", len(stack), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    at, end = 0, html.rfind(">") + 1  # no tag ends later
    while True:
        m = TOKEN.search(html, at, end) if at < end else None
        text = html[at : m.start() if m else len(html)]
        if not m and "<!--" in text:
            text = text[: text.index("<!--")]
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if open_.places.get("a"):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # an open comment
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_.last(tag)
            if tag in BLOCK_TAGS:
                flush()
                if depth is not None:
                    open_.pop_to(depth)
            elif depth is not None and not (open_.blocks and open_.blocks[-1] > depth):
                open_.pop_to(depth)
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            if not close:
                break
            at = close.end()
            continue
        if tag in HIDDEN_TAGS:
            if tag not in hidden:
                hidden[tag] = closed_at(html, tag)
            at = max(at, hidden[tag].get(m.start(), at))
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK_TAGS:
            flush()
            depth = open_.first_above({"p"} | CLOSES.get(tag, set()), SCOPES)
            if depth is not None:
                open_.pop_to(depth)
        if tag not in VOID_TAGS:
            open_.push(tag, names_of(tag, m[3]))
    flush()
    return out
