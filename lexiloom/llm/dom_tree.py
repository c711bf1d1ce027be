"""A small, forgiving HTML reader: the tree of elements and texts that the page model labels."""

from __future__ import annotations

import html
import re
from functools import cache

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style title template iframe svg textarea select button".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_SCOPE = frozenset("ul ol dl table div section article body".split())
#: Open elements that the start of a block looks at; all others it passes over.
_SEEN = BLOCK | _SCOPE | frozenset(_ENDS)


class Open:
    """The open elements, outermost first; of each its node, and where those of `_SEEN` lie."""

    def __init__(self, page: Page) -> None:
        self.page, self.nodes, self.seen, self.count = page, [], [], {}

    def push(self, node: int) -> None:
        tag = self.page.tag[node]
        if tag in _SEEN:
            self.seen.append(len(self.nodes))
        self.nodes.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1

    def cut(self, at: int) -> None:
        """End the elements from place `at` on."""
        for node in self.nodes[at:]:
            self.count[self.page.tag[node]] -= 1
        del self.nodes[at:]
        while self.seen and self.seen[-1] >= at:
            self.seen.pop()

    def close(self, name: str) -> None:
        """End the innermost element of the name, if one is open, and what is open in it."""
        if self.count.get(name, 0):
            at = len(self.nodes) - 1
            while self.page.tag[self.nodes[at]] != name:
                at -= 1
            self.cut(at)

    def begin_block(self, name: str) -> None:
        """End what the start of a block element ends: an open paragraph, a sibling item or cell."""
        while self.seen:
            at = self.seen[-1]
            tag = self.page.tag[self.nodes[at]]
            if tag != "p" and name not in _ENDS.get(tag, ()):
                return
            self.cut(at)


class Page:
    """Nodes in page order: parent, tag and cue words of each; texts have the tag `#text`."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.cues: list[tuple[str, ...]] = []
        self.text: list[str] = []
        self.block: list[int] = []

    def add(self, parent: int, tag: str, cues: tuple[str, ...], text: str, block: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.cues.append(cues)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def cue_words(attributes: str) -> tuple[str, ...]:
    """Lower-case words of the class, id and role attributes."""
    if "=" not in attributes:
        return ()
    found: list[str] = []
    for m in _NAMES.finditer(attributes):
        found += _WORDS.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(dict.fromkeys(found))


def read_page(source: str | None) -> Page:
    """The tree of a page; whatever is not closed ends with its parent."""
    page = Page()
    stack = Open(page)
    stack.push(page.add(-1, "#page", (), "", 0))
    if not source:
        return page
    at = block = 0
    while (m := _TOKEN.search(source, at)) is not None:
        if m.start() > at:
            _text(page, stack, source[at : m.start()], block)
        at = m.end()
        name = m[2]
        if name is None:
            if m.group().startswith("<![CDATA["):
                _text(page, stack, html.escape(m.group()[9:].removesuffix("]]>")), block)
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                block += 1
            stack.close(name)
            continue
        if name in HIDDEN:
            # What looks like a comment or a tag inside is neither: reading goes on behind the element's end.
            if not m[3].rstrip().endswith("/"):
                end = _end_of(name).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in BLOCK:
            block += 1
            stack.begin_block(name)
        if name == "br":
            _text(page, stack, " ", block, True)
        elif name not in VOID:
            node = page.add(stack.nodes[-1], name, cue_words(m[3]), "", block)
            if not m[3].rstrip().endswith("/"):
                stack.push(node)
    if at < len(source):
        _text(page, stack, source[at:], block)
    return page


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE)


def _text(page: Page, stack: Open, raw: str, block: int, force: bool = False) -> None:
    parent = stack.nodes[-1]
    if page.tag[-1] == "#text" and page.parent[-1] == parent and page.block[-1] == block:
        page.text[-1] += raw
    elif force or raw.strip() or (page.tag[-1] == "#text" and page.block[-1] == block) or page.block[-1] == block:
        page.add(parent, "#text", (), raw, block)


def block_texts(page: Page, chosen: list[bool]) -> list[str]:
    """Texts of the blocks that the chosen text nodes make up, in page order, none empty."""
    out: list[str] = []
    parts: list[str] = []
    last = -1
    for i, tag in enumerate(page.tag):
        if tag == "#text" and chosen[i]:
            if page.block[i] != last:
                out.append("".join(parts))
                parts = []
                last = page.block[i]
            parts.append(page.text[i])
    out.append("".join(parts))
    clean = (" ".join((html.unescape(t) if "&" in t else t).split()) for t in out)
    return [t for t in clean if t]
