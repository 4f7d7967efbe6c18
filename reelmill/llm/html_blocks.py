"""HTML to leaf blocks: the text between block-level tags, with its ancestors and links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

#: Elements that end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page. What svg and math hold is text, but for their titles.
SKIPPED = frozenset("script style noscript template title textarea object canvas".split())
#: Elements that close an open one of the same kind, and what such a search does not cross.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
MARKED = re.compile(r"<!\[[^>]*>?")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    path: tuple  # of (tag, hints) from the root; hints are words of class, id and role
    text: str
    link_chars: int
    label: int | None
    nodes: tuple = ()  # a number for each element of the path


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.links: list[str] = []
        self.title = ""
        self.open: list[tuple[str, tuple, int | None, int]] = []
        self.made = 0
        self.text: list[str] = []
        self.link_chars = self.anchors = 0
        self.skip: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not asked for."""
        return j

    def end_block(self) -> None:
        if not self.text:
            self.link_chars = self.anchors = 0
            return
        text = " ".join("".join(self.text).split())
        if text:
            path, label, nodes = [], None, []
            for tag, hints, y, node in self.open:
                path.append((tag, hints))
                nodes.append(node)
                label = label if y is None else y
            self.blocks.append(Block(tuple(path), text, min(self.link_chars, len(text)), label, tuple(nodes)))
        self.text, self.link_chars, self.anchors = [], 0, 0

    def close(self) -> None:
        super().close()
        self.end_block()

    def _pop(self, tag: str, fence: set | frozenset = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in fence:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            if tag == self.skip[0]:
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag == "a":
            self.anchors += 1
            self.links += [v for k, v in attrs if k == "href" and v]
        elif tag in ("br", "wbr", "img"):
            self.text.append(" ")
        elif tag == "hr":
            self.end_block()
        elif tag in BLOCK_TAGS:
            self.end_block()
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            if tag in SIBLINGS:
                self._pop(tag, SIBLINGS[tag])
            self.made += 1
            if not attrs:
                self.open.append((tag, (), None, self.made))
                return
            named = dict(attrs)
            words = " ".join(named.get(k) or "" for k in ("class", "id", "role"))
            hints = {w.lower() for w in HINT.findall(words)}
            if "hidden" in named or "none" in (named.get("style") or ""):
                hints.add("hidden")
            label = named.get("data-y")
            self.open.append((tag, tuple(sorted(hints)), int(label) if label in ("0", "1") else None, self.made))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS or tag in SKIPPED:
            self.end_block()
        else:
            self.handle_starttag(tag, attrs)
            if tag == "a":
                self.anchors -= 1

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
        elif tag == "a":
            self.anchors = max(0, self.anchors - 1)
        elif tag in BLOCK_TAGS:
            self.end_block()
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        if self.skip and self.skip[0] == "title":
            self.title += data
        if self.skip:
            return
        self.text.append(data)
        if self.anchors:
            self.link_chars += len(data.strip())


def parse(html: str | None) -> _Blocks:
    """The page's blocks in page order, its links and title. White space in a block is one space; references are decoded."""
    parser = _Blocks()
    parser.feed(MARKED.sub(" ", html or ""))
    parser.close()
    return parser
