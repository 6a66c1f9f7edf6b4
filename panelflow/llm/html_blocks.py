"""HTML pages as sequences of leaf blocks with their tag paths."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split())
SILENT = frozenset("script style noscript template title head iframe object svg math canvas select option button textarea".split())
#: Elements that can stand in a head; any other start tag ends an open one.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
_NAMES = re.compile(r"[a-z]+")
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.words: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[tuple[str, ...], str, float]] = []

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text and not any(tag in SILENT for tag, _ in self.open):
                path = tuple(name for _, names in self.open for name in names)
                self.blocks.append((path, text, min(1.0, self.linked / len(text))))
        self.words, self.linked = [], 0

    def _end_head(self, tag: str = "") -> None:
        """The end tag of a head may be left out; what stands in its noscript or template does not end it, but a body does."""
        names = [name for name, _ in self.open]
        if "head" in names and tag not in IN_HEAD:
            at = names.index("head")
            if tag == "body" or not {"noscript", "template"} & set(names[at:]):
                self.flush()
                del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag == "br":
            self.words.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self._close_implied(tag)
        if tag not in VOID:
            names = [tag]
            for key, value in attrs:
                if key in ("class", "id", "role") and value:
                    names += _NAMES.findall(value.lower())
            self.open.append((tag, tuple(names)))

    def _close_implied(self, tag: str) -> None:
        ends = CLOSES.get(tag, set()) | {"p"}
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in ends:
                del self.open[i:]
                return
            if name not in INLINE:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in INLINE:
                    self.flush()
                    del self.open[i:]
                else:
                    del self.open[i]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        self.words.append(data)
        if any(tag == "a" for tag, _ in self.open):
            self.linked += len(data)


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(names on the tag path, text, share in links) of every block with text, in page order.

    A block ends where an element that is not inline begins or ends.  White
    space is one space; character references are decoded; scripts, styles,
    the head, comments and form controls have no text.  A head without an end
    tag ends at the body, or at the first text or element that cannot stand in it.
    """
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks
