"""HTML as tags and text in one pass: any string is read, in time linear in its length.

What is scanned is consumed, and what could be sought in vain more than once is
looked up before: the last place of each closing mark is known from the start.

What is malformed is text: a ``<`` that begins no tag, comment or declaration; a
tag that the page's end, or another ``<`` outside of quotes, breaks off (its text
goes up to there); a comment, declaration or end tag without its closing mark (its
``<`` is text, and what follows is read on). A quote that is never closed is a
character of its value. A declaration or instruction (``<!``, ``<?``), and an end
tag without a name, goes up to the next ``>`` and is left out, ``<![CDATA[``
included. ``script`` and ``style`` are left out up to their end tags, or up to the
page's end; ``title`` and ``textarea`` hold text only, if they are closed.
References to characters are resolved; a number of any length that names none
stands for U+FFFD.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

_NAME = re.compile(r"[a-zA-Z][^\s/><]*+")
_SPACE, _SPACE_OR_SLASH = re.compile(r"\s*+"), re.compile(r"[\s/]*+")
_ATTRIBUTE, _BARE = re.compile(r"[^\s/>=<]++"), re.compile(r"[^\s><]*+")
_LONG_NUMBER = re.compile(r"&#(?:([0-9]{7,}+)|[xX]([0-9a-fA-F]{6,}+));?")
#: Elements without markup inside, and whether their text counts.
RAW = {"script": False, "style": False, "title": True, "textarea": True}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _number(found: re.Match) -> str:
    digits = (found[1] or found[2]).lstrip("0") or "0"
    value = int(digits, 10 if found[1] else 16) if len(digits) <= 7 else 1 << 30
    return f"&#{value};" if value <= 0x10FFFF else "�"


def unescaped(text: str) -> str:
    return html.unescape(_LONG_NUMBER.sub(_number, text)) if "&" in text else text


class _Page:
    def __init__(self, page: str):
        self.page = page
        self.last = {mark: page.rfind(mark) for mark in (">", "-->", "'", '"')}
        #: Raw elements of which the page has no further end tag.
        self.unclosed: set[str] = set()

    def closing(self, mark: str, at: int) -> int:
        """Where ``mark`` comes next from ``at`` on, -1 if it does not."""
        return self.page.find(mark, at) if at <= self.last[mark] else -1

    def tag(self, at: int) -> tuple[dict[str, str | None] | None, bool, int]:
        """Attributes of a start tag from behind its name on, whether it closes itself, and where it ends; no attributes if it breaks off there."""
        page, found, size = self.page, {}, len(self.page)
        while True:
            begin = at
            at = _SPACE_OR_SLASH.match(page, at).end()
            if at == size or page[at] == "<":
                return None, False, at
            if page[at] == ">":
                return found, page[at - 1] == "/" and at > begin, at + 1
            name = _ATTRIBUTE.match(page, at)
            if not name:  # a stray equals sign
                at += 1
                continue
            at, value = name.end(), None
            equals = _SPACE.match(page, at).end()
            if page[equals : equals + 1] == "=":
                at = _SPACE.match(page, equals + 1).end()
                quote = page[at : at + 1]
                end = self.closing(quote, at + 1) if quote and quote in "'\"" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found[name[0].lower()] = value and unescaped(value)


def scan(page: str, opened: Callable[[str, dict, bool], None], closed: Callable[[str], None], text: Callable[[str], None]) -> None:
    """Calls ``opened`` (name, attributes, whether it closes itself), ``closed`` (name) and ``text`` in the order of ``page``."""
    held = _Page(page)
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            text(unescaped(page[at:begin]))
        if begin == size:
            return
        at = _markup(held, begin, opened, closed, text)


def _markup(held: _Page, begin: int, opened, closed, text) -> int:
    """Reads what begins with the ``<`` at ``begin``; where it ends."""
    page = held.page
    name = _NAME.match(page, begin + 1)
    if name:
        attributes, alone, end = held.tag(name.end())
        if attributes is None:
            text(unescaped(page[begin:end]))
            return end
        kind = name[0].lower()
        opened(kind, attributes, alone)
        return _raw(held, kind, end, closed, text) if kind in RAW and not alone else end
    end = -1
    if page.startswith("<!--", begin):
        end = held.closing("-->", begin + 2)
        end += 2 if end >= 0 else 0
    elif page.startswith(("<!", "<?", "</"), begin):
        end = held.closing(">", begin + 2)
        name = _NAME.match(page, begin + 2) if page[begin + 1] == "/" and end >= 0 else None
        if name:
            closed(name[0].lower())
    if end < 0:
        text("<")
        return begin + 1
    return end + 1


def _raw(held: _Page, kind: str, at: int, closed, text) -> int:
    """Reads an element without markup from behind its start tag on, its end tag left to be read."""
    found = None if kind in held.unclosed else _RAW_END[kind].search(held.page, at)
    if found:
        if RAW[kind] and found.start() > at:
            text(unescaped(held.page[at : found.start()]))
        return found.start()
    held.unclosed.add(kind)
    return at if RAW[kind] else len(held.page)
