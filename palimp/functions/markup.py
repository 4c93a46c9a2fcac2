"""HTML in parts, as browsers read it: unquoted and unclosed values, entities, raw text, comments.

One forward scan, linear in the length of the page. Parts keep their offsets, so that a page can be rewritten by edits and
everything else stays as it was written.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

from palimp.session import ship_by_value

ship_by_value(__name__)

_TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*)")
_GAP = re.compile(r"[\t\n\f\r /]*")
_NAME = re.compile(r"[^\t\n\f\r />][^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
_CLOSED = re.compile(r"--!?>")
# Elements whose content is text up to their own end tag.
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}


class Attribute(NamedTuple):
    name: str
    value: str  # with entities decoded
    start: int  # of the blanks before the name
    end: int
    value_start: int  # with its quotes; -1 if there is no value


class Part(NamedTuple):
    kind: str  # text, open, close, comment, raw, other
    start: int
    end: int
    name: str = ""
    attributes: tuple[Attribute, ...] = ()


def _attributes(page: str, at: int) -> tuple[list[Attribute], int]:
    """Attributes from ``at`` on, and the end of the tag."""
    found, n = [], len(page)
    while True:
        start, at = at, _GAP.match(page, at).end()
        if at >= n or page[at] == ">":
            return found, min(at + 1, n)
        name = _NAME.match(page, at)
        at, value, value_start = name.end(), "", -1
        equals = _EQUALS.match(page, at)
        if equals:
            value_start = at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                value, at = (page[at + 1 :], n) if end < 0 else (page[at + 1 : end], end + 1)
            else:
                end = _UNQUOTED.match(page, at).end()
                value, at = page[at:end], end
        found.append(Attribute(name[0].lower(), entities.unescape(value), start, at, value_start))


def parts(page: str, inert: bool = False) -> Iterator[Part]:
    """The parts of a page in order, without gaps. ``inert`` reads the inside of a comment or of raw text, where nothing but
    a script holds raw text and comment marks are text."""
    at, n, text = 0, len(page), 0
    while at < n:
        at = page.find("<", at)
        if at < 0:
            break
        tag = _TAG.match(page, at)
        follows = page[at + 1 : at + 2]
        if not tag and (inert or not (follows in ("!", "?") or follows == "/" and at + 2 < n)):
            at += 1
            continue
        if text < at:
            yield Part("text", text, at)
        if not tag:
            kind, end = "other", page.find(">", at)
            if page.startswith("<!--", at):
                closed = _CLOSED.search(page, at + 2 if page[at + 4 : at + 5] == ">" or page[at + 4 : at + 6] == "->" else at + 4)
                kind, end = "comment", closed.end() - 1 if closed else -1
            end = n if end < 0 else end + 1
            yield Part(kind, at, end)
            at = text = end
            continue
        attributes, end = _attributes(page, tag.end())
        name = tag[2].lower()
        yield Part("close" if tag[1] else "open", at, end, name, tuple(attributes))
        at = text = end
        if not tag[1] and name in (("script",) if inert else RAW_TEXT):
            closing = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I).search(page, end)
            at = text = closing.start() if closing else n
            if at > end:
                yield Part("raw", end, at, name)
    if text < n:
        yield Part("text", text, n)


def edited(page: str, edits: list[tuple[int, int, str]]) -> str:
    """The page with (start, end, replacement) applied; an edit inside an earlier one is void."""
    pieces, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= at:
            pieces += [page[at:start], new]
            at = end
    return "".join(pieces) + page[at:]
