"""Blocks of tolerant markup, in one pass and without a document tree.

An open element is a frame on a stack.  Frames differ in what happens to text
below them:

``walk``   a block that holds blocks: loose text between them becomes a block
           whenever a block child begins or the frame ends;
``gather`` a heading or paragraph: all text below is one block;
``inline`` inside a walk frame or a gatherer: text goes to the one around it;
``mute``   hidden or skipped: text is dropped.

A frame's text belongs to its ``sink``, the walk or gather frame it feeds.  All of
this happens inside one Arrow batch function; everything after the blocks is
built-in Spark.

Pages are mostly plain tags that come again and again, so a page is cut at its tags by
one pattern and each distinct tag is read by the tolerant parser once a worker.  A page
with anything else (scripts, stray or broken markup) is read by the parser
as a whole; both give the same events.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html import unescape
from html.parser import HTMLParser

from prosegauge import fixed

Event = tuple[str, str, dict[str, str] | None]
Block = tuple[str, str, str]
_SPACES = re.compile(r"\s+")
#: What a start tag ends, and what shields it.
_ENDED = {
    tag: (family | ({"p"} if tag in fixed.ENDS_PARAGRAPH else set()), shields)
    for tag, (family, shields) in (dict.fromkeys(fixed.ENDS_PARAGRAPH, (frozenset(), frozenset())) | fixed.ENDS_FAMILY).items()
}


class _Events(HTMLParser):
    """Start, end and text events of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Event] = []

    def handle_starttag(self, tag, attrs):
        # of a repeated attribute the last one counts
        self.found.append(("start", tag.casefold(), {k.casefold(): v or "" for k, v in attrs}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag.casefold() not in fixed.VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.found.append(("end", tag.casefold(), None))

    def handle_data(self, data):
        self.found.append(("text", data, None))


def parsed_events(html: str) -> list[Event]:
    parser = _Events()
    parser.feed(html)
    parser.close()
    return parser.found


#: Tags and references known to a worker, none longer than ``LONGEST_KNOWN``; others are read anew.
MOST_KNOWN, LONGEST_KNOWN = 1 << 14, 256
_CUT = re.compile(r"<!--.*?--\s*>|<([^<>]*)>", re.DOTALL)
_COMMENT_END = re.compile(r"--\s*>")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_END = re.compile("/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*")
_START = re.compile(
    """([a-zA-Z][a-zA-Z0-9]*)(?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_-]*(?:=(?:"[^"]*"|'[^']*'|[^\\s"'=/`]+))?)*+[ \t\n\r\f]*/?"""
)


class _Known(dict):
    """What is made of a string, made when first asked for."""

    def __init__(self, made: Callable):
        self.made = made

    def __missing__(self, key: str):
        found = self.made(key)
        if len(key) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[key] = found
        return found


def _tag_events(inside: str) -> list[Event] | None:
    """Events of a tag by what stands between its brackets; none if it is not plain."""
    if end := _END.fullmatch(inside):
        return [("end", end[1].lower(), None)]
    if inside[:8].lower() == "!doctype":
        return []
    start = _START.fullmatch(inside)
    return parsed_events(f"<{inside}>") if start and start[1].lower() not in HTMLParser.CDATA_CONTENT_ELEMENTS + ("textarea", "title", "plaintext") else None


_tags, _references = _Known(_tag_events), _Known(unescape)


def _plain_events(html: str) -> list[Event] | None:
    """Events of a page of text, plain tags and comments; none if there is more."""
    if (last := html.rfind("<!--")) >= 0 and not _COMMENT_END.search(html, last + 4):
        return None
    found: list[Event] = []
    pieces = iter(_CUT.split(html))
    for text in pieces:
        if text:
            if "<" in text:
                return None
            if "&" in text:
                text = _REFERENCE.sub(lambda m: _references[m[0]], text)
            found.append(("text", text, None))
        if (tag := next(pieces, None)) is not None:  # none of a comment, and at the end
            made = _tags[tag]
            if made is None:
                return None
            found += made
    return found


def events(html: str) -> list[Event]:
    found = _plain_events(html)
    return parsed_events(html) if found is None else found


def closes(open_tags: list[str], tag: str) -> int | None:
    """Depth to which a start tag cuts the stack of open tags, if it does."""
    if tag not in _ENDED:
        return None
    ended, shields = _ENDED[tag]
    for depth in reversed(range(len(open_tags))):
        if open_tags[depth] in ended:
            return depth
        if open_tags[depth] in shields:
            return None
    return None


def structure(found: list[Event]) -> Iterator[tuple[str, int, str, dict[str, str] | None]]:
    """Events with every end made explicit: (kind, element number, tag or text, attributes)."""
    tags: list[str] = []
    numbers: list[int] = []
    made = 0

    def cut(depth: int):
        while len(tags) > depth:
            yield "end", numbers.pop(), tags.pop(), None

    for kind, value, attrs in found:
        if kind == "text":
            yield "text", numbers[-1] if numbers else -1, value, None
        elif kind == "end":
            if value in tags:
                yield from cut(len(tags) - 1 - tags[::-1].index(value))
        else:
            if (depth := closes(tags, value)) is not None:
                yield from cut(depth)
            yield "start", made, value, attrs
            if value in fixed.VOID_TAGS:
                yield "end", made, value, None
            else:
                tags.append(value)
                numbers.append(made)
            made += 1
    yield from cut(0)


def hidden(attrs: Mapping[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").casefold()
    return (
        "hidden" in attrs
        or attrs.get("aria-hidden", "").casefold() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
    )


def role_below(tag: str, inherited: str) -> str:
    """Role of an element by its own tag and the one around it."""
    if inherited in fixed.STICKY_ROLES:
        return inherited
    return {"nav": "navigation", "header": "header", "footer": "footer", "li": "list", "td": "table", "th": "table"}.get(tag, inherited)


class _Frame:
    __slots__ = ("mode", "tag", "role", "text", "sink", "inline")

    def __init__(self, mode: str, tag: str = "", role: str = "", sink: _Frame | None = None):
        self.mode, self.tag, self.role, self.text = mode, tag, role, []
        self.sink = sink or self
        #: the one frame that stands for every inline element that feeds this one
        self.inline = _Frame("inline", sink=self) if mode in ("walk", "gather") else None


_MUTE = _Frame("mute")


class RootNotFound(LookupError):
    pass


def blocks(html: str, root_id: str | None = None, roles: Mapping[int, str] | None = None) -> list[Block]:
    """(text, role, tag) of each block, in order.

    ``root_id`` starts at the first element with that id, whose surroundings do
    not matter.  ``roles`` gives elements, by number, a role that everything
    below keeps.
    """
    out: list[Block] = []
    given = roles or {}
    frames: list[_Frame] = [_Frame("walk", "document", "body")] if root_id is None else []
    seen, tags, made = root_id is None, [], 0

    def flush(frame: _Frame) -> None:
        text = _SPACES.sub(" ", "".join(frame.text)).strip()
        frame.text.clear()
        if text:
            out.append((text, frame.role, frame.tag))

    def opened(number: int, tag: str, attrs: Mapping[str, str], top: _Frame | None) -> _Frame:
        silent = tag in fixed.SKIPPED_TAGS or hidden(attrs)
        if top is not None and (top.mode != "walk" or tag not in fixed.BLOCK_TAGS):
            if top is _MUTE or silent or tag in fixed.EMPTY_INLINE_TAGS:
                return _MUTE
            if tag == "br":
                top.sink.text.append(" ")
            return top.sink.inline
        if top is not None:
            flush(top)
        if silent:
            return _MUTE
        around = top.role if top is not None else "body"
        role = given.get(number) or (around if around in fixed.WORD_ROLES else role_below(tag, around))
        if tag in fixed.HEADING_TAGS:
            kept = role in fixed.STICKY_ROLES or role in fixed.WORD_ROLES
            return _Frame("gather", tag, role if kept else "heading")
        return _Frame("gather" if tag in fixed.TEXT_BLOCK_TAGS else "walk", tag, role)

    def closed(frame: _Frame) -> None:
        if frame.text and frame.mode in ("walk", "gather"):
            flush(frame)

    def cut(depth: int) -> None:
        while len(tags) > depth:
            tags.pop()
            if frames:
                closed(frames.pop())

    # as ``structure`` has it, in one loop; frames are those of the innermost open elements, so there are some while inside
    for kind, value, attrs in events(html):
        if kind == "text":
            if frames and (top := frames[-1]) is not _MUTE:
                top.sink.text.append(value)
        elif kind == "end":
            if tags and tags[-1] == value:
                cut(len(tags) - 1)
            elif value in tags:
                cut(len(tags) - 1 - tags[::-1].index(value))
        else:
            if (depth := closes(tags, value)) is not None:
                cut(depth)
            if frames:
                frames.append(opened(made, value, attrs, frames[-1]))
            elif not seen and attrs.get("id") == root_id:
                seen = True
                frames.append(opened(made, value, attrs, None))
            made += 1
            if value not in fixed.VOID_TAGS:
                tags.append(value)
            elif frames:
                closed(frames.pop())
    cut(0)
    if not seen:
        raise RootNotFound(root_id)
    if frames:
        flush(frames[0])
    return out


def marked_elements(html: str, markers: Mapping[str, str]) -> dict[int, str]:
    """Role of each element that a pair of empty anchors bounds as a whole.

    The anchors must be its first and last child with content, their ids a start
    and its end, each of them once in the page.
    """
    seen: dict[str, int] = {}
    bounded: list[tuple[int, str]] = []
    # per open element: number, tag, id, whether any inline text, first and last child
    stack: list[dict] = []

    def child(entry: dict) -> None:
        if stack:
            stack[-1].setdefault("first", entry)
            stack[-1]["last"] = entry

    for kind, number, value, attrs in structure(events(html)):
        if kind == "start":
            silent = value in fixed.SKIPPED_TAGS or value in fixed.EMPTY_INLINE_TAGS or hidden(attrs)
            own = attrs.get("id")
            if value == "a" and own in markers:
                seen[own] = seen.get(own, 0) + 1
            entry = {"number": number, "tag": value, "id": own or "", "silent": silent, "filled": value == "br" and not silent}
            child(entry)
            stack.append(entry)
        elif kind == "text":
            if stack and value.strip():
                child({"tag": ""})
            if value:
                for entry in reversed(stack):
                    if entry["silent"]:
                        break
                    entry["filled"] = True
        else:
            entry = stack.pop()
            if stack and entry["filled"] and not entry["silent"]:
                stack[-1]["filled"] = True
            first, last = entry.get("first"), entry.get("last")
            if value in fixed.MARKABLE_TAGS and first is not None and first is not last and first["tag"] == last["tag"] == "a":
                start = first["id"]
                empty = all(e["silent"] or not e["filled"] for e in (first, last))
                if empty and start.endswith("_s") and start[:-2] + "_e" == last["id"] and start in markers:
                    bounded.append((number, start))
    return {n: markers[s] for n, s in bounded if seen[s] == 1 and seen.get(s[:-2] + "_e") == 1}


def each_page(extract: Callable[[str], list[Block]], html: bytes | str | None) -> tuple[list[Block], str | None]:
    """Blocks, or why there are none."""
    if html is None:
        return [], "Primary HTML artifact is missing."
    try:
        text = html.decode("utf-8") if isinstance(html, bytes) else html
    except UnicodeDecodeError:
        return [], "Primary HTML artifact is not UTF-8."
    try:
        return extract(text), None
    except RootNotFound as missing:
        return [], f"HTML root_id '{missing}' was not found"
