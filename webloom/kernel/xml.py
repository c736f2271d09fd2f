"""A tree from XML that may be malformed: what can't be understood is skipped, never an error."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

from webloom.kernel.text import BLANK, trim

_TOKEN = re.compile(
    r"""<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[([\s\S]*?)(?:\]\]>|\Z)|<\?[\s\S]*?(?:\?>|\Z)|<![^>\[]*(?:\[[\s\S]*?\])?[^>]*>|<(/?)([^\s<>/=!?][^\s<>/]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
)
_ATTRIBUTE = re.compile(rf"""([^{BLANK}=/"'<>]+)[{BLANK}]*=[{BLANK}]*(?:"([^"]*)"|'([^']*)')""")
_XML_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_REFERENCE = re.compile(r"&(#x[0-9a-fA-F]{1,8}|#[0-9]{1,8}|[A-Za-z][A-Za-z0-9]*);")


class Element:
    """An element with its attributes, its own text (each piece trimmed), and the elements in it."""

    __slots__ = ("attributes", "children", "name", "pieces")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes = name, attributes
        self.children: list[Element] = []
        self.pieces: list[str] = []

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def all(self, name: str) -> list[Element]:
        return [c for c in self.children if c.name == name]

    def only(self, name: str) -> Element | None:
        """The child of the name; none if there are several, since then none is the value."""
        found = self.all(name)
        return found[0] if len(found) == 1 else None


def _referenced(m: re.Match[str], named: bool) -> str:
    r = m[1]
    if r[0] != "#":
        return _XML_NAMED.get(r) or (_html.unescape(m[0]) if named else m[0])
    code = int(r[2:], 16) if r[1] in "xX" else int(r[1:])
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]


def _decoded(s: str, html_names: bool) -> str:
    return _REFERENCE.sub(lambda m: _referenced(m, html_names), s) if "&" in s else s


def _attributes(inside: str, html_names: bool) -> dict[str, str]:
    return {a[1]: _decoded(trim(a[2] if a[2] is not None else a[3]), html_names) for a in _ATTRIBUTE.finditer(inside)}


def parse(text: str, html_names: bool = False) -> Element:
    """The document, as an element without a name. html_names: HTML's named entities are decoded too."""
    root = Element("", {})
    stack, at = [root], 0
    for m in _TOKEN.finditer(text):
        piece = trim(text[at : m.start()])
        if piece:
            stack[-1].pieces.append(_decoded(piece, html_names))
        at = m.end()
        if m[1] is not None:
            stack[-1].pieces.append(m[1])
        elif m[3]:
            if m[2]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == m[3]), None)
                if depth is not None:
                    del stack[depth:]
                continue
            child = Element(m[3], _attributes(m[4], html_names))
            stack[-1].children.append(child)
            if not m[4].endswith("/"):
                stack.append(child)
    piece = trim(text[at:])
    if piece and "<" not in piece:
        stack[-1].pieces.append(_decoded(piece, html_names))
    return root


# Without the whole document at hand

#: A tag, comment or the like of more letters is no token (``parse`` knows no such limit).
MOST_TOKEN = 1 << 24
#: What a tag holds up to its end, or to where it can't go on.
_INSIDE = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+""")
_NAME = re.compile(r"[^\s<>/=!?][^\s<>/]*")
_ENDS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))


def _whole(buffer: str, at: int, over: bool) -> re.Match[str] | bool:
    """The token that begins at a ``<``; False if none does, True if it takes more of the document to tell."""
    token = _TOKEN.match(buffer, at)
    if over or len(buffer) - at > MOST_TOKEN:
        return token or False
    if token is not None and token[3] and buffer[token.end(3)] not in "\"'":
        return token  # a tag, whatever follows
    if len(buffer) - at < 10:
        return True
    for start, end in _ENDS:
        if buffer.startswith(start, at):
            return _TOKEN.match(buffer, at) if buffer.find(end, at + len(start)) >= 0 else True
    if buffer.startswith("<!", at):
        close, open_ = buffer.find(">", at), buffer.find("[", at)
        if 0 <= open_ and (close < 0 or open_ < close):
            inner = buffer.find("]", open_)
            close = buffer.find(">", inner) if inner >= 0 else -1
        return (_TOKEN.match(buffer, at) or False) if close >= 0 else True
    name = _NAME.match(buffer, at + 1 + (buffer[at + 1] == "/"))
    if name is None:
        return False
    # A quote in a name may as well begin a value: the longest name that leads to an end counts.
    for stop in (name.end(), *(i for i in range(name.end() - 1, name.start(), -1) if buffer[i] in "\"'")):
        end = _INSIDE.match(buffer, stop).end()
        if end == len(buffer) or buffer[end] in "\"'":
            return True
        if buffer[end] == ">":
            return _TOKEN.match(buffer, at) or False
    return False


def _tokens(chunks: Iterable[str]) -> Iterator[tuple[str, re.Match[str] | None]]:
    """The text before each token, and the token; at last the text after the last one, and None. The buffer holds what no token has taken yet."""
    buffer, at, look = "", 0, 0
    source = iter(chunks)
    over = False
    while True:
        start = buffer.find("<", look)
        token = (_whole(buffer, start, over) if start >= 0 else over) if not (start < 0 and over) else False
        if start < 0 and over:
            yield buffer[at:], None
            return
        if start < 0 or token is True:
            # What is left over is looked at again only when it has grown by its own length, so that long tokens cost no more than their size.
            more, need = [], max(1, len(buffer) - at)
            look -= at
            while need > 0:
                chunk = next(source, None)
                if chunk is None:
                    over = True
                    break
                more.append(chunk)
                need -= len(chunk)
            rest = buffer[at:]
            look = max(0, (start - at) if start >= 0 else len(rest))
            buffer, at = rest + "".join(more), 0
        elif token is False:
            look = start + 1
        else:
            yield buffer[at:start], token
            at = look = token.end()
            if at > 1 << 16:
                buffer, at, look = buffer[at:], 0, 0


Path = tuple[str, ...]


def pulled(chunks: Iterable[str], wanted: Iterable[Path], html_names: bool = False) -> Iterator[tuple[Path, Element]]:
    """Elements at the wanted paths, each with all that it holds, as soon as it ends: what ``parse`` finds there, without the document.

    Of containers on a path only the first of its name counts (``rss``, its ``channel``); what lies elsewhere is passed over. A last ``*`` stands for
    any name that no other wanted path has there.
    """
    paths = set(wanted)
    above = {p[:i] for p in paths for i in range(1, len(p))}
    met: set[Path] = set()
    stack: list[tuple[str, Path | None, Element | None]] = []  # name, path while it leads to a wanted one, element within a wanted one

    def end(depth: int) -> Iterator[tuple[Path, Element]]:
        while len(stack) > depth:
            _, path, element = stack.pop()
            if path is not None and element is not None:
                yield path, element

    for text, token in _tokens(chunks):
        inside = stack[-1][2] if stack else None
        if inside is not None:
            piece = trim(text)
            if piece and (token is not None or "<" not in piece):
                inside.pieces.append(_decoded(piece, html_names))
        if token is None:
            yield from end(0)
            return
        if token[1] is not None:
            if inside is not None:
                inside.pieces.append(token[1])
        elif token[3] and token[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == token[3]), None)
            if depth is not None:
                yield from end(depth)
        elif token[3]:
            name, closed = token[3], token[4].endswith("/")
            entry: tuple[str, Path | None, Element | None] = (name, None, None)
            if inside is not None:
                child = Element(name, _attributes(token[4], html_names))
                inside.children.append(child)
                entry = name, None, child
            elif not stack or stack[-1][1] is not None:
                path = (*(stack[-1][1] if stack else ()), name)
                if path in above and path not in met:
                    met.add(path)
                    entry = name, path, None
                elif path in paths or (path[:-1] + ("*",) in paths and path not in above):
                    entry = name, path if path in paths else path[:-1] + ("*",), Element(name, _attributes(token[4], html_names))
            stack.append(entry)
            if closed:
                yield from end(len(stack) - 1)
