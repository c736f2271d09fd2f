"""Markdown from HTML: ATX headings, fenced code, ``-`` bullets, ``_`` emphasis, ``**`` strong, inline links."""

from __future__ import annotations

import re
import sys

from webloom.kernel.text import BLANK, trim
from webloom.kernel.tree import VOID, Node, parse_with_depth

#: Elements that leave nothing.
REMOVED = frozenset("script style noscript iframe svg canvas nav footer aside".split())
BLOCKS = frozenset(
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul".split()
)
MEANINGFUL_BLANK = frozenset("a table thead tbody tfoot th td iframe script audio video".split())
#: How markdown's own characters are escaped in text.
ESCAPES = tuple(
    (re.compile(p), r)
    for p, r in (
        (r"\\", r"\\\\"),
        (r"\*", r"\\*"),
        (r"^-", r"\\-"),
        (r"^\+ ", r"\\+ "),
        (r"^(=+)", r"\\\1"),
        (r"^(#{1,6}) ", r"\\\1 "),
        (r"`", r"\\`"),
        (r"^~~~", r"\\~~~"),
        (r"\[", r"\\["),
        (r"\]", r"\\]"),
        (r"^>", r"\\>"),
        (r"_", r"\\_"),
        (r"^(\d+)\. ", r"\1\\. "),
    )
)
_SPACES = re.compile(r"[ \r\n\t]+")


def _collapse_blanks(root: Node) -> None:
    """Runs of blanks in text become one, and none stays at the edges of blocks; code keeps its own."""
    last: Node | None = None
    keep = False  # the text so far ends in something that isn't a blank of its own

    def visit(node: Node, in_pre: bool) -> None:
        nonlocal last, keep
        if node.name is None:
            if in_pre:
                last, keep = None, True
                return
            text = _SPACES.sub(" ", node.text)
            if (last is None or last.text.endswith(" ")) and not keep and text.startswith(" "):
                text = text[1:]
            node.text = text
            if text:
                last, keep = node, False
            return
        if node.name in BLOCKS or node.name == "br":
            if last is not None:
                last.text = last.text.removesuffix(" ")
            last, keep = None, False
        elif node.name in VOID:
            last, keep = None, True
        for child in list(node.children):
            visit(child, in_pre or node.name == "pre")
        if node.name in BLOCKS:
            if last is not None:
                last.text = last.text.removesuffix(" ")
            last, keep = None, False

    visit(root, False)
    if last is not None:
        last.text = last.text.removesuffix(" ")


def _drop_empty(node: Node) -> None:
    for child in node.children:
        _drop_empty(child)
    node.children = [c for c in node.children if c.name is not None or c.text]


_LEAD, _TRAIL = re.compile(f"[{BLANK}]*"), re.compile(f"[{BLANK}]*\\Z")


def _ends(node: Node) -> None:
    """The blanks at both ends of a node's text (all of it, at its beginning, if there is nothing else), from its children's."""
    if node.name is None:
        node.blank = not trim(node.text)
        node.lead = node.text if node.blank else _LEAD.match(node.text)[0]
        node.trail = "" if node.blank else _TRAIL.search(node.text)[0]
        return
    lead, trail = [], []
    for c in node.children:
        lead.append(c.lead)
        if not c.blank:
            break
    node.blank = all(c.blank for c in node.children)
    if not node.blank:
        for c in reversed(node.children):
            trail.append(c.lead if c.blank else c.trail)
            if not c.blank:
                break
    node.lead, node.trail = "".join(lead), "".join(reversed(trail))


def _survey(root: Node) -> None:
    """Notes for each node its place among its siblings and among the elements of these, whether anything is in it, and the blanks at its ends."""
    order = [root]
    for node in order:  # parents first: the list grows while it is read
        nth = 0
        for i, child in enumerate(node.children):
            child.at, child.nth = i, nth
            nth += child.name is not None
        order.extend(node.children)
    for node in reversed(order):
        _ends(node)
        node.filled = bool(trim(node.text)) if node.name is None else node.name in VOID or node.name in MEANINGFUL_BLANK or any(c.filled for c in node.children)


def _join(left: str, right: str) -> str:
    a, b = left.rstrip("\n"), right.lstrip("\n")
    return a + "\n\n"[: max(len(left) - len(a), len(right) - len(b))] + b


def _next(node: Node, step: int) -> Node | None:
    siblings = node.parent.children if node.parent else []
    i = node.at + step if siblings else 0
    return siblings[i] if 0 <= i < len(siblings) else None


def _touches_blank(node: Node, left: bool) -> bool:
    other = _next(node, -1 if left else 1)
    if other is None or other.name in BLOCKS:
        return False
    return (other.trail or (other.lead if other.blank else "")).endswith(" ") if left else other.lead.startswith(" ")


def _inside(node: Node, in_code: bool) -> str:
    out = ""
    for child in node.children:
        if child.name is None:
            text = child.text
            if not in_code:
                for pattern, by in ESCAPES:
                    text = pattern.sub(by, text)
            out = _join(out, text)
        else:
            out = _join(out, _element(child, in_code))
    return out


def _element(node: Node, in_code: bool) -> str:
    name = node.name
    if name in REMOVED:
        return ""
    code_inside = in_code or name in ("code", "pre")
    content = _inside(node, code_inside)
    lead = trail = ""
    if name not in BLOCKS:
        if node.lead or not node.blank:
            # Blanks at the ends move outside of the marks.
            if not in_code and name != "code":
                lead, trail = node.lead, node.trail
                if lead and _touches_blank(node, True):
                    lead = ""
                if trail and _touches_blank(node, False):
                    trail = ""
                if lead or trail or content != trim(content):
                    content = trim(content)
    return lead + _marked(node, content) + trail


def _marked(node: Node, content: str) -> str:
    name = node.name
    block = name in BLOCKS
    if not node.filled:
        return "\n\n" if block else ""
    if name == "p":
        return f"\n\n{content}\n\n"
    if name == "br":
        return "  \n"
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\n\n{'#' * int(name[1])} {content}\n\n"
    if name == "blockquote":
        return "\n\n" + re.sub("^", "> ", content.strip("\n"), flags=re.M) + "\n\n"
    if name in ("ul", "ol"):
        parent = node.parent
        in_item = parent is not None and parent.name == "li" and [c for c in parent.children if c.name][-1:] == [node]
        return f"\n{content}" if in_item else f"\n\n{content}\n\n"
    if name == "li":
        return _item(node, content)
    if name == "pre" and node.children and node.children[0].name == "code":
        return _fenced(node.children[0])
    if name == "hr":
        return "\n\n* * *\n\n"
    if name == "a" and node.attributes.get("href"):
        title = re.sub(r"\n+[^\S\n]*", "\n", node.attributes.get("title", "")).replace('"', '\\"')
        href = re.sub(r"([()])", r"\\\1", node.attributes["href"])
        return f"[{content}]({href}{f' "{title}"' if title else ''})"
    if name in ("em", "i"):
        return f"_{content}_" if trim(content) else ""
    if name in ("strong", "b"):
        return f"**{content}**" if trim(content) else ""
    if name == "code" and not (node.parent is not None and node.parent.name == "pre"):
        return _inline_code(content)
    if name == "img":
        alt, title = (re.sub(r"\n+[^\S\n]*", "\n", node.attributes.get(a, "")) for a in ("alt", "title"))
        src = node.attributes.get("src", "")
        return f"![{alt}]({src}{f' "{title}"' if title else ''})" if src else ""
    return f"\n\n{content}\n\n" if block else content


def _item(node: Node, content: str) -> str:
    content = re.sub(r"\n+\Z", "\n", content.lstrip("\n")).replace("\n", "\n    ")
    prefix = "-   "
    parent = node.parent
    if parent is not None and parent.name == "ol":
        start = parent.attributes.get("start")
        first = int(start) if start and re.fullmatch(r"-?\d+", start) else 1
        prefix = f"{first + node.nth}.  "
    return prefix + content + ("\n" if _next(node, 1) is not None and not content.endswith("\n") else "")


def _fenced(code: Node) -> str:
    language = re.search(r"language-(\S+)", code.attributes.get("class", ""))
    text = code.text_content()
    size = max([2, *(len(m) for m in re.findall(r"^`{3,}", text, flags=re.M))]) + 1
    fence = "`" * size
    return f"\n\n{fence}{language[1] if language else ''}\n{text.removesuffix(chr(10))}\n{fence}\n\n"


def _inline_code(content: str) -> str:
    if not content:
        return ""
    content = re.sub(r"\r?\n|\r", " ", content)
    extra = " " if re.search(r"^`|^ .*?[^ ].* $|`$", content) else ""
    runs, fence = set(re.findall("`+", content)), "`"
    while fence in runs:
        fence += "`"
    return fence + extra + content + extra + fence


#: Elements within one another that are turned into markdown at most.
MOST_DEPTH = 50_000


def html_to_markdown(html: str) -> str:
    """Raises ValueError for elements within one another beyond MOST_DEPTH."""
    root, depth = parse_with_depth(html)
    if depth > MOST_DEPTH:
        raise ValueError(f"{depth} elements within one another")
    before = sys.getrecursionlimit()
    # Each element takes two calls, and these no more than a heap's frame.
    sys.setrecursionlimit(max(before, 4 * depth + 1000))
    try:
        _collapse_blanks(root)
        _drop_empty(root)
        _survey(root)
        return trim(_inside(root, False))
    finally:
        sys.setrecursionlimit(before)
