"""A small tree of nodes from HTML as it is found, however it is nested, by the standard's rules for the body of a document.

Implied end tags, formatting that is opened again, the adoption procedure for formatting that is closed in the wrong order, and foster parents for what
stands in tables outside of their cells. What belongs into the head stands first in the body; templates, frames and forms have no rules of their own.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul".split()
)
SPECIAL = frozenset(
    (
        "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset "
        "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select "
        "source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp"
    ).split()
)
SCOPE_ENDS = frozenset("applet caption html table td th marquee object template body".split())
IMPLIED_ENDS = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKING = frozenset("applet marquee object".split())
CELLS, SECTIONS = frozenset("td th".split()), frozenset("tbody thead tfoot".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IN_TABLES = frozenset("caption col colgroup tbody thead tfoot tr td th".split())
IN_HEAD = frozenset("base link meta noframes script style template title".split())
_NO_ENDS: frozenset[str] = frozenset()


class Node:
    """An element (name, attributes, children) or, without a name, text."""

    __slots__ = ("at", "attributes", "blank", "children", "filled", "lead", "name", "nth", "parent", "text", "trail")

    def __init__(self, name: str | None, attributes: dict[str, str] | None = None, text: str = "") -> None:
        self.name, self.attributes, self.text = name, attributes or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def text_content(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.name is None:
                out.append(node.text)
            stack.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open: list[Node] = [self.root]
        self.there: set[Node] = {self.root}
        self.names: Counter[str] = Counter({"body": 1})
        self.deepest = 1
        #: Formatting that goes on until it is closed; None stands before what a cell, caption or object begins anew.
        self.formatting: list[Node | None] = []
        self.fostering = False

    # Open elements

    def _push(self, node: Node, at: int | None = None) -> None:
        self.open.insert(len(self.open) if at is None else at, node)
        self.there.add(node)
        self.names[node.name] += 1
        self.deepest = max(self.deepest, len(self.open))

    def _remove(self, node: Node) -> None:
        if self.open[-1] is node:
            self.open.pop()
        else:
            self.open.remove(node)
        self.there.discard(node)
        self.names[node.name] -= 1

    def _pop_to(self, node: Node) -> None:
        while self.open[-1] is not node:
            self._remove(self.open[-1])
        self._remove(node)

    def _in_scope(self, names: frozenset[str], more_ends: frozenset[str] = _NO_ENDS, ends: frozenset[str] = SCOPE_ENDS) -> Node | None:
        if not any(self.names[n] for n in names):
            return None
        for node in reversed(self.open):
            if node.name in names:
                return node
            if node.name in ends or node.name in more_ends:
                return None
        return None

    def _imply_ends(self, but: str = "") -> None:
        while self.open[-1].name in IMPLIED_ENDS and self.open[-1].name != but:
            self._remove(self.open[-1])

    def _close_p(self) -> None:
        if p := self._in_scope(frozenset({"p"}), frozenset({"button"})):
            self._pop_to(p)

    # Insertion

    def _place(self, target: Node | None = None) -> tuple[Node, int]:
        """The parent and the index at which a node goes: within the target, or, from tables, before the table."""
        target = target or self.open[-1]
        if self.fostering and target.name in TABLE_PARTS and self.names["table"]:
            k = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name == "table")
            table = self.open[k]
            if table.parent is not None:
                siblings = table.parent.children
                return table.parent, next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is table)
            return self.open[k - 1], len(self.open[k - 1].children)
        return target, len(target.children)

    def _put(self, node: Node, target: Node | None = None) -> Node:
        self._detached(node)
        parent, i = self._place(target)
        node.parent = parent
        parent.children.insert(i, node)
        return node

    def _insert(self, tag: str, attributes: dict[str, str] | None = None) -> Node:
        node = self._put(Node(tag, attributes))
        if tag not in VOID:
            self._push(node)
        return node

    def _text(self, data: str) -> None:
        parent, i = self._place()
        if i and parent.children[i - 1].name is None:
            parent.children[i - 1].text += data
        else:
            text = Node(None, text=data)
            text.parent = parent
            parent.children.insert(i, text)

    # Formatting

    def _listed(self, tag: str) -> Node | None:
        for node in reversed(self.formatting):
            if node is None:
                return None
            if node.name == tag:
                return node
        return None

    def _unlist(self, node: Node) -> None:
        self.formatting = [n for n in self.formatting if n is not node]

    def _clear_to_mark(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def _list(self, node: Node) -> None:
        alike = []
        for n in reversed(self.formatting):
            if n is None:
                break
            if n.name == node.name and n.attributes == node.attributes:
                alike.append(n)
        if len(alike) >= 3:  # at most three alike are opened again
            self._unlist(alike[-1])
        self.formatting.append(node)

    def _reopen(self) -> None:
        """Formatting that was left open goes on in what follows."""
        i = len(self.formatting)
        while i and self.formatting[i - 1] is not None and self.formatting[i - 1] not in self.there:
            i -= 1
        for k in range(i, len(self.formatting)):
            old = self.formatting[k]
            self.formatting[k] = self._insert(old.name, dict(old.attributes))

    def _adopt(self, tag: str) -> None:
        """The adoption procedure: formatting is closed across the blocks that it holds, each of which gets a copy of its own."""
        if self.open[-1].name == tag and self.open[-1] not in self.formatting:
            self._remove(self.open[-1])
            return
        for _ in range(8):
            element = self._listed(tag)
            if element is None:
                self._end_other(tag)
                return
            if element not in self.there:
                self._unlist(element)
                return
            if not self._has_in_scope(element):
                return
            at = self.open.index(element)
            furthest = next((n for n in self.open[at + 1 :] if n.name in SPECIAL), None)
            if furthest is None:
                self._pop_to(element)
                self._unlist(element)
                return
            ancestor, mark = self.open[at - 1], self.formatting.index(element)
            last = furthest
            k = self.open.index(furthest)
            for step in range(1, k - at + 1):
                k -= 1
                node = self.open[k]
                if node is element:
                    break
                if step > 3 and node in self.formatting:
                    if self.formatting.index(node) < mark:
                        mark -= 1
                    self._unlist(node)
                if node not in self.formatting:
                    self._remove(node)
                    continue
                copy = Node(node.name, dict(node.attributes))
                self.formatting[self.formatting.index(node)] = copy
                self._remove(node)
                self._push(copy, k)
                if last is furthest:
                    mark = self.formatting.index(copy) + 1
                copy.add(self._detached(last))
                last = copy
            fostering, self.fostering = self.fostering, True
            self._put(last, ancestor)
            self.fostering = fostering
            copy = Node(element.name, dict(element.attributes))
            for child in furthest.children:
                copy.add(child)
            furthest.children = []
            furthest.add(copy)
            if self.formatting.index(element) < mark:
                mark -= 1
            self._unlist(element)
            self.formatting.insert(mark, copy)
            self._remove(element)
            self._push(copy, self.open.index(furthest) + 1)

    def _has_in_scope(self, element: Node) -> bool:
        for node in reversed(self.open):
            if node is element:
                return True
            if node.name in SCOPE_ENDS:
                return False
        return False

    @staticmethod
    def _detached(node: Node) -> Node:
        if node.parent is not None:
            siblings = node.parent.children
            del siblings[next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is node)]  # most often the last one
            node.parent = None
        return node

    def _end_other(self, tag: str) -> None:
        if not self.names[tag]:
            return
        for node in reversed(self.open[1:]):
            if node.name == tag:
                self._imply_ends(tag)
                self._pop_to(node)
                return
            if node.name in SPECIAL:
                return

    # Tables

    def _in_table_scope(self, names: frozenset[str]) -> Node | None:
        return self._in_scope(names, ends=frozenset({"html", "table", "template", "body"}))

    def _clear_to(self, names: frozenset[str]) -> None:
        while self.open[-1].name not in names and len(self.open) > 1:
            self._remove(self.open[-1])

    def _close_cell(self) -> None:
        if cell := self._in_table_scope(CELLS | {"caption"}):
            self._imply_ends()
            self._pop_to(cell)
            self._clear_to_mark()

    def _start_in_table(self, tag: str, attributes: dict[str, str]) -> None:
        """Parts of tables; outside of any table their tags are passed over."""
        if not self._in_table_scope(frozenset({"table"})):
            return
        self._close_cell()
        if tag in CELLS:
            if not self._in_table_scope(frozenset({"tr"})):
                self._start_in_table("tr", {})
            self._clear_to(frozenset({"tr"}))
        elif tag == "tr":
            if not self._in_table_scope(SECTIONS):
                self._start_in_table("tbody", {})
            self._clear_to(SECTIONS)
        else:
            self._clear_to(frozenset({"table"}))
            if tag == "col":
                self._insert("colgroup")
        self._insert(tag, attributes)
        if tag in CELLS or tag == "caption":
            self.formatting.append(None)
        elif tag in ("col", "colgroup"):
            self._clear_to(frozenset({"table"}))

    def _end_in_table(self, tag: str) -> None:
        node = self._in_table_scope(frozenset({tag}))
        if node is None:
            return
        if tag in CELLS or tag == "caption":
            self._imply_ends()
            self._pop_to(node)
            self._clear_to_mark()
            return
        self._close_cell()
        if node in self.there:
            self._pop_to(node)

    # Tokens

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        attributes: dict[str, str] = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        if tag in ("html", "head", "body", "frame", "frameset"):
            return
        if tag in IN_TABLES:
            self._start_in_table(tag, attributes)
            return
        in_table = self.open[-1].name in TABLE_PARTS
        if tag in IN_HEAD:
            self._insert(tag, attributes)
            return
        if in_table and tag == "table":
            self._end_in_table("table")
            in_table = self.open[-1].name in TABLE_PARTS
        self.fostering = in_table
        self._start_in_body(tag, attributes)
        self.fostering = False

    def _start_in_body(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in CLOSES_P:
            self._close_p()
            if tag in HEADINGS and self.open[-1].name in HEADINGS:
                self._remove(self.open[-1])
            self._insert(tag, attributes)
            return
        if tag in ("li", "dd", "dt"):
            alike = frozenset({"li"}) if tag == "li" else frozenset({"dd", "dt"})
            for node in reversed(self.open):
                if node.name in alike:
                    self._imply_ends(node.name)
                    self._pop_to(node)
                    break
                if node.name in SPECIAL and node.name not in ("address", "div", "p"):
                    break
            self._close_p()
            self._insert(tag, attributes)
            return
        if tag == "a" and (a := self._listed("a")):
            self._adopt("a")
            self._unlist(a)
            if a in self.there:
                self._remove(a)
        elif tag == "button" and (button := self._in_scope(frozenset({"button"}))):
            self._imply_ends()
            self._pop_to(button)
        elif tag in ("option", "optgroup") and self.open[-1].name == "option":
            self._remove(self.open[-1])
        if tag not in ("param", "source", "track"):
            self._reopen()
        if tag == "nobr" and self._in_scope(frozenset({"nobr"})):
            self._adopt("nobr")
            self._reopen()
        node = self._insert(tag, attributes)
        if tag in FORMATTING:
            self._list(node)
        elif tag in MARKING:
            self.formatting.append(None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in IN_TABLES or tag == "table":
            self._end_in_table(tag)
            return
        self.fostering = self.open[-1].name in TABLE_PARTS
        self._end_in_body(tag)
        self.fostering = False

    def _end_in_body(self, tag: str) -> None:
        if tag == "br":
            self._start_in_body("br", {})
        elif tag == "p":
            if not self._in_scope(frozenset({"p"}), frozenset({"button"})):
                self._insert("p")
            self._imply_ends("p")
            self._close_p()
        elif tag in HEADINGS:
            if node := self._in_scope(HEADINGS):
                self._imply_ends()
                self._pop_to(node)
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in CLOSES_P or tag in ("li", "dd", "dt", "button") or tag in MARKING:
            ends = frozenset({"ol", "ul"}) if tag == "li" else _NO_ENDS
            if node := self._in_scope(frozenset({tag}), ends):
                self._imply_ends(tag)
                self._pop_to(node)
                if tag in MARKING:
                    self._clear_to_mark()
        else:
            self._end_other(tag)

    def handle_data(self, data: str) -> None:
        if not data:
            return
        blank = not data.strip(" \t\n\r\f")
        if self.open[-1].name in ("script", "style", "title", "textarea"):
            self._text(data)
            return
        self.fostering = self.open[-1].name in TABLE_PARTS and not blank
        if not blank:  # before blanks alone it would leave elements with nothing in them
            self._reopen()
        self._text(data)
        self.fostering = False


def parse(html: str) -> Node:
    """The body's node; what belongs into the head stands first in it."""
    return parse_with_depth(html)[0]


def parse_with_depth(html: str) -> tuple[Node, int]:
    """The body's node, and how many elements were open at once."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root, builder.deepest
