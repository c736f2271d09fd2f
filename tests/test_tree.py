"""The tree of misnested markup: the standard's own examples, and what holds for any."""

import random
import time

import pytest

from webloom.kernel.tree import FORMATTING, parse


def shown(node):
    if node.name is None:
        return node.text
    return f"<{node.name}{''.join(f' {k}={v}' for k, v in node.attributes.items())}>{''.join(map(shown, node.children))}</{node.name}>"


def body(html):
    return "".join(map(shown, parse(html).children))


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
        (
            "<p><b class=x><b class=x><b><b class=x><b class=x><b>X\n<p>X\n<p><b><b class=x><b>X\n<p></b></b></b></b></b></b>X",
            "<p><b class=x><b class=x><b><b class=x><b class=x><b>X\n</b></b></b></b></b></b></p><p><b class=x><b><b class=x><b class=x><b>X\n</b></b></b></b></b></p>"
            "<p><b class=x><b><b class=x><b class=x><b><b><b class=x><b>X\n</b></b></b></b></b></b></b></b></p><p>X</p>",
        ),
        ("<a href=1>x<a href=2>y</a>z", "<a href=1>x</a><a href=2>y</a>z"),
        ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
        ("<b>1<i>2<p>3</b>4", "<b>1<i>2</i></b><i><p><b>3</b>4</p></i>"),
        ("<b><em><dd></b>", "<b><em></em></b><em><dd><b></b></dd></em>"),
        ("<a><table><td><a><table></table><a></tr><a></table><b>X</b>C<a>Y", "<a><a></a><table><tbody><tr><td><a><table></table></a><a></a></td></tr></tbody></table></a><a><b>X</b>C</a><a>Y</a>"),
        (
            "<div><a><b><div><div><div><div><div><div><div><div><div><div></a>",
            "<div><a><b></b></a><b>" + "<div><a></a>" * 7 + "<div><a><div><div></div></div></a>" + "</div>" * 8 + "</b></div>",
        ),
        ("<ul><li><b>a<li>b</b>c</ul>", "<ul><li><b>a</b></li><li><b>b</b>c</li></ul>"),
        ("<table><tr><td><b>x<td>y</table>z", "<table><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z"),
        ("<table> <tr> <td>x</td> </tr> </table>", "<table> <tbody><tr> <td>x</td> </tr> </tbody></table>"),
        ("<table><tr>a<td>b</td>c</tr></table>", "ac<table><tbody><tr><td>b</td></tr></tbody></table>"),
        ("<table><p>a<tr><td>b<p>c</table>d", "<p>a</p><table><tbody><tr><td>b<p>c</p></td></tr></tbody></table>d"),
        ("<table><caption><b>t</caption><td>x</table>y", "<table><caption><b>t</b></caption><tbody><tr><td>x</td></tr></tbody></table>y"),
        ("<td>x</td><tr>y", "xy"),
        ("<p>a<div>b</p>c</div>d", "<p>a</p><div>b<p></p>c</div>d"),
        ("<i><object>a</i>b</object>c", "<i><object>ab</object>c</i>"),
        ("<h1>a<h2>b</h3>c", "<h1>a</h1><h2>b</h2>c"),
        ("</p></br>x</b></div>", "<p></p><br></br>x"),
    ],
)
def test_standards_examples(html, wanted):
    assert body(html) == wanted


PIECES = ["<b>", "</b>", "<i>", "</i>", "<a href=1>", "</a>", "<p>", "</p>", "<div>", "</div>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<ul>", "<li>", "</li>", "</ul>", "<h1>", "</h1>", "<span>", "</span>", "<br>", "<object>", "</object>", "<nobr>", "<button>", "</button>", "<caption>", "<tbody>", "<select>", "<option>"]


@pytest.mark.parametrize("seed", range(15))
def test_any_markup_is_a_tree(seed):
    """Every text is there once and, but for what tables give away, in order; parents are right; nothing is its own descendant."""
    r = random.Random(seed)
    for _ in range(150):
        pieces = [r.choice(PIECES) if r.random() < 0.7 else f"[{i}]" for i in range(r.randint(1, 50))]
        root = parse("".join(pieces))
        seen, stack = [], [root]
        while stack:
            node = stack.pop()
            seen.append(node)
            assert all(c.parent is node for c in node.children)
            stack += reversed(node.children)
        assert len({id(n) for n in seen}) == len(seen)
        texts = [t for t in pieces if t.startswith("[")]
        found = root.text_content().replace("][", "]|[").split("|") if texts else []
        assert sorted(found) == sorted(texts)
        if not any("t" in p for p in pieces):
            assert found == texts
        assert not any(n.name in FORMATTING and any(c.name == "a" for c in n.children) for n in seen if n.name == "a" and n.parent.name not in ("td", "caption", "object") and not any("table" in p or "object" in p for p in pieces))


@pytest.mark.parametrize("html", ["<div>" * 20_000, "<b>" * 20_000 + "x", "<b><p>" * 3000, "<p>x" * 20_000, "<table><tr><td>" * 3000, "<i>" * 200 + "<p>x</i>" * 500])
def test_deep_markup_is_quick(html):
    began = time.perf_counter()
    parse(html)
    assert time.perf_counter() - began < 2
