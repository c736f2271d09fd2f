"""Plain string rules of web content: blanks, entities, lengths, display limits."""

from __future__ import annotations

import re

#: What counts as white space in scripts on the web, as a regex class body.
BLANK = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
BLANK_CHARS = "\t\n\x0b\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
#: The named entities that are decoded, in this order.
NAMED = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "))
DISPLAY_LIMIT = 50_000
_RUN = re.compile(f"[{BLANK}]+")
_HEX, _DECIMAL = re.compile("&#x([0-9a-fA-F]+);"), re.compile("&#([0-9]+);")


def trim(s: str) -> str:
    return s.strip(BLANK_CHARS)


def collapse(s: str) -> str:
    """Runs of blanks as one, none at the ends."""
    return _RUN.sub(" ", trim(s))


def utf16_len(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


def _char(number: str, base: int) -> str:
    code = int(number, base) if len(number) < 12 else 1 << 30
    if code > 0x10FFFF:
        raise ValueError(f"character reference {number} is out of range")
    return "�" if 0xD800 <= code <= 0xDFFF else chr(code)


def decode_entities(s: str) -> str:
    """Named entities one after the other (so ``&amp;lt;`` becomes ``<``), then numbers; a number out of range raises ValueError."""
    if "&" not in s:
        return s
    for name, char in NAMED:
        s = s.replace(name, char)
    return _DECIMAL.sub(lambda m: _char(m[1], 10), _HEX.sub(lambda m: _char(m[1], 16), s))


def number_prefix(s: str) -> float | None:
    """The decimal number that a string begins with."""
    m = re.match(rf"[{BLANK}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", s)
    value = float(m[1]) if m else None
    return value if value is not None and abs(value) != float("inf") else None


def word_count(s: str) -> int:
    return len(collapse(s).split(" ")) if trim(s) else 0


def display_cap(s: str, limit: int = DISPLAY_LIMIT) -> str:
    """At most ``limit`` UTF-16 units, and how many were cut off."""
    n = utf16_len(s)
    if n <= limit:
        return s
    if n == len(s):
        kept = s[:limit]
    else:
        kept = s.encode("utf-16-le", "surrogatepass")[: 2 * limit].decode("utf-16-le", "replace")
    return f"{kept}\n\n[... truncated {n - limit} chars ...]"


#: The steps from markup to text, in this order; patterns that hold for Python, Java and RE2.
STRIP_STEPS = (
    (r"(?i)<script[\s\S]*?</script>", ""),
    (r"(?i)<style[\s\S]*?</style>", ""),
    (r"(?i)<noscript[\s\S]*?</noscript>", ""),
    (r"<!--[\s\S]*?-->", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:p|div|section|article|li|h[1-6]|tr)>", "\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+\n", "\n"),
)
_STRIP = [(re.compile(p, re.A), by) for p, by in STRIP_STEPS]


def strip_html(html: str) -> str:
    """The text of markup: blocks on lines of their own, no scripts, styles, comments or tags."""
    for pattern, by in _STRIP:
        html = pattern.sub(by, html)
    return trim(html)
