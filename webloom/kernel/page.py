"""What a page holds: metadata, links, main content, title, byline."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from typing import Any

from webloom.kernel.markdown import html_to_markdown
from webloom.kernel.tags import Span, balanced_contents, find_tags, outermost, parse_attributes, spans
from webloom.kernel.text import BLANK, BLANK_CHARS, collapse, decode_entities, strip_html, trim, utf16_len, word_count
from webloom.kernel.url import Url, UrlError, parse, parse_or_none, resolve

_ANY_TAG = re.compile("<[^>]+>")
_TITLE = re.compile(r"<title[^>]*>([\s\S]*?)</title>", re.I | re.A)
_HTML = re.compile(r"<html\b([^>]*)>", re.I | re.A)
_HEAD_END = re.compile("</head>", re.I | re.A)
_ANCHOR_END = re.compile("</a>", re.I | re.A)
_JSON_LD = re.compile(rf"""<script(?![A-Za-z0-9_])[^>]*type[{BLANK}]*=[{BLANK}]*["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", re.I | re.A)
#: Where the main content is looked for.
LEAST_CONTENT = 200
CONTAINERS = ("div", "section", "article", "main")
CMS_CLASSES = ("post-content", "entry-content", "article-content", "article-body", "story-body", "article__body", "markdown-body")
_CMS = re.compile(rf"""(?<![A-Za-z0-9_])class[{BLANK}]*=[{BLANK}]*["'][^"']*(?<![A-Za-z0-9_])(?:{"|".join(CMS_CLASSES)})(?![A-Za-z0-9_])[^"']*["']""", re.I | re.A)
_ITEMPROP = re.compile(rf"""(?<![A-Za-z0-9_])itemprop[{BLANK}]*=[{BLANK}]*["']articleBody["']""", re.I | re.A)
#: References that are no links.
NOT_LINKS = ("javascript:", "mailto:", "tel:", "data:", "file:")


# Links


def _host(url: Url) -> str:
    return url.netloc.lower().removeprefix("www.")


def extract_links(html: str, page_url: str) -> list[dict[str, Any]]:
    """Links in document order: href (absolute), text, rel, title, type internal or external."""
    base = parse_or_none(page_url)
    first = next(find_tags(html, "base"), None)
    if first is not None and (href := parse_attributes(first.attributes).get("href")):
        try:
            base = parse(href, base)
        except UrlError:
            pass
    own = _host(base) if base else ""
    out, end = [], _ANCHOR_END.search(html)
    for tag in find_tags(html, "a"):
        if end is not None and end.start() < tag.content:
            end = _ANCHOR_END.search(html, tag.content)
        attributes = parse_attributes(tag.attributes)
        href = trim(attributes.get("href", ""))
        if not href or href.startswith("#") or href.lower().startswith(NOT_LINKS):
            continue
        try:
            url = parse(href, base)
        except UrlError:
            continue
        text = decode_entities(collapse(_ANY_TAG.sub(" ", html[tag.content : end.start()]))) if end else ""
        out.append(
            {
                "href": str(url),
                "text": text,
                "rel": attributes.get("rel") or None,
                "title": attributes.get("title") or None,
                "type": "internal" if own and _host(url) == own else "external",
            }
        )
    return out


# Metadata


def _title_in(html: str) -> str | None:
    m = _TITLE.search(html)
    return decode_entities(collapse(m[1])) if m else None


class _Bag:
    """First value of each key, and all values of keys that have several."""

    def __init__(self) -> None:
        self.values: dict[str, list[str]] = {}

    def add(self, key: str, value: str) -> None:
        self.values.setdefault(key, []).append(value)

    def first(self) -> dict[str, str]:
        return {k: v[0] for k, v in self.values.items()}

    def several(self) -> dict[str, list[str]]:
        return {k: v for k, v in self.values.items() if len(v) > 1}


def json_ld(html: str) -> list[str]:
    """The JSON-LD blocks of the whole document that can be read, each as JSON text."""
    out = []
    for m in _JSON_LD.finditer(html):
        if trim(m[1]):
            try:
                out.append(json.dumps(json.loads(m[1].strip(BLANK_CHARS)), ensure_ascii=False, separators=(",", ":")))
            except ValueError:
                continue
    return out


def page_meta(html: str, url: str) -> dict[str, Any]:
    """Title, description, canonical, language, robots, og/twitter/article values, icons, feeds, JSON-LD."""
    end = _HEAD_END.search(html)
    head = html[: end.start()] if end else html
    lang = _HTML.search(html)
    bags = {"og": _Bag(), "twitter": _Bag(), "article": _Bag()}
    single: dict[str, str | None] = {"description": None, "robots": None}
    for tag in find_tags(head, "meta"):
        a = parse_attributes(tag.attributes)
        name = next((a[k] for k in ("property", "name", "itemprop") if k in a), "").lower()
        value = a.get("content")
        if not name or value is None:
            continue
        if name in single and single[name] is None:
            single[name] = value
        kind, _, key = name.partition(":")
        if kind in bags and ":" in name:
            bags[kind].add(key, value)
    absolute = lambda href: resolve(href, url) or href
    canonical, icons, feeds = None, [], []
    for tag in find_tags(head, "link"):
        a = parse_attributes(tag.attributes)
        rel, href = a.get("rel", "").lower(), a.get("href")
        if not rel or not href:
            continue
        if rel == "canonical" and canonical is None:
            canonical = absolute(href)
        if "icon" in rel:
            icons.append({"rel": rel, "href": absolute(href), "sizes": a.get("sizes")})
        if rel == "alternate" and re.search("rss|atom|xml|json", a.get("type", "")):
            feeds.append({"href": absolute(href), "title": a.get("title"), "type": a.get("type")})
    return {
        "url": url,
        "title": _title_in(head),
        "description": single["description"],
        "canonical": canonical,
        "language": parse_attributes(lang[1]).get("lang") if lang else None,
        "robots": single["robots"],
        **{k: b.first() for k, b in bags.items()},
        **{f"{k}_all": b.several() for k, b in bags.items()},
        "icons": icons,
        "feeds": feeds,
        "json_ld": json_ld(html),
    }


# Main content


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


class _Units:
    """Lengths of parts of a text in UTF-16 units, each at the cost of a search in the places of letters of two units."""

    def __init__(self, text: str) -> None:
        self.wide = [] if text.isascii() else [m.start() for m in _ASTRAL.finditer(text)]

    def between(self, start: int, end: int) -> int:
        return end - start + (bisect_left(self.wide, end) - bisect_left(self.wide, start) if self.wide else 0)


def _longest(found: list[Span], units: _Units) -> str | None:
    """The longest of the outermost elements' contents without blanks around; of equal ones the first."""
    best, most = None, LEAST_CONTENT
    for span in outermost(found):
        inside = trim(span.text)
        if len(inside) > most or units.wide and utf16_len(inside) > most:
            best, most = inside, utf16_len(inside)
    return best


def _container(found: dict[str, list[Span]], fits: re.Pattern[str], units: _Units) -> str | None:
    """The longest content of an element whose attributes match, nested ones too; of equal ones the first found."""
    best, most = None, 0
    for name in CONTAINERS:
        for span in found[name]:
            if span.content is None:  # no tag is told from text any more
                break
            if span.end is not None and (n := units.between(span.content, span.end)) > most and fits.search(span.attributes):
                best, most = span, n
    return best.text if best is not None and most > LEAST_CONTENT else None


def main_content(html: str) -> tuple[str, str]:
    """(how it was found, the markup of the main content)."""
    found, units = spans(html, (*CONTAINERS, "body")), _Units(html)
    for name in ("article", "main"):
        if (content := _longest(found[name], units)) is not None:
            return name, content
    for how, fits in (("itemprop", _ITEMPROP), ("class", _CMS)):
        if (content := _container(found, fits, units)) is not None:
            return how, content
    body = next((span.text for span in outermost(found["body"])), "")
    return ("body", body) if body else ("document", html)


def _meta_value(tags: list[dict[str, str]], keys: tuple[str, ...], wanted: str) -> str | None:
    """The first non-empty content of a meta tag whose first present key has the value."""
    for a in tags:
        named = next((a[k] for k in keys if k in a), "")
        if named.lower() == wanted and a.get("content"):
            return decode_entities(trim(a["content"]))
    return None


def page_title(html: str) -> str | None:
    tags = [parse_attributes(t.attributes) for t in find_tags(html, "meta")]
    for found in (_meta_value(tags, ("property", "name"), "og:title"), _title_in(html)):
        if found is not None:
            return found
    first = next((c for _, c in balanced_contents(html, "h1")), None)
    return (strip_html(first) or None) if first is not None else None


def page_byline(html: str) -> str | None:
    tags = [parse_attributes(t.attributes) for t in find_tags(html, "meta")]
    by_name = _meta_value(tags, ("name",), "author")
    return by_name if by_name is not None else _meta_value(tags, ("property",), "article:author")


def read_article(html: str, url: str) -> dict[str, Any]:
    """title, byline, word_count and markdown of the main content."""
    markdown = html_to_markdown(main_content(html)[1])
    return {"url": url, "title": page_title(html), "byline": page_byline(html), "word_count": word_count(markdown), "markdown": markdown}
