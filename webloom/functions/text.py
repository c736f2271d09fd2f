"""Text rules as Column expressions; all of them stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.kernel.text import BLANK, DISPLAY_LIMIT, NAMED, STRIP_STEPS


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+\z", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


def strip_html(html: Column) -> Column:
    return trim(reduce(lambda c, step: F.regexp_replace(c, *step), STRIP_STEPS, html))


def decode_named_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), NAMED, c)


def html_title(html: Column) -> Column:
    """The first title element's text; null without one."""
    inner = F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)
    return F.when(html.rlike(r"(?i)<title[^>]*>[\s\S]*?</title>"), decode_named_entities(collapse(inner)))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{BLANK}]+")).cast("long")


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units; Spark's length counts code points."""
    return (F.length(c) + F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))).cast("long")


def display_cap(c: Column, limit: int = DISPLAY_LIMIT) -> Column:
    """At most ``limit`` UTF-16 units and how many were cut off. A letter of two units that the end cuts in two becomes a replacement character."""
    over = utf16_len(c) - limit
    # Only texts with letters above U+FFFF are looked at in their units.
    units = F.substring(F.encode(F.substring(c, 1, limit), "UTF-16BE"), 1, 2 * limit)
    split = F.hex(F.substring(units, 2 * limit - 1, 1)).between("D8", "DB")
    whole = F.decode(F.when(split, F.substring(units, 1, 2 * limit - 2)).otherwise(units), "UTF-16BE")
    kept = F.when(F.length(c) == utf16_len(c), F.substring(c, 1, limit)).otherwise(F.concat(whole, F.when(split, "\ufffd").otherwise("")))
    return F.when(over > 0, F.concat(kept, F.lit("\n\n[... truncated "), over.cast("string"), F.lit(" chars ...]"))).otherwise(c)


def normalized_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")
