"""Bodies of responses: whether they are text, and by which charset."""

from __future__ import annotations

import codecs
import re

#: Exact types that are text, besides text/* and those that end in +json or +xml.
TEXT_TYPES = ("application/json", "application/xml", "application/xhtml+xml", "application/javascript", "application/ecmascript", "application/x-www-form-urlencoded")
#: Labels whose meaning on the web isn't their name's, or that need their byte order mark dropped.
LABELS = {"utf8": "utf-8-sig", "utf-8": "utf-8-sig", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}
_CHARSET = re.compile(r"charset\s*=\s*\"?([^\";\s]+)", re.I)


def media_type(content_type: str) -> str:
    return content_type.lower().partition(";")[0].strip()


def is_text_type(content_type: str) -> bool:
    kind = media_type(content_type)
    return not kind or kind.startswith("text/") or kind in TEXT_TYPES or kind.endswith(("+json", "+xml"))


def is_json_type(content_type: str) -> bool:
    kind = media_type(content_type)
    return kind == "application/json" or kind.endswith("+json")


def charset_of(content_type: str) -> str:
    m = _CHARSET.search(content_type)
    return m[1].lower() if m else "utf-8"


def decode_bytes(body: bytes, content_type: str) -> str:
    """As text by the charset of the type, bad bytes replaced; unknown charsets are UTF-8."""
    label = charset_of(content_type)
    label = LABELS.get(label, label)
    try:
        if codecs.lookup(label)._is_text_encoding:
            return body.decode(label, "replace")
    except (LookupError, UnicodeError):
        pass
    return body.decode("utf-8-sig", "replace")
