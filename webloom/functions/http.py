"""Rules of HTTP messages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.kernel.bodies import TEXT_TYPES

#: Fixed values.
RETRY_STATUSES = (408, 425, 429, 500, 501, 502, 503, 504)
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MOST_RETRY_AFTER_MS, MOST_BACKOFF_MS, FIRST_BACKOFF_MS = 60_000, 8_000, 500


def media_type(content_type: Column) -> Column:
    return F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))


def is_text_type(content_type: Column) -> Column:
    """Whether a body of this content type is to be read as text; without a type it is."""
    kind = media_type(content_type)
    return (kind == "") | kind.startswith("text/") | kind.isin(*TEXT_TYPES) | kind.endswith("+json") | kind.endswith("+xml")


def is_json_type(content_type: Column) -> Column:
    kind = media_type(content_type)
    return (kind == "application/json") | kind.endswith("+json")


def charset_of(content_type: Column) -> Column:
    """The charset parameter in lower case, utf-8 without one."""
    found = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r'(?i)charset\s*=\s*"?([^";\s]+)', 1))
    return F.when(found.isin("", "utf8"), "utf-8").when(found == "iso8859-1", "iso-8859-1").otherwise(found)


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """Milliseconds that a Retry-After header asks for, seconds or a date; null if it is neither."""
    value = F.trim(header)
    seconds = F.when(value.rlike(r"^[0-9]+(\.[0-9]+)?$"), value.cast("double"))
    # The weekday in front can't be parsed, and isn't needed.
    date = F.when(value.rlike(r"^[A-Za-z]{3}, [0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8} GMT$"), F.substring(value, 6, 20))
    at = F.unix_millis(F.try_to_timestamp(F.concat(date, F.lit(" UTC")), F.lit("dd MMM yyyy HH:mm:ss z")))
    most = F.lit(MOST_RETRY_AFTER_MS).cast("long")
    # least and greatest pass over nulls, so what is null is kept apart.
    by_date = F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(at - now_ms, most)))
    return F.coalesce(F.when(seconds.isNotNull(), F.least((seconds * 1000).cast("long"), most)), by_date)


def retry_delay_ms(attempt: Column, header: Column, now_ms: Column) -> Column:
    """The wait before the next attempt (from 0): what the server asks for, else doubling from half a second."""
    return F.coalesce(retry_after_ms(header, now_ms), F.least(F.pow(F.lit(2), attempt) * FIRST_BACKOFF_MS, F.lit(MOST_BACKOFF_MS)).cast("long"))


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRY_STATUSES)


def limited_body(body: Column, max_bytes: int) -> tuple[Column, Column]:
    """The first bytes of a body, and whether there were more."""
    return F.substring(body, 1, max_bytes), F.coalesce(F.octet_length(body) > max_bytes, F.lit(False))


def lower_keys(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def json_body(body_text: Column, content_type: Column, truncated: Column) -> Column:
    """The body as a variant if its type is JSON and it is whole; null if it can't be read.

    Of equal keys the last counts only where spark.sql.variant.allowDuplicateKeys is set, else such a body gives null.
    """
    return F.when(is_json_type(content_type) & (body_text != "") & ~truncated, F.try_parse_json(body_text))


def basic_authorization(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8")))
