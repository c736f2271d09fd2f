"""Results as text, for readers rather than programs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.kernels import kernel
from webloom.functions.schemas import STRING
from webloom.functions.text import display_cap

_pretty = kernel(lambda text: json.dumps(json.loads(text), indent=2, ensure_ascii=False), STRING)


def response_text(r: Column, pretty_json: Column) -> Column:
    """A response struct as lines: status, URL, duration, sorted headers, then the body's best form."""
    keys = F.array_sort(F.map_keys(r["headers"]))
    headers = F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at(r["headers"], k)))
    encoded = F.base64(r["body"])
    body = (
        F.when(r["json"].isNotNull(), F.array(F.lit("--- Body (parsed JSON) ---"), display_cap(pretty_json)))
        .when(r["body_text"].isNotNull(), F.array(F.lit("--- Body ---"), display_cap(r["body_text"])))
        .when(r["body"].isNotNull(), F.array(F.concat(F.lit("--- Body (base64, "), F.length(encoded).cast("string"), F.lit(" chars) ---")), display_cap(encoded)))
        .otherwise(F.array().cast("array<string>"))
    )
    hops = F.size(r["redirects"])
    lines = F.concat(
        F.array(F.rtrim(F.concat_ws(" ", F.lit("HTTP/1.1"), r["status"].cast("string"), r["status_text"])), F.concat(F.lit("URL: "), r["url"])),
        F.when(hops > 0, F.array(F.concat(F.lit("Redirects: "), hops.cast("string"), F.lit(" hop(s)")))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("Duration: "), r["duration_ms"].cast("string"), F.lit("ms")), F.lit(""), F.lit("--- Headers ---")),
        headers,
        F.array(F.lit("")),
        F.when(r["truncated"], F.array(F.lit("[body truncated at response-size cap]"))).otherwise(F.array().cast("array<string>")),
        body,
    )
    return F.when(r["error"].isNotNull(), F.concat(F.lit("Request failed: "), r["error"])).otherwise(F.array_join(lines, "\n"))


def rendered(responses: DataFrame) -> DataFrame:
    """request_id, text, is_error of responses (request_id, response)."""
    r = F.col("response")
    rows = responses.select("request_id", "response", _pretty(r["json"]).alias("p"))
    return rows.select("request_id", response_text(r, F.col("p.value")).alias("text"), (r["error"].isNotNull() | ~r["ok"]).alias("is_error"))


def json_text(value: Column) -> Column:
    """A struct, array or map as indented JSON (nulls left out), capped for display."""
    return display_cap(_pretty(F.to_json(value))["value"])


def error_text(message: Column) -> Column:
    return F.concat(F.lit("Error: "), message)
