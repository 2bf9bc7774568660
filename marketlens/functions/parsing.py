"""Model responses: untrusted text that may or may not be JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


def parsed_object(c: Column | str) -> Column:
    """VARIANT of a JSON object, NULL for invalid JSON and for any other JSON value."""
    raw = F.col(c) if isinstance(c, str) else c
    return F.when(raw.rlike(r"^\s*\{"), F.try_parse_json(raw))


def field(v: Column, name: str, type_: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", type_)


def compact_json(c: Column) -> Column:
    """The one JSON value a text holds, without spaces and in its own key order; else NULL.

    A JSON reader stops after the first value. Only a single value reads the same as the
    item of an array and as the field of an object, so text around it gives NULL, as do
    repeated keys.
    """
    item = F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$")
    field_ = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$")
    value = F.substring(item, F.lit(2), F.length(item) - 2)
    single = value == F.substring(field_, F.lit(6), F.length(field_) - 6)
    return F.when(F.try_parse_json(c).isNotNull() & single, value)


def response_normalize(c: Column | str) -> Column:
    """JSON in compact form and its own key order; anything else is stripped text."""
    raw = F.col(c) if isinstance(c, str) else c
    return F.coalesce(compact_json(raw), strip(raw))
