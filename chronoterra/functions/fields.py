"""Typed fields over JSON attributes, and the comparisons of feature-service filters as Columns.

A numeric field meets a number through the guarded cast; anything else is compared as text. There is
no text grammar to parse: a caller composes these Columns with & | ~.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import number, prop, whole

#: The kinds that are compared as numbers.
NUMERIC = ("oid", "integer", "double")
_COMPARE = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}


def typed(name: str, kind: str, properties: str = "properties") -> Column:
    """The value of a field by its kind: oid, integer, double, text, globalid, boolean or json (the last two as text)."""
    if kind == "oid":
        return F.col(name).cast("long")
    text = prop(name, properties)
    if kind == "integer":
        return whole(number(text))
    return number(text) if kind == "double" else text


def _is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def date_text(value: date | datetime) -> str:
    """A date or timestamp as the ISO text that attributes are compared with."""
    moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def _literal(v: Any) -> Column:
    if isinstance(v, (date, datetime)):
        return F.lit(date_text(v))
    return F.lit(str(v).lower() if isinstance(v, bool) else str(v))


def _text(name: str, kind: str, properties: str) -> Column:
    return F.col(name).cast("string") if kind == "oid" else prop(name, properties)


def compare(name: str, kind: str, op: str, value: Any, properties: str = "properties") -> Column:
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    if kind in NUMERIC and _is_number(value):
        own = F.col(name).cast("double") if kind == "oid" else number(prop(name, properties))
        return _COMPARE[op](own, F.lit(float(value)))
    return _COMPARE[op](_text(name, kind, properties), _literal(value))


def among(name: str, kind: str, values: list[Any], properties: str = "properties") -> Column:
    """As numbers only if the field and every value are numeric."""
    if not values:
        raise ValueError("a list of values is needed")
    if kind in NUMERIC and all(map(_is_number, values)):
        own = F.col(name).cast("double") if kind == "oid" else number(prop(name, properties))
        return own.isin([float(v) for v in values])
    return _text(name, kind, properties).isin([date_text(v) if isinstance(v, (date, datetime)) else str(v) for v in values])


def matches(name: str, kind: str, pattern: str, properties: str = "properties") -> Column:
    """LIKE without an escape sign: % is any text, _ any character, a backslash itself."""
    parts = [".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern]
    return _text(name, kind, properties).rlike("(?s)^" + "".join(parts) + "$")


def between(name: str, kind: str, low: Any, high: Any, properties: str = "properties") -> Column:
    return compare(name, kind, ">=", low, properties) & compare(name, kind, "<=", high, properties)
