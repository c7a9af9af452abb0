"""Text of a payload: strings of a JSON document, or the bytes themselves."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nesting beyond this is not taken for JSON.
MAX_DEPTH = 127


class _NotJson(ValueError):
    pass


def _refuse(_: str) -> float:
    raise _NotJson


def _whole(text: str) -> int | float:
    """Integers of 64 bits stay whole; longer ones become floating-point numbers."""
    if len(text) <= 20 and -(1 << 63) <= (n := int(text)) < 1 << 64:
        return n
    return _real(text)


def _real(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise _NotJson
    return x


def _deep(value: object, left: int = MAX_DEPTH) -> bool:
    if isinstance(value, (dict, list)):
        return left <= 0 or any(_deep(v, left - 1) for v in (value.values() if isinstance(value, dict) else value))
    return False


def parse(data: bytes) -> object:
    """Strict JSON value of ``data``; raises ValueError if it is none."""
    try:
        value = json.loads(data.decode("utf-8"), parse_constant=_refuse, parse_int=_whole, parse_float=_real)
    except RecursionError as e:
        raise _NotJson from e
    if _deep(value):
        raise _NotJson
    json.dumps(value, ensure_ascii=False).encode("utf-8")  # a lone surrogate is no text
    return value


def text_of(data: bytes, field: str | None = None) -> str:
    """What is indexed of a payload.

    Not JSON: all of it, whatever ``field`` says. With a field: that top-level
    member if it is a string, else nothing. Otherwise: a string's content, an
    object's top-level strings with blanks between, or compact JSON.
    """
    try:
        value = parse(data)
    except ValueError:
        return data.decode("utf-8", "replace")
    if field is not None:
        got = value.get(field) if isinstance(value, dict) else None
        return got if isinstance(got, str) else ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return " ".join(v for v in value.values() if isinstance(v, str))
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _udf(read: Callable[[bytes, str | None], str]) -> Callable:
    @F.pandas_udf("string")
    def run(data: pd.Series, field: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else read(bytes(d), f) for d, f in zip(data, field, strict=True)], dtype=object)

    return run


def extracted(data: Column, field: Column | str | None = None) -> Column:
    """Column form: ``data`` is binary, ``field`` a name, a column of names or none."""
    name = field if isinstance(field, Column) else F.lit(field).cast("string")
    return _udf(text_of)(data, name)
