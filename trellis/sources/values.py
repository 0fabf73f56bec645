"""Payload values by column type: what each type accepts, as Python values Spark takes."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import types as T

from ..errors import QueryError
from .catalog import Field

_DATE = re.compile(r"(\d{4,})-(\d\d)-(\d\d)")
_TIME = re.compile(r"(\d{4,}-\d\d-\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?\s*(Z|[+-]\d\d(?::?\d\d)?)?)?")
_TRUE = frozenset(("t", "true", "y", "yes", "on", "1"))
_FALSE = frozenset(("f", "false", "n", "no", "off", "0"))
_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def refuse(column: str, value: Any, kind: str) -> QueryError:
    return QueryError("PG_INVALID_TEXT_REPRESENTATION", f"{column}: {json.dumps(value, default=str)} is no {kind}")


def read_value(v: Any, kind: T.DataType, column: str, field: Field = Field()) -> Any:
    """The value of a payload for a column; null stays null."""
    if v is None:
        return None
    bad = refuse(column, v, kind.simpleString())
    if field.json:
        return json.dumps(v, default=float)
    if isinstance(kind, tuple(_RANGES)):
        if isinstance(v, bool) or not (isinstance(v, int) or isinstance(v, str) and re.fullmatch(r"\s*[+-]?\d+\s*", v)):
            raise bad
        n = int(v)
        if not -(1 << _RANGES[type(kind)]) <= n < 1 << _RANGES[type(kind)]:
            raise QueryError("PG_NUMERIC_VALUE_OUT_OF_RANGE", f"{column}: {n} is out of range")
        return n
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
            return float(v)
        if isinstance(v, str) and re.fullmatch(r"\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?inf(inity)?)\s*", v, re.I):
            return float(v)
        raise bad
    if isinstance(kind, T.DecimalType):
        if isinstance(v, bool) or not isinstance(v, (int, float, Decimal, str)):
            raise bad
        try:
            d = Decimal(str(v).strip())
            if not d.is_finite():
                raise bad
            d = d.quantize(Decimal(1).scaleb(-kind.scale), rounding="ROUND_HALF_UP")
        except InvalidOperation as e:
            raise bad from e
        if len(d.as_tuple().digits) > kind.precision:
            raise QueryError("PG_NUMERIC_VALUE_OUT_OF_RANGE", f"{column}: {v} does not fit")
        return d
    if isinstance(kind, T.BooleanType):
        if isinstance(v, bool):
            return v
        text = str(v).strip().lower()
        if isinstance(v, (int, str)) and text in _TRUE | _FALSE:
            return text in _TRUE
        raise bad
    if isinstance(kind, T.StringType):
        if not isinstance(v, str):
            raise bad
        if field.kind == "uuid":
            m = re.fullmatch(r"\{?([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})\}?", v)
            if not m:
                raise bad
            return "-".join(m.groups()).lower()
        if field.enum and v not in field.enum:
            raise bad
        return v
    if isinstance(kind, T.BinaryType):
        if not isinstance(v, str) or not re.fullmatch(r"\\x([0-9a-fA-F]{2})*", v):
            raise bad
        return bytearray.fromhex(v[2:])
    if isinstance(kind, T.DateType):
        if not isinstance(v, str) or not (m := _DATE.fullmatch(v.strip())):
            raise bad
        return _made(dt.date, bad, *map(int, m.groups()))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return _timestamp(v, isinstance(kind, T.TimestampType), bad)
    if isinstance(kind, T.ArrayType):
        if not isinstance(v, list):
            raise bad
        if isinstance(kind.elementType, T.ArrayType) and len({len(x) for x in v if isinstance(x, list)}) > 1:
            raise bad
        return [read_value(x, kind.elementType, column) for x in v]
    if isinstance(kind, T.StructType):
        if not isinstance(v, dict):
            raise bad
        return {f.name: read_value(v.get(f.name), f.dataType, f"{column}.{f.name}") for f in kind}
    return v if isinstance(v, str) else json.dumps(v)


def _made(make, bad: QueryError, *args):
    try:
        return make(*args)
    except ValueError as e:
        raise bad from e


def _timestamp(v: Any, zoned: bool, bad: QueryError) -> dt.datetime:
    if not isinstance(v, str) or not (m := _TIME.fullmatch(v.strip())):
        raise bad
    day, h, mi, s, frac, zone = m.groups()
    date = _made(dt.date.fromisoformat, bad, day)
    hours = int(h or 0)
    if hours > 24 or (hours == 24 and (int(mi or 0) or int(s or 0) or int(frac or 0))):
        raise bad
    out = _made(dt.datetime, bad, date.year, date.month, date.day, hours % 24, int(mi or 0), int(s or 0), int((frac or "0").ljust(6, "0")))
    out += dt.timedelta(days=hours // 24)
    if zoned:
        if zone and zone != "Z":
            digits = zone[1:].replace(":", "").ljust(4, "0")
            away = dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
            out -= away if zone[0] == "+" else -away
        return out.replace(tzinfo=dt.timezone.utc)
    return out


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v))
