"""Responses as streams of JSON texts, one a row, read partition by partition."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_BYTES = 64 << 10


def plain(c: Column, kind: T.DataType) -> Column:
    """The form a value has in JSON: bytes as \\x and hexadecimal digits."""
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    if isinstance(kind, T.ArrayType) and _has_bytes(kind):
        return F.transform(c, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.StructType) and _has_bytes(kind):
        return F.when(c.isNotNull(), F.struct(*(plain(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def _has_bytes(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_bytes(kind.elementType)
    return isinstance(kind, T.BinaryType) or isinstance(kind, T.StructType) and any(_has_bytes(f.dataType) for f in kind)


def json_rows(df: DataFrame, scalar: bool = False) -> Iterator[str]:
    """Null fields are kept; with ``scalar`` a row is its only value, bare."""
    names = df.columns
    if not names:
        yield from ("{}" for _ in range(df.count()))
        return
    row = F.struct(*(plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
    for r in df.select(F.to_json(row, {"ignoreNullFields": "false"})).toLocalIterator(prefetchPartitions=True):
        yield r[0][len(names[0]) + 4: -1] if scalar else r[0]


def array_chunks(rows: Iterable[str], held: int = HELD_BYTES) -> Iterator[str]:
    """A JSON array in pieces of about ``held`` characters; a small one, and any error in it, is whole."""
    buffer, size, first = ["["], 0, True
    for r in rows:
        buffer.append(r if first else "," + r)
        size += len(r)
        first = False
        if size >= held:
            yield "".join(buffer)
            buffer, size = [], 0
    buffer.append("]")
    yield "".join(buffer)


def object_chunks(body: dict[str, object], result: Iterable[str] | None, held: int = HELD_BYTES) -> Iterator[str]:
    """An object in pieces: the members of ``body``, then the rows of ``result``."""
    text = json.dumps(body, default=_number, ensure_ascii=False)
    if result is None:
        yield text
        return
    yield text[:-1] + (", " if body else "") + '"result": '
    yield from array_chunks(result, held)
    yield "}"


def _number(v: object) -> object:
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    return str(v)


def values(df: DataFrame, scalar: bool = False) -> Iterator[object]:
    """Rows as Python values, for encodings that keep types."""
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield r[0] if scalar else r.asDict(recursive=True)


def cbor_chunks(rows: Iterable[object], structures: bool = False) -> Iterator[bytes]:
    """A CBOR array of open length, a row at a time; with ``structures`` names are written once."""
    from ..sources.cbor import Structures, dumps

    names = Structures() if structures else None
    yield b"\x9f"
    for r in rows:
        yield dumps(r, names)
    yield b"\xff"
