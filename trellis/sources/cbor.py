"""CBOR bodies: values to bytes and back, for requests and responses in that form.

Decimals are tag 4, instants tag 1, dates tag 100, UUIDs tag 37; undefined reads as null. Rows with
the same names can be written as structures: names once, under a number, then values alone.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from decimal import Decimal
from typing import Any

from ..errors import QueryError

_EPOCH = dt.date(1970, 1, 1)
#: Tags of structures: fixed values of the record form. The last id would read as the definition's.
DEFINITION, STRUCTURE, MOST_STRUCTURES = 0xDFFF, 0xE000, 0x1FFF


def _head(major: int, n: int) -> bytes:
    for size, mark, form in ((24, None, ""), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < size:
            return bytes([major << 5 | n]) if mark is None else bytes([major << 5 | mark]) + struct.pack(form, n)
    raise ValueError(n)


class Structures:
    """Numbers given to lists of names, in order of first use."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, ...], int] = {}

    def row(self, v: dict) -> bytes:
        names = tuple(v)
        if (known := self.numbers.get(names)) is not None:
            head = _head(6, STRUCTURE + known) + _head(4, len(names))
        elif len(self.numbers) >= MOST_STRUCTURES:
            return _head(5, len(v)) + b"".join(dumps(k) + dumps(x, self) for k, x in v.items())
        else:
            # numbered before its values are written, as these may refer to it
            self.numbers[names] = number = len(self.numbers)
            head = _head(6, DEFINITION) + _head(4, len(names) + 2) + dumps(STRUCTURE + number) + dumps(list(names))
        return head + b"".join(dumps(x, self) for x in v.values())


def dumps(v: Any, rows: Structures | None = None) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[v]
    if isinstance(v, int):
        if -(1 << 64) <= v < 1 << 64:
            return _head(0, v) if v >= 0 else _head(1, -1 - v)
        n = v if v >= 0 else -1 - v
        return _head(6, 2 if v >= 0 else 3) + dumps(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, (bytes, bytearray)):
        return _head(2, len(v)) + bytes(v)
    if isinstance(v, str):
        return _head(3, len(b := v.encode())) + b
    if isinstance(v, Decimal):
        if not v.is_finite():
            return dumps(float(v))
        sign, digits, exponent = v.as_tuple()
        mantissa = int("".join(map(str, digits)) or "0") * (-1 if sign else 1)
        return _head(6, 4) + _head(4, 2) + dumps(exponent) + dumps(mantissa)
    if isinstance(v, uuid.UUID):
        return _head(6, 37) + dumps(v.bytes)
    if isinstance(v, dt.datetime):
        whole = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return _head(6, 1) + dumps(whole.timestamp())
    if isinstance(v, dt.date):
        return _head(6, 100) + dumps((v - _EPOCH).days)
    if isinstance(v, dict):
        return rows.row(v) if rows else _head(5, len(v)) + b"".join(dumps(k) + dumps(x) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return _head(4, len(v)) + b"".join(dumps(x, rows) for x in v)
    raise TypeError(type(v).__name__)


class _Body:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.structures: dict[int, list[str]] = {}

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise QueryError("QUERY_MALFORMED_CBOR", "the body ends early")
        self.at += n
        return self.data[self.at - n: self.at]

    def value(self, depth: int = 0) -> Any:
        if depth > 512:
            raise QueryError("QUERY_MALFORMED_CBOR", "the body nests too deep")
        first = self.take(1)[0]
        major, low = first >> 5, first & 31
        if low in (28, 29, 30):
            raise QueryError("QUERY_MALFORMED_CBOR", "a reserved length")
        if major == 7:
            return self._simple(low)
        if low == 31:
            return self._open(major, depth)
        n = low if low < 24 else int.from_bytes(self.take(1 << low - 24), "big")
        if major < 2:
            return n if major == 0 else -1 - n
        if major == 2:
            return self.take(n)
        if major == 3:
            try:
                return self.take(n).decode()
            except UnicodeDecodeError as e:
                raise QueryError("QUERY_MALFORMED_CBOR", "text is not UTF-8") from e
        if major == 4:
            return [self.value(depth + 1) for _ in range(self._few(n))]
        if major == 5:
            return {self._key(depth): self.value(depth + 1) for _ in range(self._few(n))}
        if DEFINITION <= n < STRUCTURE + MOST_STRUCTURES:
            return self._structure(n, self.value(depth + 1) if n != DEFINITION else None, depth)
        return self._tag(n, self.value(depth + 1))

    def _structure(self, tag: int, values: Any, depth: int) -> dict:
        bad = QueryError("QUERY_MALFORMED_CBOR", "a structure that does not hold together")
        if tag == DEFINITION:
            first = self.take(1)[0]
            low = first & 31
            if first >> 5 != 4 or low > 27:
                raise bad
            n = low if low < 24 else int.from_bytes(self.take(1 << low - 24), "big")
            if n < 2:
                raise bad
            # names are known before the values, which may refer to them
            tag, names = self.value(depth + 1), self.value(depth + 1)
            if not isinstance(names, list) or not all(isinstance(k, str) for k in names) or len(set(names)) < len(names) or len(names) != n - 2 or not isinstance(tag, int):
                raise bad
            self.structures[tag] = names
            values = [self.value(depth + 1) for _ in names]
        names = self.structures.get(tag)
        if names is None or not isinstance(values, list) or len(values) != len(names):
            raise bad
        return dict(zip(names, values, strict=True))

    def _few(self, n: int) -> int:
        if n > len(self.data) - self.at:
            raise QueryError("QUERY_MALFORMED_CBOR", "the body ends early")
        return n

    def _key(self, depth: int) -> str:
        k = self.value(depth + 1)
        if not isinstance(k, str):
            raise QueryError("QUERY_MALFORMED_CBOR", "keys are text")
        return k

    def _simple(self, low: int) -> Any:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True, 22: None, 23: None}[low]
        if low in (25, 26, 27):
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], self.take({25: 2, 26: 4, 27: 8}[low]))[0]
        raise QueryError("QUERY_MALFORMED_CBOR", "an unknown simple value")

    def _open(self, major: int, depth: int) -> Any:
        parts = []
        if major not in (2, 3, 4, 5):
            raise QueryError("QUERY_MALFORMED_CBOR", "an open length of no container")
        while True:
            if self.at < len(self.data) and self.data[self.at] == 0xFF:
                self.at += 1
                break
            parts.append((self._key(depth), self.value(depth + 1)) if major == 5 else self.value(depth + 1))
        if major == 4:
            return parts
        return dict(parts) if major == 5 else (b"" if major == 2 else "").join(parts)

    @staticmethod
    def _tag(n: int, v: Any) -> Any:
        try:
            if n in (2, 3):
                i = int.from_bytes(v, "big")
                return i if n == 2 else -1 - i
            if n == 4:
                return Decimal(v[1]).scaleb(v[0])
            if n == 1:
                return dt.datetime.fromtimestamp(v, dt.timezone.utc).isoformat()
            if n == 100:
                return (_EPOCH + dt.timedelta(days=v)).isoformat()
            if n == 37:
                return str(uuid.UUID(bytes=v))
        except (TypeError, ValueError, OverflowError, IndexError) as e:
            raise QueryError("QUERY_MALFORMED_CBOR", f"tag {n} holds no such value") from e
        if n == 0:
            return v
        raise QueryError("QUERY_MALFORMED_CBOR", f"tag {n} is not read")


def loads(data: bytes) -> Any:
    body = _Body(data)
    out = body.value()
    if body.at != len(data):
        raise QueryError("QUERY_MALFORMED_CBOR", "bytes follow the body")
    return out
