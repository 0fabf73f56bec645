"""Reads spelled as URL query strings, decoded to the JSON form of the same request.

Keys are dotted paths into a relation; where, select, order_by and distinct_on hold expressions, in
which a bare word is a name, a quoted string a literal, and every operator a call by its word.
"""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import parse_qsl

from ..errors import QueryError, invalid
from ..plans.syntax import WORDS

_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*)|(\*~?)|([(),;:-]))")
FORBIDDEN = ("write_mode", "on_conflict", "insert_columns", "update_columns")
PLAIN = ("relation", "function", "schema", "alias")
CONSTANTS = {"true": True, "false": False, "null": None}
#: Words that are operators when called; other called names need ``call``.
OPERATORS = frozenset(WORDS) | frozenset("and or not is_null is_true is_false is_not_null is_not_true is_not_false like ilike in not_in any all between not_between agg call concat_ws coalesce format is_distinct_from is_not_distinct_from index slice bigint numeric".split())


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise invalid(f"cannot read {text[at:at + 20]!r}")
            kind = ("string", "number", "name", "star", "mark")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, mark: str | None = None) -> Any:
        token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return token if mark is None else token == ("mark", mark)

    def take(self, mark: str) -> None:
        if not self.peek(mark):
            raise invalid(f"expected {mark!r}")
        self.at += 1

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise invalid(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self) -> Any:
        kind, text = self.peek()
        if kind not in ("string", "number", "name"):
            raise invalid(f"expected an expression at {text!r}")
        self.at += 1
        if kind == "string":
            return text[1:-1].replace("''", "'")
        if kind == "number":
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if self.peek("("):
            return self._call(text)
        return CONSTANTS[text] if text in CONSTANTS else [".", *text.split(".")]

    def _call(self, name: str) -> Any:
        if name not in OPERATORS:
            raise invalid(f"unknown operator {name!r}")
        self.take("(")
        args: list = []
        while not self.peek(")"):
            args.append(self.expression())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        bare = lambda v: ".".join(v[1:]) if isinstance(v, list) and v and v[0] == "." else v
        if name in ("agg", "aggregate"):
            return ["agg", bare(args[0]), args[1:]]
        if name == "call":
            return ["call", bare(args[0]), *args[1:]]
        if name in ("any", "all"):
            return [name, bare(args[0]), *args[1:]]
        if name == "cast":
            return ["cast", args[0], bare(args[1])]
        return [name, *args]

    def list(self, item) -> list:
        out = [item()]
        while self.peek(","):
            self.take(",")
            out.append(item())
        return out

    def entry(self) -> tuple[str, Any]:
        """``alias:expression``, or a name as its own key."""
        kind, text = self.peek()
        if kind == "name" and self.tokens[self.at + 1: self.at + 2] == [("mark", ":")]:
            self.at += 2
            return text, self.expression()
        e = self.expression()
        if not (isinstance(e, list) and e[0] == "." and len(e) == 2):
            raise invalid("a computed entry needs an alias")
        return e[1], e

    def select(self) -> Any:
        kind, text = self.peek()
        if kind != "star":
            return dict(self.list(self.entry))
        self.at += 1
        out: list = [text]
        if self.peek("("):
            self.take("(")
            if not self.peek(";") and not self.peek(")"):
                out.append([e[1] for e in self.list(self.expression)])
            if self.peek(";"):
                self.take(";")
                out.append(dict(self.list(self.entry)))
            self.take(")")
        return out

    def order(self) -> Any:
        if self.peek("-"):
            self.take("-")
            return ["desc", self.expression()]
        return self.expression()


def _read(text: str, what: str) -> Any:
    r = _Reader(text)
    out = getattr(r, what)() if what in ("expression", "select") else r.list(getattr(r, what.removesuffix("s")))
    r.end()
    return out


def _number(text: str, key: str) -> int:
    if not re.fullmatch(r"-?\d+", text):
        raise invalid(f"{key} is a number")
    return int(text)


def decode(raw: str) -> dict:
    """The JSON form of a query string."""
    tree: dict = {}
    for key, value in parse_qsl(raw.lstrip("?"), keep_blank_values=True):
        at = tree
        *path, last = key.split(".")
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise invalid(f"{key} goes below a value")
        at[last] = value if last not in at else [*(at[last] if isinstance(at[last], list) else [at[last]]), value]
    if "query" in tree or "data" in tree:
        raise QueryError("QUERY_COMPLEX_NOT_ALLOWED_ON_GET", "query strings are plain reads")
    if "wellknown" in tree:
        return {"wellknown": tree["wellknown"], "params": {k: _value(v) for k, v in tree.get("params", {}).items()}}
    return _relation(tree)


def _value(v: Any) -> Any:
    if isinstance(v, list):
        return [_value(x) for x in v]
    if v in CONSTANTS:
        return CONSTANTS[v]
    return int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v


def _relation(tree: dict) -> dict:
    out: dict = {}
    for key, v in tree.items():
        if key in FORBIDDEN:
            raise invalid(f"{key} is for writes")
        if key in PLAIN:
            out[key] = v
        elif key == "on":
            out[key] = dict(v)
        elif key == "where":
            out[key] = _read(v, "expression")
        elif key == "select":
            out[key] = _read(v, "select")
        elif key == "order_by":
            out[key] = _read(v, "orders")
        elif key == "distinct_on":
            out[key] = _read(v, "expressions")
        elif key in ("limit", "offset"):
            out[key] = _number(v, key)
        elif key == "distinct":
            if v not in ("true", "false"):
                raise invalid("distinct is true or false")
            out[key] = v == "true"
        elif key == "join":
            out[key] = {alias: _relation(child) for alias, child in v.items()}
        elif key == "arguments":
            out[key] = {k: _read(x, "expression") for k, x in v.items()} if isinstance(v, dict) else [_read(x, "expression") for x in ([v] if isinstance(v, str) else v)]
        else:
            raise invalid(f"unknown key {key}")
    return out
