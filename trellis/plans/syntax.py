"""Requests as parsed: JSON documents to trees of :class:`Expr` and :class:`Request`.

An expression is a literal, an object, or an array whose first element is a tag. One frozen class
stands for all of them, so that equal expressions are equal keys and aggregates are planned once.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from ..errors import QueryError, invalid

#: Operators by number of operands: fixed values of the query language.
FOLDED = frozenset("and or + - * / ^ % | & -> ->> #> #>> || ||? ?? <= >= < > = <> is_distinct_from is_not_distinct_from".split())
UNARY = frozenset("- not ~ is_null is_true is_false is_not_null is_not_true is_not_false |/ ||/".split())
BINARY = frozenset("like ilike ~ ~* :: && <-> -|- << >> @> <@ ? ?| ?& &< &> ?: @@".split())
COMPARISONS = frozenset("<= >= < > = <> is_distinct_from is_not_distinct_from".split())
#: Words and second spellings of operators: fixed values of the query language.
WORDS = {
    "add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "^", "mod": "%", "bor": "|", "band": "&", "json_get": "->", "json_get_text": "->>",
    "json_path": "#>", "json_path_text": "#>>", "dot": ".", "concat": "||", "concat_coalesce": "||?", "ifnull": "??", "lte": "<=", "gte": ">=",
    "lt": "<", "gt": ">", "eq": "=", "ne": "<>", "!=": "<>", "!==": "is_distinct_from", "===": "is_not_distinct_from", "neg": "-", "bnot": "~",
    "sqrt": "|/", "cbrt": "||/", "match": "~", "imatch": "~*", "cast": "::", "overlap": "&&", "distance": "<->", "adjacent": "-|-", "shl": "<<",
    "shr": ">>", "contains": "@>", "contained_by": "<@", "has_key": "?", "has_any_key": "?|", "has_all_keys": "?&", "overlaps_or_left": "&<",
    "overlaps_or_right": "&>", "op_qcolon": "?:", "matches_ts": "@@", "aggregate": "agg", "arr": "array", "lst": "list",
}
ORDERS = ("asc", "desc", "asc-nulls-first", "desc-nulls-last")
WRITE_MODES = ("insert", "upsert", "merge", "merge-new", "merge-update", "update-existing", "update", "delete", "deleteonly", "readonly")
TYPE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_ ]*(\.[A-Za-z_][A-Za-z0-9_]*)?( ?\(\d+( ?, ?\d+)?\))?( with(out)? time zone)?(\[\])*")


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()

    def walk(self):
        yield self
        for a in self.args:
            for e in a if isinstance(a, tuple) else (a,):
                if isinstance(e, Expr):
                    yield from e.walk()
                elif isinstance(e, tuple):
                    for x in e:
                        if isinstance(x, Expr):
                            yield from x.walk()


def lit(value: Any) -> Expr:
    return Expr("lit", (type(value).__name__, value))


@dataclass(frozen=True)
class Order:
    expr: Expr
    desc: bool = False
    nulls_first: bool = False


@dataclass
class Request:
    """A relation or function, as the request spells it."""

    name: str
    is_function: bool = False
    schema: str | None = None
    alias: str | None = None
    on: dict[str, str] | None = None
    arguments: list[Expr] | dict[str, Expr] | None = None
    where: Expr | None = None
    select: Expr = field(default_factory=lambda: Expr("star", (True, (), ())))
    join: dict[str, Request] = field(default_factory=dict)
    distinct: bool = False
    distinct_on: list[Expr] = field(default_factory=list)
    order_by: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    write_mode: str | None = None
    on_conflict: str | list[str] | None = None
    insert_columns: list[str] | None = None
    update_columns: list[str] | None = None


@dataclass
class Item:
    """One query of a request with its envelope flags."""

    request: Request | None
    wellknown: str | None = None
    params: dict | None = None
    data: Any = None
    has_data: bool = False
    returns: str | None = None
    count: bool = False
    stats: bool = False
    query_plan: bool = False
    sql: bool = False
    rollback: bool = False

    @property
    def enveloped(self) -> bool:
        return self.returns == "none" or self.count or self.stats or self.query_plan or self.sql


def _need(value: Any, kind: type | tuple, what: str):
    if not isinstance(value, kind) or (isinstance(value, bool) and kind in (int, (int, float))):
        raise invalid(f"{what} must be a {kind.__name__ if isinstance(kind, type) else 'number'}")
    return value


def _strings(value: Any, what: str) -> list[str]:
    return [_need(x, str, what) for x in _need(value, list, what)]


def expression(v: Any) -> Expr:
    if v is None or isinstance(v, (bool, int, float, str, Decimal)):
        return lit(v)
    if isinstance(v, dict):
        return Expr("object", tuple((k, expression(x)) for k, x in sorted(v.items())))
    if not isinstance(v, list) or not v or not isinstance(v[0], str):
        raise invalid("an expression is a literal, an object, or an array that begins with a tag")
    tag, rest = WORDS.get(v[0], v[0]), v[1:]
    if tag in ("*", "*~") and v[0] != "mul" and all(isinstance(x, dict) or (isinstance(x, list) and all(isinstance(y, str) for y in x) and (not x or x[0] not in ("col", "."))) for x in rest):
        out: dict[str, Expr] = {}
        without: list[str] = []
        for x in rest:
            if isinstance(x, dict):
                out |= {k: expression(e) for k, e in x.items()}
            else:
                without += x
        return Expr("star", (tag == "*", tuple(without), tuple(sorted(out.items()))))
    if tag in ("-", "~") and len(rest) == 1:
        return Expr("neg" if tag == "-" else "bnot", (expression(rest[0]),))
    if tag == ".":
        return _chain(rest)
    if tag in FOLDED:
        return _fold(tag, rest)
    if tag in UNARY and len(rest) == 1:
        return Expr(tag, (expression(rest[0]),))
    if tag == "::":
        if len(rest) != 2 or not isinstance(rest[1], str) or not TYPE_NAME.fullmatch(rest[1]):
            raise invalid("a cast takes an expression and a type name")
        return Expr("::", (expression(rest[0]), rest[1]))
    if tag in BINARY:
        if len(rest) != 2:
            raise invalid(f"{v[0]} takes two operands")
        if tag == "?:":
            raise invalid("?: has no meaning here")
        return Expr("match" if tag == "~" else tag, tuple(map(expression, rest)))
    return _special(tag, rest)


def _chain(rest: list) -> Expr:
    if not rest or not all(isinstance(x, str) for x in rest[1:]):
        raise invalid(". takes a name or an expression, then names")
    base = rest[0] if isinstance(rest[0], str) else expression(rest[0])
    return Expr(".", (base, *rest[1:]))


def _fold(tag: str, rest: list) -> Expr:
    if not rest:
        raise invalid(f"{tag} takes operands")
    raw = tag in ("#>", "#>>")
    parts = [expression(rest[0]), *(Expr("raw", (json.dumps(x),)) if raw else expression(x) for x in rest[1:])]
    if tag in COMPARISONS and len(parts) > 2:
        pairs = [Expr(tag, (a, b)) for a, b in zip(parts, parts[1:], strict=False)]
        return Expr("and", tuple(pairs))
    return parts[0] if len(parts) == 1 else Expr(tag, tuple(parts))


def _special(tag: str, rest: list) -> Expr:
    n = len(rest)

    def count(*allowed: int) -> None:
        if n not in allowed:
            raise invalid(f"{tag} takes {' or '.join(map(str, allowed))} operands")

    if tag in ("col", "get", "set"):
        count(*((1, 2, 3) if tag == "col" else (1, 2)))
        return Expr(tag, (_need(rest[0], str, tag), *(Expr("default") if x == "default" else expression(x) for x in rest[1:])))
    if tag in ("between", "not_between"):
        count(3)
        return Expr(tag, tuple(map(expression, rest)))
    if tag in ("in", "not_in"):
        if n < 2:
            raise invalid(f"{tag} takes a subject and values")
        return Expr(tag, tuple(map(expression, rest)))
    if tag in ("any", "all"):
        count(3)
        op = WORDS.get(_need(rest[0], str, tag), rest[0])
        if op not in COMPARISONS | {"like", "ilike", "~", "~*"}:
            raise invalid(f"{tag} takes a comparison")
        return Expr(tag, ("match" if op == "~" else op, expression(rest[1]), expression(rest[2])))
    if tag in ("bigint", "numeric"):
        count(1)
        if not re.fullmatch(r"[+-]?\d+" if tag == "bigint" else r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", _need(rest[0], str, tag)):
            raise invalid(f"{rest[0]!r} is no {tag}")
        return lit(int(rest[0]) if tag == "bigint" else Decimal(rest[0]))
    if tag in ("concat_ws", "coalesce", "format", "array", "list"):
        if not n and tag not in ("array", "list"):
            raise invalid(f"{tag} takes operands")
        return Expr("array" if tag == "list" else tag, tuple(map(expression, rest)))
    if tag == "index":
        count(2)
        return Expr(tag, tuple(map(expression, rest)))
    if tag == "slice":
        count(3)
        return Expr(tag, tuple(map(expression, rest)))
    if tag == "call":
        if not n:
            raise invalid("call takes a function")
        return Expr(tag, (*_function(rest[0]), tuple(map(expression, rest[1:]))))
    if tag == "agg":
        count(2, 3)
        options = _need(rest[2], dict, "options of agg") if n == 3 else {}
        if set(options) - {"filter", "distinct", "order_by"}:
            raise invalid("agg takes filter, distinct and order_by")
        order = tuple(order_term(x) for x in _need(options.get("order_by", []), list, "order_by"))
        return Expr(tag, (
            *_function(rest[0]), tuple(map(expression, _need(rest[1], list, "arguments of agg"))),
            expression(options["filter"]) if "filter" in options else None, _need(options.get("distinct", False), bool, "distinct"),
            tuple((o.expr, o.desc, o.nulls_first) for o in order),
        ))
    if tag == "$param":
        count(1, 2)
        if n == 2 and not TYPE_NAME.fullmatch(_need(rest[1], str, "cast of $param")):
            raise invalid(f"{rest[1]!r} is no type name")
        return Expr(tag, (_need(rest[0], str, tag), rest[1] if n == 2 else "jsonb"))
    raise invalid(f"unknown operator {tag!r}")


def _function(v: Any) -> tuple[str | None, str]:
    if isinstance(v, str):
        return None, v
    _need(v, dict, "a function name")
    return v.get("schema"), _need(v.get("name"), str, "a function name")


def order_term(v: Any) -> Order:
    if isinstance(v, list) and len(v) == 2 and v[0] in ORDERS:
        return Order(expression(v[1]), v[0].startswith("desc"), v[0] == "asc-nulls-first")
    return Order(expression(v))


def request(v: Any) -> Request:
    _need(v, dict, "a query")
    if ("relation" in v) == ("function" in v):
        raise invalid("a query names either a relation or a function")
    is_function = "function" in v
    name = _need(v["function" if is_function else "relation"], str, "relation or function")
    if not name:
        raise invalid("a relation's or function's name is empty")
    r = Request(name, is_function)
    for key in ("schema", "alias"):
        if key in v:
            setattr(r, key, _need(v[key], str, key))
    if "on" in v:
        r.on = {k: _need(x, str, "on") for k, x in _need(v["on"], dict, "on").items()}
    if "arguments" in v:
        if not is_function:
            raise invalid("arguments are for functions")
        a = v["arguments"]
        r.arguments = {k: expression(x) for k, x in a.items()} if isinstance(a, dict) else [expression(x) for x in _need(a, list, "arguments")]
    if "where" in v:
        r.where = expression(v["where"])
    if "select" in v:
        r.select = expression(v["select"])
    r.join = {k: request(x) for k, x in sorted(_need(v.get("join", {}), dict, "join").items())}
    r.distinct = _need(v.get("distinct", False), bool, "distinct")
    r.distinct_on = [expression(x) for x in _need(v.get("distinct_on", []), list, "distinct_on")]
    r.order_by = [order_term(x) for x in _need(v.get("order_by", []), list, "order_by")]
    for o in [*(o.expr for o in r.order_by), *r.distinct_on]:
        if o.op == "lit":
            raise invalid("a literal orders nothing")
    for key in ("limit", "offset"):
        if v.get(key) is not None:
            setattr(r, key, _need(v[key], int, key))
    if "write_mode" in v:
        r.write_mode = _need(v["write_mode"], str, "write_mode")
        if r.write_mode not in WRITE_MODES:
            raise invalid(f"unknown write_mode {r.write_mode!r}")
    if "on_conflict" in v:
        r.on_conflict = v["on_conflict"] if isinstance(v["on_conflict"], str) else _strings(v["on_conflict"], "on_conflict")
    for key in ("insert_columns", "update_columns"):
        if key in v:
            setattr(r, key, _strings(v[key], key))
    return r


def items(text: str | bytes | dict | list) -> tuple[list[Item], bool]:
    """The items of a request, and whether it is a sequence."""
    if isinstance(text, (str, bytes)):
        try:
            text = json.loads(text, parse_float=lambda s: Decimal(s) if len(s) > 17 else float(s))
        except ValueError as e:
            raise QueryError("QUERY_MALFORMED_JSON", str(e)) from e
    if isinstance(text, list):
        return [x for v in text for x in items(v)[0]], True
    return [_item(_need(text, dict, "a query"))], False


def _item(v: dict) -> Item:
    if "wellknown" in v:
        if "data" in v:
            raise invalid("a bare well-known query takes no data")
        return Item(None, _need(v["wellknown"], str, "wellknown"), _need(v.get("params", {}), dict, "params"))
    if "query" not in v:
        return Item(request(v))
    q = _need(v["query"], dict, "query")
    item = Item(None, q["wellknown"], q.get("params", {})) if "wellknown" in q else Item(request(q))
    item.has_data, item.data = "data" in v, v.get("data")
    for key in ("count", "stats", "query_plan", "sql", "rollback"):
        setattr(item, key, _need(v.get(key, False), bool, key))
    item.returns = _need(v["returns"], str, "returns") if "returns" in v else None
    if item.returns not in (None, "none", "results"):
        raise QueryError("QUERY_INVALID_RETURNS", f"returns is none or results, not {item.returns!r}")
    if item.returns == "none" and not (item.count or item.stats or item.query_plan or item.sql):
        raise QueryError("QUERY_UNSUPPORTED_RETURNS", "nothing is left to return")
    writes = item.has_data or (item.request is not None and item.request.write_mode == "delete")
    if item.count and writes:
        raise QueryError("QUERY_COUNT_IS_READ_ONLY", "count is for reads")
    if item.stats and not writes:
        raise QueryError("QUERY_STATS_IS_WRITE_ONLY", "stats is for writes")
    if item.stats and item.query_plan:
        raise QueryError("QUERY_STATS_QUERY_PLAN_CONFLICT", "stats and query_plan exclude each other")
    return item
