"""Expressions to Columns, with the meanings of the query language rather than Spark's where they differ:
whole division of integers, ``^`` as power, 1-based array access without errors, null-safe overlap."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid, unknown
from ..functions import jsons, search
from ..functions.scalars import SCALARS, Arg, whole_division
from ..plans.syntax import Expr

if TYPE_CHECKING:
    from .read import Scope

#: Type names of casts: fixed values of the query language.
TYPES = {
    "int2": "smallint", "smallint": "smallint", "int": "int", "int4": "int", "integer": "int", "int8": "bigint", "bigint": "bigint", "float4": "float",
    "real": "float", "float8": "double", "float": "double", "double precision": "double", "numeric": "decimal(38,18)", "decimal": "decimal(38,18)",
    "text": "string", "varchar": "string", "character varying": "string", "char": "string", "bpchar": "string", "name": "string", "uuid": "string",
    "bool": "boolean", "boolean": "boolean", "bytea": "binary", "date": "date", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "interval": "interval day to second", "json": "variant", "jsonb": "variant",
}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spark_type(name: str) -> str:
    base = name.strip().lower()
    depth = 0
    while base.endswith("[]"):
        base, depth = base[:-2].strip(), depth + 1
    m = re.fullmatch(r"([a-z_0-9 .]+?)\s*\((\s*\d+\s*(?:,\s*\d+\s*)?)\)\s*(.*)", base)
    core, size = (f"{m[1]} {m[3]}".strip(), m[2]) if m else (base, "")
    core = core.removeprefix("pg_catalog.")
    if core not in TYPES:
        raise unknown(f"no type {name}")
    out = f"decimal({size if ',' in size else size + ',0'})" if size and core in ("numeric", "decimal") else TYPES[core]
    for _ in range(depth):
        out = f"array<{out}>"
    return out


class Compiler:
    """Compiles expressions of one node; ``scope`` resolves names, ``params`` are those of a named query."""

    def __init__(self, scope: Scope, params: dict | None = None):
        self.scope, self.params = scope, params or {}

    def type_of(self, c: Column) -> T.DataType:
        return self.scope.type_of(c)

    def __call__(self, e: Expr) -> Column:
        handler: Callable | None = getattr(self, f"_{_METHODS.get(e.op, '')}", None)
        if handler is None:
            raise invalid(f"{e.op} is no value here")
        return handler(e)

    # values
    def _lit(self, e: Expr) -> Column:
        value = e.args[1]
        if isinstance(value, int) and not isinstance(value, bool):
            return F.lit(value).cast("int" if -(2**31) <= value < 2**31 else "bigint" if -(2**63) <= value < 2**63 else "decimal(38,0)")
        return F.lit(value)

    def _object(self, e: Expr) -> Column:
        return F.struct(*(self(x).alias(k) for k, x in e.args)) if e.args else F.struct(F.lit(None).cast("string").alias("")).dropFields("")

    def _star(self, e: Expr) -> Column:
        return F.struct(*(c.alias(k) for k, c in self.scope.star(e, self)))

    def _param(self, e: Expr) -> Column:
        name, cast = e.args
        if name not in self.params:
            raise unknown(f"no parameter {name}")
        value = self.params[name]
        if cast in ("json", "jsonb"):
            return F.parse_json(F.lit(json.dumps(value, default=str))) if value is not None else F.lit(None)
        return F.lit(value).cast(spark_type(cast))

    # names
    def _col(self, e: Expr) -> Column:
        c = self.scope.column(e.args[0])
        return F.coalesce(c, self._default(e, 1)) if len(e.args) > 1 else c

    def _set(self, e: Expr) -> Column:
        self.scope.column(e.args[0])
        return F.lit(None)

    def _default(self, e: Expr, i: int) -> Column:
        if e.args[i].op == "default":
            return F.lit(self.scope.relation_field(e.args[0]).default)
        return self(e.args[i])

    def _chain(self, e: Expr) -> Column:
        base, *hops = e.args
        if isinstance(base, str):
            return self.scope.lookup(base, hops, self)
        return self.scope.hop(self(base), hops)

    # folds
    def _and(self, e: Expr) -> Column:
        return self._left(e, lambda a, b: a & b)

    def _or(self, e: Expr) -> Column:
        return self._left(e, lambda a, b: a | b)

    def _left(self, e: Expr, f: Callable[[Column, Column], Column]) -> Column:
        out = self(e.args[0])
        for x in e.args[1:]:
            out = f(out, self(x))
        return out

    def _arithmetic(self, e: Expr) -> Column:
        if e.op == "-" and isinstance(self.type_of(first := self(e.args[0])), T.VariantType):
            known = [self.constant(x) for x in e.args[1:]]
            if None in known:
                raise invalid("keys to leave out are literal")
            gone = [k for (v,) in known for k in (v if isinstance(v, list) else [v])]
            return jsons.edited(jsons.without_all(gone), jsons.text(first, T.VariantType()))
        return self._left(e, {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b, "^": F.pow,
                              "|": lambda a, b: a.bitwiseOR(b), "&": lambda a, b: a.bitwiseAND(b)}[e.op])

    def _divide(self, e: Expr) -> Column:
        def over(a: Column, b: Column) -> Column:
            kinds = self.type_of(a), self.type_of(b)
            return whole_division(a, b, kinds) if all(isinstance(k, INTEGRAL) for k in kinds) else a / b
        return self._left(e, over)

    def _compare(self, e: Expr) -> Column:
        return self.compare(e.op, self(e.args[0]), self(e.args[1]))

    @staticmethod
    def compare(op: str, a: Column, b: Column) -> Column:
        return {
            "<=": lambda: a <= b, ">=": lambda: a >= b, "<": lambda: a < b, ">": lambda: a > b, "=": lambda: a == b, "<>": lambda: a != b,
            "is_distinct_from": lambda: ~a.eqNullSafe(b), "is_not_distinct_from": lambda: a.eqNullSafe(b),
            "like": lambda: F.like(a, b), "ilike": lambda: F.ilike(a, b), "match": lambda: F.regexp_like(a, b), "~*": lambda: F.regexp_like(a, F.concat(F.lit("(?i)"), b)),
        }[op]()

    def _concat(self, e: Expr) -> Column:
        def join(a: Column, b: Column) -> Column:
            if isinstance(self.type_of(a), T.ArrayType):
                return F.concat(a, b) if isinstance(self.type_of(b), T.ArrayType) else F.array_append(a, b)
            if isinstance(self.type_of(b), T.ArrayType):
                return F.array_prepend(b, a)
            if isinstance(self.type_of(a), T.VariantType) or isinstance(self.type_of(b), T.VariantType):
                return jsons.edited(jsons.merged, *(jsons.text(x, self.type_of(x)) for x in (a, b)))
            return F.concat(a.cast("string"), b.cast("string"))
        return self._left(e, join)

    def _concat_coalesce(self, e: Expr) -> Column:
        return F.concat(*(F.coalesce(self(x).cast("string"), F.lit("")) for x in e.args))

    def _coalesce(self, e: Expr) -> Column:
        return F.coalesce(*map(self, e.args))

    # JSON
    def variant(self, c: Column) -> Column:
        return c if isinstance(self.type_of(c), T.VariantType) else F.parse_json(c)

    def _json(self, e: Expr) -> Column:
        out = self(e.args[0])
        text = e.op in ("->>", "#>>")
        steps: list = []
        for x in e.args[1:]:
            value = json.loads(x.args[0]) if x.op == "raw" else x.args[1] if x.op == "lit" else None
            if value is None:
                raise invalid(f"{e.op} takes literal keys")
            steps += value if isinstance(value, list) else [value]
        path = jsons.path([s if isinstance(s, int) else str(s) for s in steps], index_digits=e.op in ("#>", "#>>"))
        return F.try_variant_get(self.variant(out), path, "string" if text else "variant")

    def _keys(self, e: Expr) -> Column:
        c, wanted = self(e.args[0]), self(e.args[1])
        kind = self.type_of(c)
        keys = c if isinstance(kind, T.ArrayType) else F.json_object_keys(F.to_json(c) if isinstance(kind, T.VariantType) else c)
        if e.op == "?":
            return F.coalesce(F.array_contains(keys, wanted), F.when(c.isNotNull(), F.lit(False)))
        if e.op == "?|":
            return F.coalesce(F.arrays_overlap(keys, wanted), F.when(c.isNotNull() & wanted.isNotNull(), F.lit(False)))
        return F.coalesce(F.size(F.array_except(wanted, keys)) == 0, F.when(c.isNotNull() & wanted.isNotNull(), F.lit(False)))

    # unary
    def _unary(self, e: Expr) -> Column:
        x = self(e.args[0])
        return {
            "neg": lambda: -x, "bnot": lambda: F.bitwise_not(x), "not": lambda: ~x, "is_null": x.isNull, "is_not_null": x.isNotNull,
            "is_true": lambda: x.eqNullSafe(True), "is_not_true": lambda: ~x.eqNullSafe(True), "is_false": lambda: x.eqNullSafe(False),
            "is_not_false": lambda: ~x.eqNullSafe(False), "|/": lambda: F.sqrt(x), "||/": lambda: F.cbrt(x),
        }[e.op]()

    # two and more operands
    def _cast(self, e: Expr) -> Column:
        x, to = self(e.args[0]), spark_type(e.args[1])
        if to == "variant":
            kind = self.type_of(x)
            return F.parse_json(x) if isinstance(kind, T.StringType) else x if isinstance(kind, T.VariantType) else F.to_variant_object(x)
        return x.cast(to)

    def _between(self, e: Expr) -> Column:
        low, x, high = map(self, e.args)
        inside = (x >= low) & (x <= high)
        return inside if e.op == "between" else ~inside

    def _in(self, e: Expr) -> Column:
        subject, values = self(e.args[0]), [self(x) for x in e.args[1:]]
        inside = subject.isin(*values)
        return inside if e.op == "in" else ~inside

    def _any(self, e: Expr) -> Column:
        op, subject, array = e.args[0], self(e.args[1]), self(e.args[2])
        test = lambda x: self.compare(op, subject, x)
        return F.exists(array, test) if e.op == "any" else F.forall(array, test)

    def _range(self, c: Column) -> bool:
        kind = self.type_of(c)
        return isinstance(kind, T.StructType) and {"lower", "upper"} <= set(kind.names)

    def _overlap(self, e: Expr) -> Column:
        a, b = map(self, e.args)
        if self._range(a):
            return _before(a, b, False) & _before(b, a, False)
        return F.coalesce(F.arrays_overlap(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(False)))

    def _contains(self, e: Expr) -> Column:
        a, b = map(self, e.args if e.op == "@>" else reversed(e.args))
        if self._range(a):
            if not self._range(b):
                above = F.when(a["lower_inc"], a["lower"] <= b).otherwise(a["lower"] < b)
                below = F.when(a["upper_inc"], a["upper"] >= b).otherwise(a["upper"] > b)
                return (a["lower"].isNull() | above) & (a["upper"].isNull() | below)
            low = a["lower"].isNull() | (b["lower"] > a["lower"]) | ((b["lower"] == a["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))
            high = a["upper"].isNull() | (b["upper"] < a["upper"]) | ((b["upper"] == a["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))
            return F.coalesce(low, F.lit(False)) & F.coalesce(high, F.lit(False))
        if isinstance(self.type_of(a), T.ArrayType):
            return F.size(F.array_except(b, a)) == 0
        sides = e.args if e.op == "@>" else e.args[::-1]
        known = [self.constant(x) for x in sides]
        texts = [jsons.text(c, self.type_of(c)) for c in (a, b)]
        # a literal document is parsed once
        if known[1] is not None and known[0] is None:
            part = json.loads(known[1][0]) if isinstance(known[1][0], str) else known[1][0]
            return jsons.tested(jsons.holding(part), texts[0])
        if known[0] is not None and known[1] is None:
            whole = json.loads(known[0][0]) if isinstance(known[0][0], str) else known[0][0]
            return jsons.tested(jsons.held_by(whole), texts[1])
        return jsons.tested(jsons.holds, *texts)

    def _ranges(self, e: Expr) -> Column:
        a, b = map(self, e.args)
        if e.op in ("<<", ">>") and not self._range(a):
            return F.shiftleft(a, e.args[1].args[1]) if e.op == "<<" else F.shiftright(a, e.args[1].args[1])
        if e.op == "<<":
            return _before(a, b, True)
        if e.op == ">>":
            return _before(b, a, True)
        if e.op == "&<":
            return b["upper"].isNull() | (a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (b["upper_inc"] | ~a["upper_inc"]))
        if e.op == "&>":
            return b["lower"].isNull() | (a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & (b["lower_inc"] | ~a["lower_inc"]))
        meet = lambda x, y: (x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"])
        return F.coalesce(meet(a, b), F.lit(False)) | F.coalesce(meet(b, a), F.lit(False))

    def _distance(self, e: Expr) -> Column:
        a, b = map(self, e.args)
        return F.hypot(a["x"] - b["x"], a["y"] - b["y"])

    def _search(self, e: Expr) -> Column:
        """A text fulfils a query: all words of a text, or what a query function makes of it."""
        text, query = e.args
        if text.op == "call" and text.args[1] == "to_tsvector" and text.args[2]:
            text = text.args[2][-1]
        kind = "plainto_tsquery"
        if query.op == "call" and query.args[1] in search.QUERIES and query.args[2]:
            kind, query = query.args[1], query.args[2][-1]
        known = self.constant(query)
        if known is not None and isinstance(known[0], str):
            return search.matches(self(text), kind, known[0])
        if kind != "plainto_tsquery":
            raise invalid(f"{kind} takes a literal")
        return search.all_words(self(text), self(query))

    def constant(self, e: Expr) -> tuple[Any] | None:
        """The value of a literal or parameter, in a tuple of one; None for anything else."""
        if e.op == "lit":
            return (e.args[1],)
        if e.op == "$param" and e.args[0] in self.params:
            return (self.params[e.args[0]],)
        if e.op == "neg" and (inner := self.constant(e.args[0])) is not None and isinstance(inner[0], (int, float)):
            return (-inner[0],)
        if e.op == "array" and all(self.constant(x) is not None for x in e.args):
            return ([self.constant(x)[0] for x in e.args],)
        return self.constant(e.args[0]) if e.op == "::" else None

    def _concat_ws(self, e: Expr) -> Column:
        sep, *rest = e.args
        return F.call_function("concat_ws", self(sep), *(self(x).cast("string") for x in rest))

    def _format(self, e: Expr) -> Column:
        if e.args[0].op != "lit" or not isinstance(e.args[0].args[1], str):
            raise invalid("format takes a literal pattern")
        args = [self(x).cast("string") for x in e.args[1:]]
        out, at, pattern = [], 0, e.args[0].args[1]
        for part in re.split(r"(%%|%(?:\d+\$)?[sIL])", pattern):
            if part == "%%":
                out.append(F.lit("%"))
            elif m := re.fullmatch(r"%(?:(\d+)\$)?([sIL])", part):
                at = int(m[1]) if m[1] else at + 1
                if at > len(args):
                    raise invalid("format has too few arguments")
                x = args[at - 1]
                if m[2] == "L":
                    out.append(F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")))
                elif m[2] == "I":
                    out.append(F.when(F.regexp_like(x, F.lit("^[a-z_][a-z0-9_$]*$")), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))))
                else:
                    out.append(F.coalesce(x, F.lit("")))
            elif part:
                out.append(F.lit(part))
        return F.concat(*out) if out else F.lit("")

    def _array(self, e: Expr) -> Column:
        return F.array(*map(self, e.args))

    def _index(self, e: Expr) -> Column:
        array, i = map(self, e.args)
        return F.when(i >= 1, F.get(array, i - 1))

    def _slice(self, e: Expr) -> Column:
        array, a, b = map(self, e.args)
        a = F.greatest(a, F.lit(1))
        return F.slice(array, a, F.greatest(b - a + 1, F.lit(0)))

    def _call(self, e: Expr) -> Column:
        schema, name, args = e.args
        planned = []
        for x in args:
            known = self.constant(x)
            planned.append(Arg(self(x), self.type_of, known is not None, known[0] if known else None))
        return self.scope.call(schema, name, planned)

    def _agg(self, e: Expr) -> Column:
        return self.scope.aggregate(e)


def _before(a: Column, b: Column, strictly: bool) -> Column:
    """Range a ends before b begins (strictly left of), or not after b's end begins (for overlap)."""
    if strictly:
        return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))
    return a["lower"].isNull() | b["upper"].isNull() | (a["lower"] < b["upper"]) | ((a["lower"] == b["upper"]) & a["lower_inc"] & b["upper_inc"])


def call_builtin(name: str, args: list[Arg]) -> Column:
    if name not in SCALARS:
        raise unknown(f"no function {name}")
    build, least, most, told = SCALARS[name]
    if not least <= len(args) <= most:
        raise unknown(f"no function {name} takes {len(args)} arguments")
    return build(*args) if told else build(*(a.column for a in args))


#: Which method compiles which operator.
_METHODS = {
    "lit": "lit", "object": "object", "star": "star", "$param": "param", "col": "col", "get": "col", "set": "set", ".": "chain", "and": "and", "or": "or",
    **dict.fromkeys(("+", "-", "*", "%", "^", "|", "&"), "arithmetic"), "/": "divide",
    **dict.fromkeys(("<=", ">=", "<", ">", "=", "<>", "is_distinct_from", "is_not_distinct_from", "like", "ilike", "match", "~*"), "compare"),
    "||": "concat", "||?": "concat_coalesce", "??": "coalesce", "coalesce": "coalesce", **dict.fromkeys(("->", "->>", "#>", "#>>"), "json"),
    **dict.fromkeys(("?", "?|", "?&"), "keys"),
    **dict.fromkeys(("neg", "bnot", "not", "is_null", "is_not_null", "is_true", "is_not_true", "is_false", "is_not_false", "|/", "||/"), "unary"),
    "::": "cast", "between": "between", "not_between": "between", "in": "in", "not_in": "in", "any": "any", "all": "any", "&&": "overlap",
    "@>": "contains", "<@": "contains", **dict.fromkeys(("<<", ">>", "&<", "&>", "-|-"), "ranges"), "<->": "distance", "@@": "search",
    "concat_ws": "concat_ws", "format": "format", "array": "array", "index": "index", "slice": "slice", "call": "call", "agg": "agg",
}
