"""Functions that ``call`` knows, on Columns. Names and meanings are those of the query language."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid
from . import jsons, patterns

S = "string"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Functions that requests never call unless a catalog says otherwise: fixed values of the language.
DENIED = frozenset("""set_config pg_sleep pg_terminate_backend pg_cancel_backend pg_advisory_lock pg_advisory_lock_shared pg_advisory_xact_lock
pg_advisory_xact_lock_shared pg_try_advisory_lock pg_try_advisory_lock_shared pg_try_advisory_xact_lock pg_try_advisory_xact_lock_shared""".split())


class Arg:
    """An argument as planned: its Column, its type, and its value where it is a literal."""

    def __init__(self, column: Column, type_of: Callable[[Column], T.DataType], literal: bool = False, value: Any = None):
        self.column, self._type_of, self.literal, self.value = column, type_of, literal, value

    @property
    def kind(self) -> T.DataType:
        return self._type_of(self.column)

    def told(self, what: str) -> Any:
        if not self.literal:
            raise invalid(f"{what} must be a literal")
        return self.value


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    """1-based; characters before the first count against the length."""
    if n is None:
        return F.substring(s, F.greatest(start, F.lit(1)).cast("int"), F.length(s))
    end = start + n
    begin = F.greatest(start, F.lit(1))
    return F.substring(s, begin.cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def _split_part(s: Column, by: Column, n: Column) -> Column:
    return F.split_part(s, by, n.cast("int"))


def _side(left: bool) -> Callable:
    def f(s: Column, n: Column) -> Column:
        size = F.length(s)
        keep = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(F.least(n, size)).cast("int")
        return F.substring(s, F.lit(1), keep) if left else F.substring(s, (size - keep + 1).cast("int"), keep)
    return f


def _trunc(x: Arg, n: Arg | None = None) -> Column:
    """Towards zero; integers stay what they are, and decimals exact."""
    c, kind = x.column, x.kind
    if n is None:
        return c if isinstance(kind, INTEGRAL) else F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast(kind if isinstance(kind, T.DecimalType) else "double")
    if isinstance(kind, (*INTEGRAL, T.DecimalType)) and n.literal:
        places = int(n.value)
        exact = c.cast(T.DecimalType(38, max(kind.scale, 0))) if isinstance(kind, T.DecimalType) else c.cast("decimal(38,0)")
        step = F.lit(10 ** abs(places)).cast("decimal(38,0)")
        if places >= (kind.scale if isinstance(kind, T.DecimalType) else 0):
            return c
        cut = lambda y: F.when(y < 0, F.ceil(y)).otherwise(F.floor(y))
        return (cut(exact * step) / step).cast(kind) if places >= 0 else (cut(exact / step) * step).cast(kind)
    scale = F.pow(F.lit(10.0), n.column)
    return F.when(c < 0, F.ceil(c * scale)).otherwise(F.floor(c * scale)) / scale


def whole_division(a: Column, b: Column, kinds: tuple[T.DataType, T.DataType]) -> Column:
    """Exact division of integers, towards zero."""
    wide = "bigint" if any(isinstance(k, T.LongType) for k in kinds) else "int"
    return ((a - a % b).cast("decimal(20,0)") / b).cast(wide)


def _div(a: Arg, b: Arg) -> Column:
    kinds = a.kind, b.kind
    if all(isinstance(k, INTEGRAL) for k in kinds):
        return whole_division(a.column, b.column, kinds)
    if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
        return F.floor(F.abs(a.column / b.column)) * F.signum(a.column / b.column)
    return ((a.column - a.column % b.column) / b.column).cast("decimal(38,0)")


def _groups(pattern: str) -> int:
    """How many groups a pattern captures."""
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def _flagged(pattern: str, flags: str) -> str:
    """A point stands for any character, line ends too, unless a flag tells otherwise."""
    return "(?" + ("" if set(flags) & set("np") else "s") + ("i" if "i" in flags else "") + ("m" if set(flags) & set("nmw") else "") + ("x" if "x" in flags else "") + ")"


def _replacement(to: str, shift: int) -> str:
    """References of a replacement as Java's, to groups that lie ``shift`` further on."""
    def one(m: re.Match) -> str:
        if m[0] == "$":
            return r"\$"
        if m[1].isdigit():
            return "${trellism}" if m[1] == "0" else f"${int(m[1]) + shift}"
        return "${trellism}" if m[1] == "&" else "\\" * 2 + (m[1] if m[1] not in "\\$" else r"\$" if m[1] == "$" else "")
    return re.sub(r"\\(.)|\$", one, to, flags=re.S)


def _regexp_replace(s: Arg, pattern: Arg, to: Arg, flags: Arg | None = None) -> Column:
    """The first match, or with flag g every one; \\1 to \\9 stand for groups, \\& for the match."""
    p, new, said = pattern.told("a pattern"), to.told("a replacement"), flags.told("flags") if flags else ""
    if p is None or new is None or said is None:
        return F.lit(None).cast(S)
    # the match is a group of its own, with the text before it as another for the first match alone
    lead = 1 if "g" in said else 2
    own = re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + lead}", p)
    if "g" in said:
        return F.regexp_replace(s.column, F.lit(f"{_flagged(p, said)}(?<trellism>{own})"), F.lit(_replacement(new, 1)))
    bounded = f"(?s)\\A(?<trellisa>.*?){_flagged(p, said)}(?<trellism>{own})(?s)(?<trellisz>.*)\\z"
    return F.regexp_replace(s.column, F.lit(bounded), F.lit("${trellisa}" + _replacement(new, 2) + "${trellisz}"))


def _regexp_match(s: Arg, pattern: Arg, flags: Arg | None = None) -> Column:
    """The groups of the first match, or all of it where the pattern has none; null without a match."""
    p = pattern.told("a pattern")
    if p is None:
        return F.lit(None).cast("array<string>")
    own, n = _flagged(p, flags.told("flags") if flags else "") + p, _groups(p)
    found = [F.regexp_extract(s.column, own, i) for i in range(1 if n else 0, n + 1)]
    return F.when(F.regexp_like(s.column, F.lit(own)), F.array(*found))


def _regexp_split(s: Arg, pattern: Arg, flags: Arg | None = None) -> Column:
    p = pattern.told("a pattern")
    return F.split(s.column, _flagged(p, flags.told("flags") if flags else "") + p, -1)


def _regexp_like(s: Arg, pattern: Arg, flags: Arg | None = None) -> Column:
    p = pattern.told("a pattern")
    return F.regexp_like(s.column, F.lit(_flagged(p, flags.told("flags") if flags else "") + p))


def _to_char(x: Arg, pattern: Arg) -> Column:
    p, kind = pattern.told("a pattern"), x.kind
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return patterns.date_text(x.column, p)
    if isinstance(kind, T.NumericType):
        return patterns.number_text(x.column, p)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast(S)
    raise invalid("to_char takes a date, a time or a number")


def _to_date(s: Arg, pattern: Arg) -> Column:
    return F.to_date(s.column, patterns.date_pattern(pattern.told("a pattern")))


def _to_timestamp(s: Arg, pattern: Arg | None = None) -> Column:
    if pattern is not None:
        return F.to_timestamp(s.column, patterns.date_pattern(pattern.told("a pattern")))
    return F.timestamp_seconds(s.column) if isinstance(s.kind, T.NumericType) else F.to_timestamp(s.column)


def _build_object(*args: Arg) -> Column:
    if len(args) % 2:
        raise invalid("an object is built of keys and values")
    pairs = list(zip(args[::2], args[1::2], strict=True))
    if not pairs:
        return F.parse_json(F.lit("{}"))
    values = [jsons.variant_of(v.column, v.kind) for _, v in pairs]
    if all(k.literal and k.value is not None for k, _ in pairs):
        last = {str(k.value): v for (k, _), v in zip(pairs, values, strict=True)}  # of equal keys the last counts
        return F.to_variant_object(F.struct(*(v.alias(k) for k, v in last.items())))
    return F.to_variant_object(F.map_from_arrays(F.array(*(k.column.cast(S) for k, _ in pairs)), F.array(*values)))


def _build_array(*args: Arg) -> Column:
    return F.to_variant_object(F.array(*(jsons.variant_of(a.column, a.kind) for a in args))) if args else F.parse_json(F.lit("[]"))


def _extract_path(as_text: bool) -> Callable[..., Column]:
    def f(j: Arg, *steps: Arg) -> Column:
        return F.try_variant_get(jsons.read(j.column, j.kind), jsons.path([str(s.told("a step of a path")) for s in steps]), "string" if as_text else "variant")
    return f


def _steps(a: Arg) -> list[str]:
    value = a.told("a path")
    return [str(x) for x in (value if isinstance(value, list) else [x.strip().strip('"') for x in value.strip().removeprefix("{").removesuffix("}").split(",") if x.strip()])]


def _placed(insert: bool) -> Callable[..., Column]:
    def f(j: Arg, at: Arg, new: Arg, flag: Arg | None = None) -> Column:
        told = flag.told("a flag") if flag else not insert
        change = jsons.placed(_steps(at), bool(told) or insert, insert, after=insert and bool(told))
        return jsons.edited(change, jsons.text(j.column, j.kind), jsons.text(new.column, new.kind))
    return f


def _json(f: Callable[[Column], Column]) -> Callable[[Arg], Column]:
    """A function of JSON text, on documents of either form."""
    return lambda j: f(jsons.text(j.column, j.kind))


def _bound(of: str, other: Callable[[Column], Column]) -> Callable[[Arg], Column]:
    """lower and upper are of ranges, or of text."""
    return lambda x: x.column[of] if isinstance(x.kind, T.StructType) and of in x.kind.names else other(x.column)


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, as many as 64-bit integers can need."""
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).otherwise(0).alias("b")))
    return F.reduce(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def _array_length(a: Column, dim: Column | None = None) -> Column:
    return F.when(F.size(a) > 0, F.size(a))


def _epoch(x: Column) -> Column:
    """Seconds since 1970, by the clock that the value shows."""
    return F.unix_date(x.cast("date")).cast("double") * 86_400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.extract(F.lit("SECOND"), x).cast("double")


#: Fields of dates and times beyond Spark's, or of another count: fixed values of the language.
PARTS: dict[str, Callable[[Column], Column]] = {
    "dow": lambda x: F.dayofweek(x) - 1, "isodow": lambda x: F.weekday(x) + 1, "doy": F.dayofyear, "isoyear": lambda x: F.extract(F.lit("YEAROFWEEK"), x), "epoch": _epoch,
    "century": lambda x: F.ceil(F.year(x) / 100), "millennium": lambda x: F.ceil(F.year(x) / 1000), "decade": lambda x: F.floor(F.year(x) / 10),
    "milliseconds": lambda x: F.extract(F.lit("SECOND"), x).cast("double") * 1000, "microseconds": lambda x: F.extract(F.lit("SECOND"), x).cast("double") * 1_000_000,
}


def _part(field: Arg, x: Arg) -> Column:
    name = str(field.told("a field")).lower()
    c = x.column.cast("timestamp_ntz") if isinstance(x.kind, T.DateType) else x.column
    return (PARTS[name](c) if name in PARTS else F.date_part(F.lit(name), c)).cast("double")


#: By name: what builds it, fewest and most arguments, and whether it takes them as Arg.
SCALARS: dict[str, tuple[Callable[..., Column], int, int, bool]] = {}


def _add(names: str, build: Callable[..., Column], least: int, most: int | None = None, told: bool = False) -> None:
    for n in names.split():
        SCALARS[n] = (build, least, least if most is None else most, told)


for _names, _f in {
    "initcap": F.initcap, "length char_length character_length": F.length, "octet_length": F.octet_length,
    "bit_length": F.bit_length, "reverse": F.reverse, "md5": F.md5, "ascii": F.ascii, "chr": F.chr, "abs": F.abs, "ceil ceiling": F.ceil,
    "floor": F.floor, "sign": F.signum, "exp": F.exp, "ln": F.ln, "sqrt": F.sqrt, "cbrt": F.cbrt, "degrees": F.degrees, "radians": F.radians,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "cardinality": F.size,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "cot": F.cot, "factorial": F.factorial, "unnest": F.explode,
}.items():
    _add(_names, _f, 1)
for _names, _f in {
    "repeat": lambda s, n: F.repeat(s, F.greatest(n, F.lit(0)).cast("int")), "left": _side(True), "right": _side(False),
    "strpos position": lambda s, t: F.position(t, s),
    "starts_with": F.startswith, "mod": lambda a, b: a % b, "power pow": F.pow, "atan2": F.atan2, "array_append": F.array_append,
    "array_prepend": lambda x, a: F.array_prepend(a, x), "array_cat": F.concat, "array_remove": F.array_remove,
    "array_position": lambda a, x: F.nullif(F.array_position(a, x), F.lit(0)), "date_trunc": lambda f, x: F.call_function("date_trunc", f, x),
    "nullif": F.nullif, "string_to_array": lambda s, d: F.split(s, F.concat(F.lit(r"\Q"), d, F.lit(r"\E"))),
    "gcd": _gcd, "regexp_count": F.regexp_count,
}.items():
    _add(_names, _f, 2)
for _names, _f in {
    "replace": F.replace, "split_part": _split_part, "translate": lambda s, a, b: F.call_function("translate", s, a, b), "make_date": F.make_date,
    "array_replace": lambda a, x, y: F.transform(a, lambda e: F.when(e.eqNullSafe(x), y).otherwise(e)),
}.items():
    _add(_names, _f, 3)
_add("trim btrim", lambda s, c=None: F.trim(s) if c is None else F.btrim(s, c), 1, 2)
_add("ltrim", lambda s, c=None: F.ltrim(s) if c is None else F.ltrim(s, c), 1, 2)
_add("rtrim", lambda s, c=None: F.rtrim(s) if c is None else F.rtrim(s, c), 1, 2)
_add("substring substr", _substring, 2, 3)
_add("lpad", lambda s, n, p=None: F.call_function("lpad", s, n.cast("int"), F.lit(" ") if p is None else p), 2, 3)
_add("rpad", lambda s, n, p=None: F.call_function("rpad", s, n.cast("int"), F.lit(" ") if p is None else p), 2, 3)
_add("round", lambda x, n=None: F.round(x) if n is None else F.call_function("round", x, n.cast("int")), 1, 2)
_add("log", lambda a, b=None: F.log10(a) if b is None else F.ln(b) / F.ln(a), 1, 2)
_add("array_length", _array_length, 1, 2)
_add("array_to_string", lambda a, d, n=None: F.call_function("array_join", a, d) if n is None else F.call_function("array_join", a, d, n), 2, 3)
_add("greatest", lambda *a: F.greatest(*a) if len(a) > 1 else a[0], 1, 99)
_add("least", lambda *a: F.least(*a) if len(a) > 1 else a[0], 1, 99)
_add("concat", lambda *a: F.concat(*(F.coalesce(x.cast(S), F.lit("")) for x in a)), 1, 99)
_add("coalesce", F.coalesce, 1, 99)
_add("pi", lambda: F.lit(3.141592653589793), 0)
_add("now current_timestamp", F.current_timestamp, 0)
_add("current_date", F.current_date, 0)
_add("gen_random_uuid", F.uuid, 0)
_add("make_timestamp", lambda *a: F.make_timestamp_ntz(*a), 6)
_add("width_bucket", F.width_bucket, 4)
_add("to_hex", lambda x: F.lower(F.hex(x)), 1)
_add("quote_literal", lambda s: F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")), 1)
_add("age", lambda a, b=None: patterns.age(F.current_date(), a) if b is None else patterns.age(a, b), 1, 2)
_add("overlay", lambda s, t, a, n=None: F.overlay(s, t, a, F.length(t) if n is None else n), 3, 4)
_add("quote_ident", lambda s: F.when(F.regexp_like(s, F.lit("^[a-z_][a-z0-9_$]*$")), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))), 1)
_add("quote_nullable", lambda s: F.coalesce(F.concat(F.lit("'"), F.replace(s.cast(S), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")), 1)
_add("encode", lambda b, f: F.when(f == "hex", F.lower(F.hex(b))).when(f == "base64", F.base64(b)), 2)
_add("decode", lambda s, f: F.when(f == "hex", F.unhex(s)).when(f == "base64", F.unbase64(s)), 2)
_add("sha256", lambda b: F.unhex(F.sha2(b, 256)), 1)
_add("concat_ws", lambda d, *a: F.call_function("concat_ws", d, *(x.cast(S) for x in a)), 2, 99)
_add("num_nulls", lambda *a: sum((F.when(x.isNull(), 1).otherwise(0) for x in a), F.lit(0)), 1, 99)
_add("num_nonnulls", lambda *a: sum((F.when(x.isNull(), 0).otherwise(1) for x in a), F.lit(0)), 1, 99)
_add("log10", F.log10, 1)
_add("log2", F.log2, 1)
_add("lcm", lambda a, b: F.when((a == 0) | (b == 0), a * 0).otherwise(F.abs(a / _gcd(a, b) * b).cast("bigint")), 2)
_add("asinh", F.asinh, 1)
_add("acosh", F.acosh, 1)
_add("atanh", F.atanh, 1)
_add("random", F.rand, 0)
_add("localtimestamp", F.localtimestamp, 0)
_add("isfinite", lambda x: F.when(x.isNotNull(), F.lit(True)), 1)
_add("array_lower", lambda a, n: F.when((n == 1) & (F.size(a) > 0), 1), 2)
_add("array_upper", lambda a, n: F.when(n == 1, F.nullif(F.size(a), F.lit(0))), 2)
_add("array_ndims", lambda a: F.when(F.size(a) > 0, 1), 1)
_add("array_positions", lambda a, x: F.filter(F.transform(a, lambda e, i: F.when(e.eqNullSafe(x), i + 1)), lambda i: i.isNotNull()), 2)
_add("array_fill", lambda x, n: F.array_repeat(x, F.get(n, F.lit(0))), 2)
_add("array_reverse", F.reverse, 1)
_add("array_sort", lambda a: F.array_sort(a), 1)
_add("trim_array", lambda a, n: F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0))), 2)
_add("make_interval", F.make_dt_interval, 1, 4)
_add("regexp_substr", F.regexp_substr, 2)
_add("regexp_instr", F.regexp_instr, 2)
_add("isempty", lambda r: (r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~(r["lower_inc"] & r["upper_inc"])), 1)
_add("lower_inc", lambda r: r["lower_inc"], 1)
_add("upper_inc", lambda r: r["upper_inc"], 1)
_add("lower_inf", lambda r: r["lower"].isNull(), 1)
_add("upper_inf", lambda r: r["upper"].isNull(), 1)
_add("lower", _bound("lower", F.lower), 1, told=True)
_add("upper", _bound("upper", F.upper), 1, told=True)
_add("date_part extract", _part, 2, told=True)
_add("div", _div, 2, told=True)
_add("trunc", _trunc, 1, 2, told=True)
_add("to_char", _to_char, 2, told=True)
_add("to_date", _to_date, 2, told=True)
_add("to_timestamp", _to_timestamp, 1, 2, told=True)
_add("regexp_replace", _regexp_replace, 3, 4, told=True)
_add("regexp_match", _regexp_match, 2, 3, told=True)
_add("regexp_like", _regexp_like, 2, 3, told=True)
_add("regexp_split_to_array", _regexp_split, 2, 3, told=True)
_add("jsonb_build_object json_build_object", _build_object, 0, 98, told=True)
_add("jsonb_build_array json_build_array", _build_array, 0, 99, told=True)
_add("jsonb_extract_path json_extract_path", _extract_path(False), 2, 99, told=True)
_add("jsonb_extract_path_text json_extract_path_text", _extract_path(True), 2, 99, told=True)
_add("jsonb_set", _placed(False), 3, 4, told=True)
_add("jsonb_insert", _placed(True), 3, 4, told=True)
_add("jsonb_strip_nulls json_strip_nulls", lambda j: jsons.edited(jsons.stripped, jsons.text(j.column, j.kind)), 1, told=True)
_add("to_jsonb to_json", lambda x: jsons.variant_of(x.column, x.kind), 1, told=True)
_add("jsonb_object_keys json_object_keys", _json(F.json_object_keys), 1, told=True)
_add("jsonb_array_length json_array_length", _json(F.json_array_length), 1, told=True)
_add("jsonb_typeof json_typeof", _json(lambda t: F.when(F.startswith(F.ltrim(t), F.lit("{")), "object").when(F.startswith(F.ltrim(t), F.lit("[")), "array").when(F.startswith(F.ltrim(t), F.lit('"')), "string")
                                       .when(F.trim(t).isin("true", "false"), "boolean").when(F.trim(t) == "null", "null").when(t.isNotNull(), "number")), 1, told=True)
