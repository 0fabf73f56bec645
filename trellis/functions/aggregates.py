"""Aggregates over the rows of a to-many child, as Columns of one grouped frame.

Filters are folded into the arguments, ``distinct`` and order into collections, so that all aggregates
of a child share one grouping and keep Spark's partial aggregation wherever the function has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid, unknown

Plain = Callable[..., Column]


def _sum(x: Column, kind: T.DataType) -> Column:
    """Sums of 64-bit integers are exact decimals, as they may leave their type."""
    return F.sum(x.cast("decimal(38,0)") if isinstance(kind, T.LongType) else x)


PLAIN: dict[str, Plain] = {
    "min": F.min, "max": F.max, "bool_and": F.bool_and, "every": F.every, "bool_or": F.bool_or, "bit_and": F.bit_and, "bit_or": F.bit_or,
    "bit_xor": F.bit_xor, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop, "variance": F.var_samp,
    "var_samp": F.var_samp, "var_pop": F.var_pop, "corr": F.corr, "covar_pop": F.covar_pop, "covar_samp": F.covar_samp, "mode": F.mode,
    "regr_avgx": F.regr_avgx, "regr_avgy": F.regr_avgy, "regr_count": F.regr_count, "regr_intercept": F.regr_intercept, "regr_r2": F.regr_r2,
    "regr_slope": F.regr_slope, "regr_sxx": F.regr_sxx, "regr_sxy": F.regr_sxy, "regr_syy": F.regr_syy,
    "any_value": lambda x: F.first(x, ignorenulls=True), "median": F.median,
}
COUNTS = frozenset(("count", "regr_count"))
#: Equal with and without repeated values.
UNMOVED = frozenset("min max bool_and every bool_or bit_and bit_or any_value".split())
COLLECTIONS = frozenset("array_agg json_agg jsonb_agg string_agg json_object_agg jsonb_object_agg".split())
#: Beyond the language: the fraction is the second argument.
PERCENTILES = frozenset(("percentile_cont", "percentile_disc"))
ARITY = {"count": (0, 9), **{n: (2, 2) for n in PERCENTILES}, "string_agg": (2, 2), "json_object_agg": (2, 2), "jsonb_object_agg": (2, 2), **{n: (2, 2) for n in ("corr", "covar_pop", "covar_samp", *(k for k in PLAIN if k.startswith("regr_")))}}


def known(name: str) -> bool:
    return name in PLAIN or name in COLLECTIONS or name in PERCENTILES or name in ("count", "sum", "avg")


def sort_keys(terms: list[tuple[Column, bool, bool, T.DataType]]) -> list[Column] | None:
    """Columns whose ascending order is that of the terms (column, desc, nulls first, type); None
    where a term falls in a type that cannot be negated. Nulls go last unless told otherwise."""
    out = []
    for c, desc, nulls_first, kind in terms:
        if desc and not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.DoubleType, T.FloatType, T.DecimalType, T.LongType)):
            return None
        if desc:
            c = -(c.cast("decimal(20,0)") if isinstance(kind, T.LongType) else c.cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else c)
        out += [(c.isNotNull() if nulls_first else c.isNull()), c]
    return out


def _ordered(arrays: Column, values: str, desc: list[tuple[bool, bool]]) -> Column:
    """Sorts structs (k0, k1, ..., v) by their keys, each ascending or descending, nulls by flag."""
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(desc))):
            down, first = desc[i]
            x, y = a[f"k{i}"], b[f"k{i}"]
            null = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(-1 if first else 1)).when(y.isNull(), F.lit(1 if first else -1))
            out = null.when(x < y, F.lit(1 if down else -1)).when(x > y, F.lit(-1 if down else 1)).otherwise(out)
        return out
    return F.transform(F.array_sort(arrays, compare), lambda s: s[values])


def aggregate(name: str, args: list[Column], kinds: list[T.DataType], distinct: bool, where: Column | None, order: list[tuple[Column, bool, bool]], tie: list[Column]) -> Column:
    """``tie`` puts collections without an order, or ties of one, in a fixed order."""
    if not known(name):
        raise unknown(f"no aggregate {name}")
    least, most = ARITY.get(name, (1, 1))
    if not least <= len(args) <= most:
        raise invalid(f"aggregate {name} takes other arguments")
    held = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    if name == "count":
        if not args:
            return F.count(held(F.lit(1)))
        if distinct:
            return F.count_distinct(*(held(a) for a in args))
        given = args[0].isNotNull()
        for a in args[1:]:
            given = given & a.isNotNull()
        return F.count(held(F.when(given, F.lit(1))))
    if name in COLLECTIONS:
        return _collect(name, args, distinct, held, order, tie)
    if name in PERCENTILES:
        if distinct:
            raise invalid(f"{name} takes no distinct")
        if name == "percentile_cont":
            return F.percentile(held(args[0]), args[1])
        rows = F.array_sort(F.collect_list(held(args[0])))
        return F.get(rows, F.greatest(F.ceil(F.first(args[1], ignorenulls=True).cast("double") * F.size(rows)) - 1, F.lit(0)).cast("int"))
    args = [held(a) for a in args]
    if name == "sum":
        return F.sum_distinct(args[0]) if distinct else _sum(args[0], kinds[0])
    if name == "avg":
        return F.sum_distinct(args[0]) / F.count_distinct(args[0]) if distinct else F.avg(args[0])
    return _distinct(name, args) if distinct and name not in UNMOVED else PLAIN[name](*args)


def _distinct(name: str, args: list[Column]) -> Column:
    """A statistic over the distinct values, or pairs of values, that have no null."""
    given = args[0].isNotNull()
    for a in args[1:]:
        given = given & a.isNotNull()
    rows = F.array_sort(F.collect_set(F.when(given, F.struct(*(a.alias(f"v{i}") for i, a in enumerate(args))))))
    if name == "mode":  # each occurs once: the least
        return F.get(rows, F.lit(0))["v0"]
    if name == "bit_xor":
        values = F.transform(rows, lambda r: r["v0"])
        return F.when(F.size(values) > 0, F.reduce(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)), lambda a, x: a.bitwiseXOR(x)))
    if name == "median":
        middle = lambda at: F.get(rows, at.cast("int"))["v0"].cast("double")
        return (middle(F.floor((F.size(rows) - 1) / 2)) + middle(F.floor(F.size(rows) / 2))) / 2
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "mx", "my", "sxx", "syy", "sxy")))

    def add(s: Column, r: Column) -> Column:
        y, x = r["v0"].cast("double"), r[f"v{len(args) - 1}"].cast("double")
        n = s["n"] + 1
        mx, my = s["mx"] + (x - s["mx"]) / n, s["my"] + (y - s["my"]) / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (s["sxx"] + (x - s["mx"]) * (x - mx)).alias("sxx"),
                        (s["syy"] + (y - s["my"]) * (y - my)).alias("syy"), (s["sxy"] + (x - s["mx"]) * (y - my)).alias("sxy"))

    def told(s: Column) -> Column:
        n, sxx, syy, sxy = s["n"], s["sxx"], s["syy"], s["sxy"]
        over = lambda a, b: F.when(b > 0, a / b)
        slope, pop, samp = over(sxy, sxx), over(sxx, n), over(sxx, n - 1)
        some = lambda c: F.when(n > 0, c)
        return {
            "stddev": F.sqrt(samp), "stddev_samp": F.sqrt(samp), "stddev_pop": F.sqrt(pop), "variance": samp, "var_samp": samp, "var_pop": pop,
            "covar_pop": over(sxy, n), "covar_samp": over(sxy, n - 1), "corr": over(sxy, F.sqrt(sxx * syy)), "regr_count": n.cast("long"),
            "regr_avgx": some(s["mx"]), "regr_avgy": some(s["my"]), "regr_sxx": some(sxx), "regr_syy": some(syy), "regr_sxy": some(sxy),
            "regr_slope": slope, "regr_intercept": s["my"] - slope * s["mx"],
            "regr_r2": F.when(sxx > 0, F.when(syy > 0, sxy * sxy / (sxx * syy)).otherwise(1.0)),
        }[name]
    return F.aggregate(rows, zero, add, told)


def _collect(name: str, args: list[Column], distinct: bool, held, order, tie) -> Column:
    keys = [*order, *((c, False, False) for c in ([] if distinct else tie))]
    if distinct and not order:
        keys = [(args[0], False, False)]
    value = args[0] if len(args) == 1 or name == "string_agg" else F.struct(args[0].cast("string").alias("key"), args[1].alias("value"))
    row = F.struct(*(k.alias(f"k{i}") for i, (k, _, _) in enumerate(keys)), value.alias("v"))
    if name == "string_agg":
        row = F.when(value.isNotNull(), row)
    rows = (F.collect_set if distinct else F.collect_list)(held(row))
    values = _ordered(rows, "v", [(d, n) for _, d, n in keys])
    if name == "string_agg":
        return F.when(F.size(values) > 0, F.call_function("array_join", values, F.first(args[1])))
    if name.endswith("object_agg"):
        return F.when(F.size(values) > 0, F.map_from_entries(values))
    return F.when(F.size(values) > 0, values)

