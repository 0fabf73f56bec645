"""JSON values: building, paths, and edits, which walk a document and so run in Arrow batches of texts."""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid

# edits travel to Python workers as they are, which need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
NESTED = (T.StructType, T.ArrayType, T.MapType)


def variant_of(c: Column, kind: T.DataType) -> Column:
    """Any value as JSON; text is a JSON text."""
    if isinstance(kind, T.VariantType):
        return c
    if isinstance(kind, T.NullType):
        return c.cast("variant")
    return F.to_variant_object(c) if isinstance(kind, NESTED) else c.cast("variant")


def read(c: Column, kind: T.DataType) -> Column:
    """A JSON document: a variant, or its text."""
    return c if isinstance(kind, T.VariantType) else F.parse_json(c) if isinstance(kind, T.StringType) else variant_of(c, kind)


def text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, T.VariantType) else c if isinstance(kind, T.StringType) else F.to_json(variant_of(c, kind))


def path(steps: list[str | int], index_digits: bool = True) -> str:
    """A path of keys and indexes; digits are an index unless told otherwise."""
    out = "$"
    for s in steps:
        if isinstance(s, int) or (index_digits and s.isdigit()):
            out += f"[{s}]"
        elif "'" not in s:
            out += f"['{s}']"
        elif '"' not in s:
            out += f'["{s}"]'
        else:
            raise invalid("a key with both kinds of quotes is no path")
    return out


def edited(change: Callable[..., Any], *documents: Column) -> Column:
    """``change`` of the parsed documents, as JSON; null where one is null."""
    @F.pandas_udf("string")
    def run(*texts):
        import pandas as pd

        rows = zip(*(t.tolist() for t in texts), strict=True)
        return pd.Series([None if any(x is None for x in r) else json.dumps(change(*map(json.loads, r)), ensure_ascii=False, separators=(",", ":")) for r in rows], dtype=object)
    return F.parse_json(run(*documents))


def tested(test: Callable[..., bool], *documents: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(*texts):
        import pandas as pd

        rows = zip(*(t.tolist() for t in texts), strict=True)
        return pd.Series([None if any(x is None for x in r) else test(*map(json.loads, r)) for r in rows], dtype=object)
    return run(*documents)


def holds(x: Any, y: Any) -> bool:
    """Containment of parsed documents."""
    if isinstance(x, dict) and isinstance(y, dict):
        return all(k in x and holds(x[k], v) for k, v in y.items())
    if isinstance(x, list):
        return all(any(holds(i, j) for i in x) for j in (y if isinstance(y, list) else [y]))
    if isinstance(x, (dict, list)) or isinstance(y, (dict, list)):
        return False
    return isinstance(x, bool) == isinstance(y, bool) and x == y


def holding(part: Any) -> Callable[[Any], bool]:
    """Containment of one literal document."""
    return lambda x: holds(x, part)


def held_by(whole: Any) -> Callable[[Any], bool]:
    return lambda y: holds(whole, y)


def merged(x: Any, y: Any) -> Any:
    """What ``||`` makes of two documents: objects merge, all else is a list."""
    if isinstance(x, dict) and isinstance(y, dict):
        return x | y
    return (x if isinstance(x, list) else [x]) + (y if isinstance(y, list) else [y])


def placed(steps: list[str], create: bool, insert: bool, after: bool = False) -> Callable[[Any, Any], Any]:
    """Sets (or inserts) a value at a path; where the path leads nowhere the document stays."""
    def put(at: Any, rest: list[str], new: Any) -> Any:
        step, *deeper = rest
        if isinstance(at, dict):
            if deeper:
                return at | {step: put(at[step], deeper, new)} if step in at else at
            if insert and step in at:
                raise ValueError(f"key {step} is there already")
            return at | {step: new} if step in at or create else at
        if not isinstance(at, list):
            return at
        i = int(step)
        k = i + len(at) if i < 0 else i
        if deeper:
            return [put(x, deeper, new) if j == k else x for j, x in enumerate(at)]
        if insert:
            k = min(max(k + after, 0), len(at))
            return at[:k] + [new] + at[k:]
        if 0 <= k < len(at):
            return at[:k] + [new] + at[k + 1:]
        return at if not create else [new, *at] if k < 0 else [*at, new]

    return lambda document, new: put(document, steps, new) if steps else document


def stripped(x: Any) -> Any:
    """Without members that are null, at any depth; elements of arrays stay."""
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if v is not None}
    return [stripped(v) for v in x] if isinstance(x, list) else x


def without(x: Any, step: str | int) -> Any:
    """Without a key, or without an element by its number."""
    if isinstance(x, dict):
        return {k: v for k, v in x.items() if k != step}
    if isinstance(x, list):
        at = None if not isinstance(step, int) else step + len(x) if step < 0 else step
        return [v for i, v in enumerate(x) if (i != at if at is not None else v != step)]
    return x


def without_all(steps: list[str | int]) -> Callable[[Any], Any]:
    return lambda x: functools.reduce(without, steps, x)
