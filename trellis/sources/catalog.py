"""The catalog: relations with their declared keys, table functions and computed fields.

Parquet files carry columns and types but no keys, and the cardinality of an embed follows from keys,
so keys are declared. A snapshot of the catalog is immutable; sessions hold table contents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import QueryError, invalid, unknown
from ..functions.scalars import DENIED

#: Schemas that requests never reach.
HIDDEN_SCHEMAS = frozenset(("pg_catalog", "information_schema"))


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class Field:
    """What is declared of a column beyond its Spark type."""

    default: Any = None
    has_default: bool = False
    nullable: bool = True
    generated: bool = False  # computed by the table: never written
    identity: bool = False  # numbered on insert when left out
    json: bool = False  # a string column that holds JSON
    enum: tuple[str, ...] = ()
    kind: str = ""  # value form on write where the Spark type does not tell: uuid, ...


@dataclass(frozen=True)
class Computed:
    """A field computed from the row: by columns, or the rows of another relation that refer to it."""

    build: Callable[[dict[str, Column]], Column] | None = None
    relation: str = ""
    on: tuple[tuple[str, str], ...] = ()  # (column of relation, column here)


@dataclass(frozen=True)
class Relation:
    name: str
    load: Callable[[SparkSession], DataFrame]
    primary_key: tuple[str, ...] = ()
    unique: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    fields: dict[str, Field] = field(default_factory=dict)
    computed: dict[str, Computed] = field(default_factory=dict)
    schema: str = "main"
    view: bool = False
    indexes: tuple[tuple[str, ...], ...] | None = None  # beside those of unique sets; None: every column is

    @property
    def key(self) -> tuple[str, str]:
        return self.schema, self.name

    def unique_sets(self) -> list[tuple[str, ...]]:
        return ([self.primary_key] if self.primary_key else []) + list(self.unique.values())

    def is_unique(self, columns: Iterable[str]) -> bool:
        have = set(columns)
        return any(set(u) == have for u in self.unique_sets())

    def field_of(self, column: str) -> Field:
        return self.fields.get(column, Field())


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    default: Any = None
    has_default: bool = False
    variadic: bool = False  # the last one: an array, of the arguments that are left


@dataclass(frozen=True)
class Function:
    """A function with a SQL body. ``returns`` is a scalar type, or a column list for a table.

    ``body`` names relations in braces. ``many`` tells whether a table function may return several
    rows; ``relation`` is the relation whose rows it returns, if any (else a record, without key).
    """

    name: str
    parameters: tuple[Parameter, ...]
    returns: str
    body: str
    table: bool = False
    many: bool = True
    relation: str = ""
    schema: str = "main"

    def accepts(self, positional: int | None, names: Iterable[str] = ()) -> bool:
        needed = [p for p in self.parameters if not (p.has_default or p.variadic)]
        if positional is not None:
            return len(needed) <= positional and (self.variadic or positional <= len(self.parameters))
        given = set(names)
        return given <= {p.name for p in self.parameters} and all(p.name in given for p in needed)

    @property
    def variadic(self) -> bool:
        return bool(self.parameters) and self.parameters[-1].variadic


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of one's own: a Column over Columns, which skips nulls (rows that a filter leaves out
    come as nulls)."""

    name: str
    build: Callable[..., Column]
    arity: int = 1
    schema: str = "main"


class Catalog:
    def __init__(self, relations: Iterable[Relation], functions: Iterable[Function] = (), search_path: tuple[str, ...] = ("main",), max_depth: int = 6, denied: Iterable[str] = DENIED, check_indexes: bool = True, aggregates: Iterable[Aggregate] = ()):
        self.relations = {r.key: r for r in relations}
        self.functions: dict[tuple[str, str], list[Function]] = {}
        for f in functions:
            self.functions.setdefault((f.schema, f.name), []).append(f)
        self.aggregates = {(a.schema, a.name): a for a in aggregates}
        self.search_path, self.max_depth, self.denied, self.check_indexes = search_path, max_depth, frozenset(denied), check_indexes

    def relation(self, name: str, schema: str | None = None) -> Relation:
        for s in (schema,) if schema else self.search_path:
            if s in HIDDEN_SCHEMAS:
                break
            if found := self.relations.get((s, name)):
                return found
        raise unknown(f"no relation {schema + '.' if schema else ''}{name}")

    def function(self, name: str, schema: str | None, positional: int | None, names: Iterable[str] = (), table: bool | None = None) -> Function | None:
        """The one overload that takes these arguments; None where there is no such name at all."""
        if name in self.denied:
            raise unknown(f"function {name} is not allowed")
        for s in (schema,) if schema else self.search_path:
            if s in HIDDEN_SCHEMAS:
                break
            if all_ := self.functions.get((s, name)):
                fit = [f for f in all_ if f.accepts(positional, names) and table in (None, f.table)]
                if len(fit) > 1:
                    raise invalid(f"function {name} is ambiguous")
                if not fit:
                    raise unknown(f"no function {name} takes these arguments")
                return fit[0]
        return None

    def aggregate(self, name: str, schema: str | None) -> Aggregate | None:
        if name in self.denied:
            raise unknown(f"aggregate {name} is not allowed")
        return next((a for s in ((schema,) if schema else self.search_path) if (a := self.aggregates.get((s, name)))), None)

    def link(self, child: Relation, child_columns: tuple[str, ...], parent: Relation, parent_columns: tuple[str, ...]) -> bool:
        """Whether the join is to one row; raises where no declared key backs it."""
        pairs = set(zip(child_columns, parent_columns, strict=True))
        for near, far, own in ((child, parent, pairs), (parent, child, {(b, a) for a, b in pairs})):
            for fk in near.foreign_keys:
                if fk.target != far.name:
                    continue
                declared = set(zip(fk.columns, fk.target_columns, strict=True))
                if own == declared:
                    self._indexed(child, child_columns)
                    return child.is_unique(child_columns)
                if {a for a, _ in own} == set(fk.columns) and {b for _, b in own} == set(fk.target_columns):
                    raise QueryError("JOIN_MISSING_INDEX", f"columns of {near.name} and {far.name} are paired unlike their foreign key")
        if child.is_unique(child_columns) or parent.is_unique(parent_columns):
            self._indexed(child, child_columns)
            return child.is_unique(child_columns)
        raise QueryError("JOIN_MISSING_INDEX", f"no foreign key or unique constraint backs {child.name}({', '.join(child_columns)})")

    def _indexed(self, child: Relation, columns: tuple[str, ...]) -> None:
        """Joins read a child by an index that begins with their columns, in any order."""
        if self.check_indexes and child.indexes is not None and not any(set(i[: len(columns)]) == set(columns) for i in (*child.indexes, *child.unique_sets())):
            raise QueryError("JOIN_MISSING_INDEX", f"{child.name}({', '.join(columns)}) is not indexed")

    def export(self, spark: SparkSession) -> str:
        """The catalog as JSON, for clients."""
        out = []
        for r in sorted(self.relations.values(), key=lambda r: r.key):
            columns = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": r.field_of(f.name).nullable} for f in r.load(spark).schema]
            keys = [{"columns": list(k.columns), "target": k.target, "target_columns": list(k.target_columns)} for k in r.foreign_keys]
            out.append({"schema": r.schema, "name": r.name, "columns": columns, "primary_key": list(r.primary_key), "unique": {k: list(v) for k, v in r.unique.items()}, "foreign_keys": keys, "computed": sorted(r.computed)})
        functions = [{"schema": f.schema, "name": f.name, "parameters": [{"name": p.name, "type": p.type, "optional": p.has_default, "variadic": p.variadic} for p in f.parameters], "returns": f.returns, "table": f.table} for fs in self.functions.values() for f in fs]
        return json.dumps({"relations": out, "functions": functions}, indent=1)


def parquet(path: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.read.parquet(path)


def frame(rows: list[tuple], schema: str | T.StructType) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.createDataFrame(rows, schema)
