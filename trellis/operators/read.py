"""Nested reads as DataFrames.

A child sees nothing of its parent but the keys it joins on, so every child is planned once for all
parents: its rows are filtered, ranked and limited per key, grouped by the key with its array and all
of its aggregates in one grouping, and joined to the parent. Function children get the same plan: the
distinct arguments are the key, and the function runs laterally over those alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid, unknown
from ..functions import aggregates
from ..functions.scalars import Arg
from ..plans.resolve import Node
from ..plans.syntax import Expr, Order
from .expressions import Compiler, call_builtin

#: A limited parent of at most so many rows sends its keys to its children before they are grouped.
PRUNE_ROWS = 10_000


class Scope:
    """Names of one node over its frame, whose columns carry the node's prefix."""

    def __init__(self, reader: Reader, node: Node, df: DataFrame):
        self.reader, self.node, self.df = reader, node, df
        self.children: dict[str, Scope] = {}
        self.aggregated: dict[Expr, str] = {}

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def compiler(self) -> Compiler:
        return Compiler(self, self.reader.params)

    def column(self, name: str) -> Column:
        if name not in self.node.columns:
            raise unknown(f"{self._title()} has no column {name}")
        return F.col(f"`{self.node.prefix}{name}`")

    def relation_field(self, name: str):
        return self.node.relation.field_of(name)

    def _title(self) -> str:
        return self.node.relation.name if self.node.relation else self.node.request.name

    def lookup(self, name: str, hops: tuple[str, ...] | list[str], compiler: Compiler) -> Column:
        node = self.node
        computed = node.relation.computed.get(name) if node.relation else None
        found = [name in node.columns, name in node.children and not node.children[name].implicit]
        if sum(found) > 1 or (any(found) and name == node.request.alias):
            raise unknown(f"{name} is ambiguous in {self._title()}")
        if name == node.request.alias and not any(found):
            return self.lookup(hops[0], hops[1:], compiler) if hops else F.struct(*(self.column(c).alias(c) for c in node.columns))
        if found[0]:
            return self.hop(self.column(name), hops)
        if name in node.children:
            child = node.children[name]
            if not hops:
                return F.col(f"`{child.prefix}#value`")
            if child.scalar or not child.to_one:
                raise invalid(f"{name} holds many rows: aggregate it")
            inner = self.children[name]
            return F.when(F.col(f"`{child.prefix}#here`"), inner.field(hops[0], hops[1:]))
        if computed and computed.build:
            return self.hop(computed.build({c: self.column(c) for c in node.columns}), hops)
        raise unknown(f"{self._title()} has no {name}")

    def field(self, name: str, hops: tuple[str, ...] | list[str]) -> Column:
        """A name that a parent hops to: also a key of the select."""
        select, node = self.node.request.select, self.node
        if name not in node.columns and name not in node.children and select.op in ("object", "star"):
            for key, e in select.args if select.op == "object" else select.args[2]:
                if key == name:
                    return self.hop(self.compiler()(e), hops)
        return self.lookup(name, hops, self.compiler())

    @staticmethod
    def hop(c: Column, hops: tuple[str, ...] | list[str]) -> Column:
        for h in hops:
            c = c.getField(h)
        return c

    def star(self, e: Expr, compiler: Compiler) -> list[tuple[str, Column]]:
        """Own columns, then children of one row, then of many, then the added keys."""
        embeds, without, added = e.args
        node = self.node
        for name in without:
            if name not in node.columns and not (embeds and name in node.children and name in dict(added)):
                raise unknown(f"{self._title()} has no column {name} to leave out")
        out = {c: self.column(c) for c in node.columns if c not in without}
        if embeds:
            shown = sorted(((a, c) for a, c in node.children.items() if not c.implicit and a not in without), key=lambda x: (not x[1].to_one, x[0]))
            for alias, _ in shown:
                out[alias] = self.lookup(alias, (), compiler)
        for key, x in added:
            if key in out:
                raise invalid(f"{key} is there already: leave the column out first")
            out[key] = compiler(x)
        return list(out.items())

    def call(self, schema: str | None, name: str, args: list[Arg]) -> Column:
        f = self.reader.session.catalog.function(name, schema, len(args), table=False)
        if f is not None:
            return self.reader.session.call(f, self.reader.session.bound(f, [a.column for a in args]))
        return call_builtin(name, args)

    def aggregate(self, e: Expr) -> Column:
        if e not in self.aggregated:
            raise invalid("agg is not available here")
        c = F.col(f"`{self.aggregated[e]}`")
        return F.coalesce(c, F.lit(0)) if e.args[1] in aggregates.COUNTS else c


class _Members(Scope):
    """The scope of an aggregate's arguments: the child's names under the child's alias."""

    def __init__(self, inner: Scope, alias: str):
        super().__init__(inner.reader, inner.node, inner.df)
        self.inner, self.alias = inner, alias

    def lookup(self, name, hops, compiler):
        if name != self.alias or not hops:
            raise invalid(f"aggregates take fields of {self.alias}")
        return self.inner.field(hops[0], hops[1:])

    def column(self, name: str) -> Column:
        raise invalid(f"aggregates take fields of {self.alias}")


class Reader:
    def __init__(self, session, params: dict | None = None):
        self.session, self.params = session, params or {}

    # frames
    def scan(self, node: Node, arguments: DataFrame | None = None) -> DataFrame:
        if node.function is not None:
            df = self.session.run_function(node.function, node.request.arguments, self) if arguments is None else arguments
        else:
            df = self.session.table(node.relation)
        keep = [F.col(f"`{c}`").alias(f"{node.prefix}{c}") for c in node.columns]
        return df.select(*keep, *(c for c in df.columns if c.startswith("#")))

    def filtered(self, node: Node, df: DataFrame, prune: DataFrame | None = None) -> Scope:
        """The node's rows with the children that are needed, after where."""
        scope = Scope(self, node, df)
        if node.request.where is not None and not self._reaches(node, [node.request.where]):
            scope.df = df = df.where(scope.compiler()(node.request.where))
            done = True
        else:
            done = node.request.where is None
        self.attach(scope, prune)
        if not done:
            scope.df = scope.df.where(scope.compiler()(node.request.where))
        return scope

    def _reaches(self, node: Node, exprs: list[Expr]) -> bool:
        names = set(node.children)
        return any(x.op in ("agg", "star") or (x.op == "." and names & set(map(str, x.args))) for e in exprs for x in e.walk())

    def attach(self, scope: Scope, prune: DataFrame | None = None) -> None:
        for alias, child in scope.node.children.items():
            if alias in scope.node.used or alias in scope.node.aggregates:
                if child.function is not None:
                    self._attach_function(scope, alias, child)
                else:
                    self._attach(scope, alias, child, [f"{child.prefix}{own}" for own, _ in child.on], [f"{scope.node.prefix}{far}" for _, far in child.on], self.scan(child), prune)

    def _attach(self, scope: Scope, alias: str, child: Node, own: list[str], far: list[str], base: DataFrame, prune: DataFrame | None, null_safe: bool = False) -> None:
        if prune is not None:
            keys = prune.select(*(F.col(f"`{f}`").alias(f"{o}#key") for f, o in zip(far, own, strict=True))).distinct()
            same = [F.col(f"`{o}`") == F.col(f"`{o}#key`") for o in own]
            base = base.join(F.broadcast(keys), _all(same), "left_semi")  # PRUNE_ROWS keys at most
        inner = self.filtered(child, base)
        inner.df, rank = self._per_key(inner, own)
        match = _all([(F.col(f"`{f}`").eqNullSafe(F.col(f"`{o}#join`")) if null_safe else F.col(f"`{f}`") == F.col(f"`{o}#join`")) for f, o in zip(far, own, strict=True)])
        keyed = [F.col(f"`{o}`").alias(f"{o}#join") for o in own]
        if child.to_one:
            value = [self.value(inner).alias(f"{child.prefix}#value")] if child.embedded else []
            here = F.lit(True).alias(f"{child.prefix}#here")
            inner.df = inner.df.select("*", *value, here, *keyed)
            scope.df = scope.df.join(inner.df, match, "left").drop(*(f"{o}#join" for o in own))
        else:
            outs = []
            if child.embedded:
                outs.append(self._array(inner, rank).alias(f"{child.prefix}#value"))
            for i, e in enumerate(scope.node.aggregates.get(alias, ())):
                name = f"{child.prefix}#agg{i}"
                outs.append(self._aggregate(inner, alias, e).alias(name))
                scope.aggregated[e] = name
            grouped = inner.df.groupBy(*keyed).agg(*outs)
            scope.df = scope.df.join(grouped, match, "left").drop(*(f"{o}#join" for o in own))
            if child.embedded:
                name = f"{child.prefix}#value"
                scope.df = scope.df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(scope.df.schema[name].dataType)))
        scope.children[alias] = inner

    def _attach_function(self, scope: Scope, alias: str, child: Node) -> None:
        """Runs the function once for every distinct tuple of arguments; arguments see the parent."""
        compiler, f = scope.compiler(), child.function
        args = self.session.arguments(f, child.request.arguments, compiler)
        if child.scalar:
            scope.df = scope.df.withColumn(f"{child.prefix}#value", self.session.call(f, args))
            return
        names = [f"{child.prefix}#arg{i}" for i in range(len(args))]
        scope.df = scope.df.select("*", *(a.alias(n) for a, n in zip(args, names, strict=True)))
        over = self.session.run_lateral(f, scope.df.select(*(F.col(f"`{n}`") for n in names)).distinct(), names)
        inner = over.select(*over.columns[len(names):], *(F.col(f"`{n}`").alias(f"#{i}") for i, n in enumerate(names)))
        base = self.scan(child, inner)
        self._attach(scope, alias, child, [f"#{i}" for i in range(len(names))], names, base, None, null_safe=True)

    # per-key operations of a child
    def _terms(self, scope: Scope, order: list[Order]) -> list[tuple[Column, bool, bool]]:
        compiler = scope.compiler()
        return [(self._enum(scope, o.expr, compiler(o.expr)), o.desc, o.nulls_first) for o in order]

    @staticmethod
    def _enum(scope: Scope, e: Expr, c: Column) -> Column:
        """Labels sort as they are declared."""
        if e.op in ("col", ".") and e.args[0] in scope.node.columns and len(e.args) == 1:
            labels = scope.relation_field(e.args[0]).enum
            if labels:
                return F.nullif(F.array_position(F.array(*map(F.lit, labels)), c), F.lit(0))
        return c

    def _ties(self, scope: Scope) -> list[Column]:
        """Columns that fix the order of equals: the key, or all columns that can be ordered."""
        node = scope.node
        keys = [k for k in (node.relation.primary_key if node.relation else ()) if k in node.columns]
        return [scope.column(c) for c in (keys or [c for c, t in node.columns.items() if "map" not in t and "variant" not in t])]

    def _sorted(self, scope: Scope) -> list[Column]:
        return [_sort(*t) for t in self._terms(scope, scope.node.request.order_by)] + [c.asc_nulls_last() for c in self._ties(scope)]

    def _per_key(self, scope: Scope, keys: list[str]) -> tuple[DataFrame, str | None]:
        r, df = scope.node.request, scope.df
        by = [F.col(f"`{k}`") for k in keys]
        rank = None
        if r.distinct:
            value = f"{scope.node.prefix}#distinct"
            df = df.withColumn(value, self.value(scope)).dropDuplicates([*keys, value])
        elif r.distinct_on:
            compiler = scope.compiler()
            w = Window.partitionBy(*by, *map(compiler, r.distinct_on)).orderBy(*self._sorted(scope))
            df = df.withColumn(f"{scope.node.prefix}#first", F.row_number().over(w)).where(F.col(f"`{scope.node.prefix}#first`") == 1)
        if r.limit is not None or r.offset:
            rank = f"{scope.node.prefix}#rank"
            df = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*self._sorted(scope))))
            df = df.where(F.col(f"`{rank}`") > (r.offset or 0))
            if r.limit is not None:
                df = df.where(F.col(f"`{rank}`") <= (r.offset or 0) + r.limit)
        return df, rank

    def _array(self, scope: Scope, rank: str | None) -> Column:
        value = self.value(scope)
        if rank:
            keys: list[Column] | None = [F.col(f"`{rank}`")]
        else:
            terms = [(*t, scope.type_of(t[0])) for t in self._terms(scope, scope.node.request.order_by)]
            keys = aggregates.sort_keys([*terms, *((c, False, False, T.NullType()) for c in self._ties(scope))])
        if keys is None:
            terms2 = [*self._terms(scope, scope.node.request.order_by), *((c, False, False) for c in self._ties(scope))]
            row = F.struct(*(c.alias(f"k{i}") for i, (c, _, _) in enumerate(terms2)), value.alias("v"))
            return aggregates._ordered(F.collect_list(row), "v", [(d, n) for _, d, n in terms2])
        row = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("v"))
        return F.transform(F.array_sort(F.collect_list(row)), lambda s: s["v"])

    def _aggregate(self, inner: Scope, alias: str, e: Expr) -> Column:
        schema, name, args, where, distinct, order = e.args
        members = _Members(inner, alias)
        compiler = members.compiler()
        rows = [a for a in args if not (a.op == "." and a.args == (alias,))]
        columns = [compiler(a) for a in rows]
        condition = compiler(where) if where is not None else None
        if condition is not None:
            condition = F.coalesce(condition, F.lit(False))
        terms = [(compiler(x), d, n) for x, d, n in order]
        own = self.session.catalog.aggregate(name, schema)
        if own is not None:
            if len(columns) != own.arity or distinct or order:
                raise invalid(f"aggregate {name} takes {own.arity} arguments, no order and no distinct")
            return own.build(*(c if condition is None else F.when(condition, c) for c in columns))
        kinds = [inner.type_of(c) for c in columns] if name == "sum" else []
        return aggregates.aggregate(name, columns, kinds, distinct, condition, terms, self._ties(inner))

    def value(self, scope: Scope) -> Column:
        return scope.compiler()(scope.node.request.select)

    # the root
    def root(self, node: Node, base: DataFrame | None = None, keep_order: str | None = None) -> DataFrame:
        """The answer: a column for each key of the select, or ``value`` for a select without keys.

        ``base`` stands for the relation's rows when a write reads back what it wrote; ``keep_order``
        is then its column that holds the payload's order.
        """
        if node.scalar:
            args = self.session.arguments(node.function, node.request.arguments, Compiler(Scope(self, node, self.session.spark.range(1)), self.params))
            return self.session.spark.range(1).select(self.session.call(node.function, args).alias("value"))
        r = node.request
        df = self.scan(node) if base is None else base
        order_exprs = [o.expr for o in r.order_by]
        early = r.limit is not None and r.limit <= PRUNE_ROWS and not r.distinct and not r.distinct_on and base is None and bool(node.used or node.aggregates) \
            and bool(node.relation.primary_key) and not self._reaches(node, [*order_exprs, *([r.where] if r.where is not None else [])])
        if early:
            first = Scope(self, node, df)
            if r.where is not None:
                df = df.where(first.compiler()(r.where))
            first.df = df
            df = df.orderBy(*self._sorted(first))
            df = (df.offset(r.offset) if r.offset else df).limit(r.limit)
            scope = Scope(self, node, df)
            self.attach(scope, df)
        else:
            scope = self.filtered(node, df)
        outs = self.outputs(scope)
        names = {f"{node.prefix}#out{i}": k for i, (k, _) in enumerate(outs)}
        df = scope.df.select("*", *(c.alias(n) for n, (_, c) in zip(names, outs, strict=True)))
        if r.distinct:
            df = df.dropDuplicates(list(names))
        elif r.distinct_on:
            w = Window.partitionBy(*map(scope.compiler(), r.distinct_on)).orderBy(*self._sorted(scope))
            df = df.withColumn("#first", F.row_number().over(w)).where("`#first` = 1")
        if keep_order:
            df = df.orderBy(F.col(f"`{keep_order}`"))
        elif r.order_by:
            df = df.orderBy(*[_sort(*t) for t in self._terms(scope, r.order_by)], *([] if r.distinct else [c.asc_nulls_last() for c in self._ties(scope)] if node.relation.primary_key else []))
        if not early:
            df = df.offset(r.offset) if r.offset else df
            df = df.limit(r.limit) if r.limit is not None else df
        return df.select(*(F.col(f"`{n}`").alias(k) for n, k in names.items()))

    def outputs(self, scope: Scope) -> list[tuple[str, Column]]:
        select, compiler = scope.node.request.select, scope.compiler()
        if select.op == "star":
            return scope.star(select, compiler)
        if select.op == "object":
            return [(k, compiler(x)) for k, x in select.args]
        return [("value", compiler(select))]

    def count(self, node: Node) -> int:
        """Rows that where keeps; order, limit, distinct and unneeded children are not planned."""
        if node.scalar:
            return 1
        bare = Node(**{**node.__dict__, "used": set(), "aggregates": {}})
        if node.request.where is not None and self._reaches(node, [node.request.where]):
            bare = node
        return self.filtered(bare, self.scan(node)).df.count()


def _sort(c: Column, desc: bool, nulls_first: bool) -> Column:
    if desc:
        return c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
