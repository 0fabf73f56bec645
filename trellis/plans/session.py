"""Sessions: versions of tables, and the execution of requests over them.

A session maps relations to DataFrames. Writes derive new DataFrames; a request that fails, or asks for
a rollback, drops them, and one that succeeds swaps them in at its end, so a request is atomic.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, invalid, unknown
from ..operators.read import Reader
from ..operators.write import Writer
from ..sources.catalog import Catalog, Function, Relation
from ..streaming.rows import array_chunks, json_rows, object_chunks
from . import syntax
from .resolve import Node, Resolver
from .wellknown import WellKnown

_numbers = itertools.count()
SNAPSHOT = 16  # versions of a table from one checkpoint to the next


class Session:
    def __init__(self, spark: SparkSession, catalog: Catalog, wellknown: WellKnown | None = None, grants: dict[str, bool] | None = None):
        self.spark, self.catalog = spark, catalog
        self.wellknown = wellknown or WellKnown([])
        self.grants = {"count": True, "stats": True, "query_plan": True, "sql": True, "rollback": True} | (grants or {})
        self.tables: dict[tuple[str, str], DataFrame] = {}
        self.changed: set[tuple[str, str]] = set()
        self.depth: dict[tuple[str, str], int] = {}  # versions since the last that was written
        self.tag = f"trellis{next(_numbers)}"
        self._defined: set[str] = set()

    # tables and functions
    def table(self, relation: Relation) -> DataFrame:
        if relation.key not in self.tables:
            self.tables[relation.key] = relation.load(self.spark)
        return self.tables[relation.key]

    def put(self, relation: Relation, df: DataFrame) -> None:
        """The table's next version. Every SNAPSHOT versions its plan is cut by a checkpoint, where the
        session has a folder for them that all executors share."""
        self.depth[relation.key] = self.depth.get(relation.key, 0) + 1
        if self.depth[relation.key] >= SNAPSHOT and self.spark.sparkContext.getCheckpointDir() is not None:
            df, self.depth[relation.key] = df.checkpoint(), 0
        self.tables[relation.key] = df
        self.changed.add(relation.key)
        self._defined.clear()

    def save(self, folder: str) -> None:
        """Writes every changed table as a new version, then the manifest that makes them current."""
        version = f"{folder}/v{next(_numbers)}-{self.tag}"
        entries = []
        for key in sorted(self.changed):
            path = f"{version}/{'.'.join(key)}"
            self.tables[key].write.parquet(path)
            self.tables[key] = self.spark.read.schema(self.tables[key].schema).parquet(path)
            self.depth[key] = 0
            entries.append((*key, path))
        self.spark.createDataFrame(entries, "schema string, relation string, path string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        self.changed.clear()

    def load(self, folder: str) -> None:
        for r in self.spark.read.schema("schema string, relation string, path string").json(f"{folder}/manifest").collect():
            self.tables[(r["schema"], r["relation"])] = self.spark.read.parquet(r["path"])
        self._defined.clear()

    def function_columns(self, f: Function) -> dict[str, str]:
        return {x.name: x.dataType.simpleString() for x in T.DataType.fromDDL(f.returns)}

    def _name(self, f: Function) -> str:
        """The function's name in Spark, defined on first use after a change of tables."""
        name = f"{self.tag}_{f.schema}_{f.name}_{len(f.parameters)}"
        if name not in self._defined:
            views = {}
            for (schema, relation), r in self.catalog.relations.items():
                if f"{{{relation}}}" in f.body:
                    views[relation] = f"{self.tag}_{schema}_{relation}"
                    self.table(r).createOrReplaceTempView(views[relation])
            body = f.body.format_map(views)
            params = ", ".join(f"`{p.name}` {p.type}" for p in f.parameters)
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {f'TABLE({f.returns})' if f.table else f.returns} RETURN {body}")
            self._defined.add(name)
        return name

    @staticmethod
    def _packed(f: Function, args: list) -> list:
        """With what a variadic parameter takes as one array."""
        if not f.variadic:
            return args
        n = len(f.parameters) - 1
        return [*args[:n], *[None] * (n - len(args)), F.array(*args[n:])]

    def bound(self, f: Function, args: list[Column]) -> list[Column]:
        """Arguments by position, with defaults for those left out."""
        return [F.lit(p.default).cast(p.type) if a is None else a.cast(p.type) for p, a in itertools.zip_longest(f.parameters, self._packed(f, args))]

    def call(self, f: Function, args: list[Column]) -> Column:
        """``args`` are bound."""
        return F.call_function(self._name(f), *args)

    def arguments(self, f: Function, given: list | dict | None, compiler) -> list[Column]:
        given = given or []
        if isinstance(given, dict):
            named = {k: compiler(x) for k, x in given.items()}
        else:
            named = {p.name: x for p, x in zip(f.parameters, self._packed(f, [compiler(x) for x in given]), strict=False) if x is not None}
        missing = lambda p: F.array() if p.variadic else F.lit(p.default)
        return [(named[p.name] if p.name in named else missing(p)).cast(p.type) for p in f.parameters]

    def run_lateral(self, f: Function, args: DataFrame, names: list[str]) -> DataFrame:
        passed = ", ".join(f"a.`{n}`" for n in names)
        return self.spark.sql(f"SELECT a.*, f.* FROM {{a}} AS a, LATERAL {self._name(f)}({passed}) AS f", a=args)

    def run_function(self, f: Function, given, reader: Reader) -> DataFrame:
        from ..operators.expressions import Compiler

        class Nothing:
            """Arguments of a root see no columns."""

            def __getattr__(self, name):
                def refuse(*_):
                    raise unknown("arguments of a root function see no columns")
                return refuse

        args = self.arguments(f, given, Compiler(Nothing(), reader.params))
        names = [f"#arg{i}" for i in range(len(args))]
        one = self.spark.range(1).select(*(a.alias(n) for a, n in zip(args, names, strict=True)), *([] if args else [F.lit(1).alias("#none")]))
        return self.run_lateral(f, one, names).drop(*names, "#none")

    # requests
    def _resolve(self, item: syntax.Item) -> tuple[Node, dict]:
        if item.wellknown is not None:
            request, params = self.wellknown.bind(item.wellknown, item.params or {})
        else:
            request, params = item.request, {}
        return Resolver(self).tree(request), params

    def frame(self, query: Any) -> DataFrame:
        """One read as a DataFrame."""
        items, sequence = syntax.items(query)
        if sequence or items[0].has_data:
            raise invalid("a frame is one read")
        node, params = self._resolve(items[0])
        return Reader(self, params).root(node)

    def count(self, query: Any) -> int:
        node, params = self._resolve(syntax.items(query)[0][0])
        return Reader(self, params).count(node)

    def stream(self, query: Any) -> Iterator[str]:
        """JSON texts of the rows of one read, partition by partition."""
        df = self.frame(query)
        return json_rows(df, df.columns == ["value"] and self._scalar(query))

    def _scalar(self, query: Any) -> bool:
        item = syntax.items(query)[0][0]
        request = item.request or self.wellknown.bind(item.wellknown, item.params or {})[0]
        return request.select.op not in ("star", "object")

    def execute(self, query: Any) -> Any:
        """The response to a request: one item's bare, a sequence's as a list. All or nothing."""
        items, sequence = syntax.items(query)
        with self._whole():
            out = [self._collected(i) for i in items]
        return out if sequence and len(out) != 1 else out[0] if out else []

    def respond(self, query: Any) -> Iterator[str]:
        """The same response as JSON text, in pieces: rows are read partition by partition as it is taken.
        Writes count once it is taken to its end, and not at all if it is not."""
        items, sequence = syntax.items(query)
        many = sequence and len(items) != 1
        with self._whole():
            if many:
                yield "["
            for k, item in enumerate(items):
                if k:
                    yield ","
                yield from self._pieces(item)
            if many:
                yield "]"

    @contextmanager
    def _whole(self) -> Iterator[None]:
        """All or nothing: what fails, or is given up, leaves the tables as they were."""
        before, changed, depth = dict(self.tables), set(self.changed), dict(self.depth)
        try:
            yield
        except BaseException as e:
            self.tables, self.changed, self.depth = before, changed, depth
            self._defined.clear()
            if isinstance(e, AnalysisException):
                raise QueryError("QUERY_INVALID_EXPRESSION", str(e).splitlines()[0]) from e
            if isinstance(e, (PySparkException, Py4JJavaError)):  # streamed rows raise the latter
                raise QueryError("TRANSACTION_ERROR", str(e).splitlines()[0]) from e
            raise

    def _collected(self, item: syntax.Item) -> Any:
        with self._run(item) as (body, rows, scalar, single):
            if rows is not None:
                result = rows if isinstance(rows, list) else [json.loads(s, parse_float=Decimal) for s in json_rows(rows, scalar)]
                body["result"] = result[0] if single else result
        return body if item.enveloped else body.get("result")

    def _pieces(self, item: syntax.Item) -> Iterator[str]:
        with self._run(item) as (body, rows, scalar, single):
            texts = None if rows is None else iter(rows) if isinstance(rows, list) else json_rows(rows, scalar)
            if item.enveloped:
                if single and texts is not None:
                    body["result"], texts = json.loads(next(texts)), None
                yield from object_chunks(body, texts)
            elif texts is None:
                yield "null"
            else:
                yield from ([next(texts)] if single else array_chunks(texts))

    @contextmanager
    def _run(self, item: syntax.Item) -> Iterator[tuple[dict, DataFrame | list | None, bool, bool]]:
        """Runs an item: the members of its response beside the result, and the rows of that, to be read
        inside, whether they are bare values and whether they are one value."""
        if item.rollback and not self.grants["rollback"]:
            raise QueryError("QUERY_ROLLBACK_NOT_GRANTED", "rollback is not granted")
        node, params = self._resolve(item)
        mode = node.request.write_mode
        writes = item.has_data or mode == "delete"
        before, changed, depth = dict(self.tables), set(self.changed), dict(self.depth)
        reader = Reader(self, params)
        body: dict[str, Any] = {}
        if writes:
            writer = Writer(self, node, item.data, params, item.sql and self.grants["sql"], item.query_plan and self.grants["query_plan"])
            rows = writer.run(item.returns != "none")
            if item.stats and self.grants["stats"]:
                body["stats"] = writer.stats
            if item.query_plan and self.grants["query_plan"]:
                body["query_plan"] = writer.plans
            if item.sql and self.grants["sql"]:
                body["sql"] = writer.texts
        else:
            rows = reader.root(node)
            if item.count and self.grants["count"]:
                body |= {"count": reader.count(node), "offset": node.request.offset or 0}
                if node.request.limit is not None:
                    body["limit"] = node.request.limit
            if item.query_plan and self.grants["query_plan"]:
                body["query_plan"] = [{"path": [], "plan": plan_tree(rows)}]
            if item.sql and self.grants["sql"]:
                body["sql"] = [{"path": [], "select": logical_text(rows)}]
        yield body, None if item.returns == "none" else rows, node.scalar or node.request.select.op not in ("star", "object"), node.scalar
        if item.rollback:
            self.tables, self.changed, self.depth = before, changed, depth
            self._defined.clear()


def plan_tree(df: DataFrame) -> dict[str, Any]:
    """The physical plan: node, what it does, and what it reads from."""
    def tree(plan) -> dict[str, Any]:
        if plan.nodeName() == "AdaptiveSparkPlan":
            return tree(plan.inputPlan())
        below = plan.children()
        out = {"node": plan.nodeName().strip(), "does": plan.simpleString(50)}
        return out | ({"reads": [tree(below.apply(i)) for i in range(below.size())]} if below.size() else {})
    return tree(df._jdf.queryExecution().executedPlan())


def logical_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()
