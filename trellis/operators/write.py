"""Nested writes: a payload shaped like a read, applied relation by relation to new table versions.

The payload is one request's and lives in the driver; tables never do. Rows of the payload meet a table
in joins on its identity: an equi-join finds which exist (their keys alone come back, at most as many as
the payload has rows), one left join with masks updates, a union inserts, an anti-join deletes. Order is
that of dependencies: referenced rows, the row itself, referring rows; then deletes, deepest first.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import QueryError, invalid
from ..plans.resolve import Node
from ..plans.syntax import Expr
from ..sources.values import read_value
from .read import Reader, _all

DELETING = frozenset(("merge", "merge-new", "merge-update", "deleteonly"))
UPDATING = frozenset(("merge-update", "update-existing"))
BROADCAST_ROWS = 10_000


@dataclass
class Row:
    values: dict[str, Any]
    joins: dict[str, Any] = field(default_factory=dict)  # by alias: rows, None, or absent
    stored: bool = True
    given: set[str] = field(default_factory=set)
    unlinked: set[str] = field(default_factory=set)  # foreign keys of joins that the row leaves out


class Parts(dict):
    """Sub-fields of a composite that a row names, by path joined with #."""

    def whole(self) -> dict:
        out: dict = {}
        for path, v in self.items():
            at = out
            *head, last = path.split("#")
            for h in head:
                at = at.setdefault(h, {})
            at[last] = v
        return out


@dataclass
class Shape:
    """What of a node's select a payload can set: by payload key, a column path or a child's alias."""

    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    children: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, Any] = field(default_factory=dict)


class Writer:
    def __init__(self, session, node: Node, data: Any, params: dict, sql: bool = False, plan: bool = False):
        self.session, self.root, self.data, self.params = session, node, data, params
        self.want_sql, self.want_plan = sql, plan
        self.stats: list[dict] = []
        self.texts: list[dict] = []
        self.plans: list[dict] = []
        self.shapes: dict[int, Shape] = {}

    def run(self, read_back: bool) -> DataFrame | list | None:
        """Writes, and plans what is read back: rows as a frame, or none."""
        node = self.root
        if node.function is not None:
            raise QueryError("WRITE_FORBIDDEN_FUNCTION_ROOT", "a function's rows are not written")
        self._modes(node, None)
        mode = node.write_mode
        if mode == "readonly":
            raise QueryError("WRITE_FORBIDDEN", "the root is readonly")
        if mode in ("update", "delete"):
            return self._where_driven(node, read_back)
        if isinstance(self.data, DataFrame):
            return self._frame_written(node, self.data, read_back)
        if not isinstance(self.data, list):
            raise invalid("data is an array of rows")
        rows = self._rows(node, self.data)
        self._write(node, rows)
        self._deletes(node, rows, None)
        if not read_back:
            return None
        return self._read_back(node, [r for r in rows if r.stored])

    # modes and shapes
    def _modes(self, node: Node, parent: Node | None) -> None:
        asked = node.request.write_mode
        if parent is None:
            node.write_mode = asked or "insert"
        elif parent.write_mode in ("readonly", "update", "delete") or node.function is not None or node.implicit:
            node.write_mode = "readonly"
        else:
            node.write_mode = asked or ("upsert" if node.to_one else "merge")
        mode = node.write_mode
        if mode in ("update", "delete"):
            if parent is not None:
                raise QueryError("WRITE_FORBIDDEN", f"{mode} is for the root")
            if node.request.where is None:
                raise QueryError("WRITE_FORBIDDEN", f"{mode} needs where")
            if mode == "delete" and node.request.join:
                raise QueryError("WRITE_FORBIDDEN", "delete takes no join")
        if mode in DELETING and (parent is None or node.to_one):
            raise QueryError("WRITE_FORBIDDEN", f"{mode} is for joined relations of many rows")
        if mode != "readonly":
            if node.relation.view:
                raise QueryError("WRITE_FORBIDDEN", f"{node.relation.name} is a view")
            if mode != "delete":
                self.shapes[node.number] = self._shape(node)
        for child in node.children.values():
            self._modes(child, node)

    def _shape(self, node: Node) -> Shape:
        shape, select = Shape(), node.request.select
        if select.op == "star":
            entries = [(c, Expr("col", (c,))) for c in node.columns if c not in select.args[1]]
            entries += [(a, Expr(".", (a,))) for a, c in node.children.items() if select.args[0] and not c.implicit and a not in select.args[1]]
            entries += list(select.args[2])
        elif select.op == "object":
            entries = list(select.args)
        else:
            raise QueryError("WRITE_FORBIDDEN", "a select without keys is not written")
        seen: dict[tuple[str, ...], int] = {}
        for key, e in entries:
            while e.op == "coalesce" or e.op == "??":
                e = e.args[0]
            path = None
            if e.op in ("col", "set"):
                path = (e.args[0],)
                written = e.args[2] if e.op == "col" and len(e.args) > 2 else e.args[1] if e.op == "set" and len(e.args) > 1 else None
                if written is not None:
                    shape.defaults[e.args[0]] = node.relation.field_of(e.args[0]).default if written.op == "default" else written.args[1]
            elif e.op == "." and isinstance(e.args[0], str):
                if e.args[0] in node.children and len(e.args) == 1:
                    shape.children[key] = e.args[0]
                elif e.args[0] in node.columns:
                    path = e.args
            if path and path[0] in node.columns and not node.relation.field_of(path[0]).generated:
                seen[path] = seen.get(path, 0) + 1
                shape.columns[key] = path
        shape.columns = {k: p for k, p in shape.columns.items() if seen[p] == 1}
        identity = self.identity(node)
        if node.write_mode not in ("insert", "update", "delete") and not (identity and all((c,) in shape.columns.values() or c in dict(node.on) for c in identity)):
            raise QueryError("WRITE_FORBIDDEN", f"the identity of {node.relation.name} is not writable in this select")
        return shape

    def identity(self, node: Node) -> tuple[str, ...]:
        r, asked = node.relation, node.request.on_conflict
        if asked is None:
            return r.primary_key
        if isinstance(asked, str):
            if asked not in r.unique:
                raise QueryError("UNKNOWN_IDENTIFIER", f"{r.name} has no constraint {asked}")
            return r.unique[asked]
        if not r.is_unique(asked):
            raise QueryError("UNKNOWN_IDENTIFIER", f"no constraint of {r.name} covers {asked}")
        return tuple(asked)

    # payload to rows
    def _rows(self, node: Node, data: list) -> list[Row]:
        return [self._row(node, d) for d in data]

    def _row(self, node: Node, d: Any) -> Row:
        if not isinstance(d, dict):
            raise invalid(f"a row of {node.relation.name} is an object")
        shape, kinds = self.shapes[node.number], self._kinds(node)
        row = Row({})
        for key, (column, *sub) in shape.columns.items():
            if key not in d:
                continue
            if sub:
                at = kinds[column]
                for s in sub:
                    at = at[s].dataType
                row.values.setdefault(column, Parts())
                if isinstance(row.values[column], Parts):
                    row.values[column]["#".join(sub)] = read_value(d[key], at, f"{column}.{'.'.join(sub)}")
                row.given.add(column)
            else:
                row.values[column] = read_value(d[key], kinds[column], column, node.relation.field_of(column))
                row.given.add(column)
        for column, value in shape.defaults.items():
            if column not in row.given and node.write_mode not in UPDATING:
                row.values[column] = read_value(value, kinds[column], column, node.relation.field_of(column))
                row.given.add(column)
        for key, alias in shape.children.items():
            child = node.children[alias]
            if child.write_mode == "readonly" or key not in d:
                continue
            v = d[key]
            if v is None:
                row.joins[alias] = None if child.to_one else []
            elif child.to_one:
                row.joins[alias] = [self._row(child, v)]
            elif isinstance(v, list):
                row.joins[alias] = self._rows(child, v)
            else:
                raise invalid(f"{alias} is an array of rows")
        return row

    def _kinds(self, node: Node) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.session.table(node.relation).schema}

    # phase one
    def _write(self, node: Node, rows: list[Row]) -> None:
        for alias, child in node.children.items():
            if child.write_mode == "readonly" or not child.to_one:
                continue
            below = [x for r in rows for x in r.joins.get(alias) or ()]
            if below:
                self._write(child, below)
            for r in rows:
                if alias not in r.joins:
                    r.unlinked |= {far for _, far in child.on if far not in r.given}
                    continue
                for own, far in child.on:
                    got = r.joins[alias]
                    r.values[far] = got[0].values.get(own) if got else None
                    r.given.add(far)
        self._store(node, rows)
        for alias, child in node.children.items():
            if child.write_mode == "readonly" or child.to_one:
                continue
            below = []
            for r in rows:
                for x in r.joins.get(alias) or () if r.stored else ():
                    for own, far in child.on:
                        x.values[own] = r.values.get(far)
                        x.given.add(own)
                    below.append(x)
            if below or any(alias in r.joins for r in rows):
                self._write(child, below)

    def _frame(self, node: Node, records: list[dict], columns: list[str], extra: dict[str, T.DataType] | None = None) -> DataFrame:
        kinds = self._kinds(node) | (extra or {})
        schema = T.StructType([T.StructField(c, kinds[c], True) for c in columns])
        # an Arrow table becomes a relation local to the driver, whose size the planner knows
        arrow = to_arrow_schema(schema)
        data = pa.table([pa.array([_local(r.get(f.name)) for r in records], f.type) for f in arrow], schema=arrow)
        df = self.session.spark.createDataFrame(data, schema=schema)
        return F.broadcast(df) if len(records) <= BROADCAST_ROWS else df

    def _existing(self, node: Node, rows: list[Row], identity: tuple[str, ...], columns: list[str]) -> dict[tuple, dict]:
        """Stored rows with the identities of the payload: at most one each."""
        asked = [r.values for r in rows if all(r.values.get(c) is not None for c in identity)]
        if not asked or not identity:
            return {}
        table = self.session.table(node.relation)
        want = list(dict.fromkeys([*identity, *columns]))
        found = table.select(*want).join(self._frame(node, asked, list(identity)).distinct(), list(identity), "left_semi").collect()
        return {tuple(_plain(r[c]) for c in identity): r.asDict() for r in found}

    def _store(self, node: Node, rows: list[Row]) -> None:
        mode, r, identity = node.write_mode, node.relation, self.identity(node)
        stat = {"path": list(node.path), "table": f"{r.schema}.{r.name}", "submitted": len(rows), "inserted": 0, "updated": 0, "deleted": 0}
        self.stats.append(stat)
        if mode == "deleteonly" or not rows:
            return
        linked = [far for c in node.children.values() for _, far in c.on]
        existing = self._existing(node, rows, identity, [*r.primary_key, *linked])
        inserts: list[Row] = []
        updates: list[tuple[Row, set[str]]] = []
        seen: set[tuple] = set()
        for row in rows:
            key = tuple(_plain(row.values.get(c)) for c in identity)
            if None not in key and identity:
                if key in seen and mode in ("insert", "upsert", "merge"):
                    raise QueryError("PG_UNIQUE_VIOLATION", f"{r.name}: {key} is in the payload twice")
                if key in seen:
                    continue
                seen.add(key)
            old = existing.get(key)
            if old is not None:
                if mode == "insert":
                    raise QueryError("PG_UNIQUE_VIOLATION", f"{r.name}: {key} exists")
                for c in (*r.primary_key, *linked):
                    if c in r.primary_key or c not in row.given or mode == "merge-new":
                        row.values[c] = old[c]
                if mode == "merge-new":
                    continue
                fixed = set(identity) | set(r.primary_key)
                if mode in UPDATING:
                    change = row.given - fixed
                else:
                    change = set(self._insertable(node)) - fixed - row.unlinked
                    self._fill(node, row)
                    self._fill_parts(node, row)
                allowed = node.request.update_columns
                updates.append((row, change if allowed is None else change & set(allowed)))
            elif mode in UPDATING:
                row.stored = False
            else:
                inserts.append(row)
        self._apply_updates(node, identity, updates)
        self._apply_inserts(node, inserts)
        stat["inserted"], stat["updated"] = len(inserts), len(updates)

    def _insertable(self, node: Node) -> list[str]:
        """Columns that a whole row of this select covers: those it can set, and the join's own."""
        shape = self.shapes[node.number]
        linked = [far for a, c in node.children.items() if c.to_one and c.write_mode != "readonly" for _, far in c.on]
        return list(dict.fromkeys([*(p[0] for p in shape.columns.values()), *dict(node.on), *linked]))

    def _fill(self, node: Node, row: Row) -> None:
        kinds = self._kinds(node)
        allowed = node.request.insert_columns
        for c in node.columns:
            f = node.relation.field_of(c)
            if allowed is not None and c not in allowed and c not in self.identity(node) and c not in dict(node.on):
                row.values.pop(c, None)
                row.given.discard(c)
            if f.has_default and (c not in row.given or (row.values.get(c) is None and not f.nullable)):
                default = f.default() if callable(f.default) else f.default
                row.values[c] = read_value(default, kinds[c], c, f) if isinstance(default, (str, int, float, bool, list, dict)) else default

    def _fill_parts(self, node: Node, row: Row) -> None:
        """Sub-fields that a prepared row leaves out are null; those that no key names stay."""
        for column, *sub in self.shapes[node.number].columns.values():
            if sub and not (column in row.given and not _partial(row.values.get(column))):
                if not _partial(row.values.get(column)):
                    row.values[column] = Parts()
                row.values[column].setdefault("#".join(sub), None)

    def _apply_inserts(self, node: Node, rows: list[Row]) -> None:
        if not rows:
            return
        r = node.relation
        table = self.session.table(r)
        identity = self.identity(node)
        # rows with a whole identity are known to be new
        new = bool(identity) and all(row.values.get(c) is not None for row in rows for c in identity)
        for row in rows:
            self._fill(node, row)
        for c in node.columns:
            f = r.field_of(c)
            if f.identity and any(row.values.get(c) is None for row in rows):
                top = table.agg(F.max(c)).first()[0] or 0
                top = max([top, *(row.values[c] for row in rows if row.values.get(c) is not None)])
                for row in rows:
                    if row.values.get(c) is None:
                        top += 1
                        row.values[c] = top
            if (not f.nullable or c in r.primary_key) and not f.generated and any(row.values.get(c) is None for row in rows):
                raise QueryError("PG_NOT_NULL_VIOLATION", f"{r.name}.{c} is null")
        for columns in r.unique_sets():
            keys = [tuple(_plain(row.values.get(c)) for c in columns) for row in rows]
            whole = [k for k in keys if None not in k]
            if len(set(whole)) < len(whole) or (not (new and columns == identity) and self._existing(node, rows, columns, [])):
                raise QueryError("PG_UNIQUE_VIOLATION", f"{r.name}({', '.join(columns)}) is not unique")
        new = self._frame(node, [row.values for row in rows], list(node.columns))
        self._put(node, "insert", table.unionByName(new))

    def _apply_updates(self, node: Node, identity: tuple[str, ...], updates: list[tuple[Row, set[str]]]) -> None:
        columns = sorted({c for _, change in updates for c in change})
        if not columns:
            return
        kinds = self._kinds(node)
        for row, change in updates:
            for c in change:
                if not node.relation.field_of(c).nullable and row.values.get(c) is None:
                    if not node.relation.field_of(c).has_default:
                        raise QueryError("PG_NOT_NULL_VIOLATION", f"{node.relation.name}.{c} is null")
        plain = [c for c in columns if not any(_partial(row.values.get(c)) for row, _ in updates)]
        parts = sorted({(c, p) for row, change in updates for c in change if c not in plain and isinstance(row.values.get(c), Parts) for p in row.values[c]})
        extra = {f"#{c}": kinds[c] for c in plain} | {f"#has {c}": T.BooleanType() for c in plain}
        for c, p in parts:
            at = kinds[c]
            for s in p.split("#"):
                at = at[s].dataType
            extra |= {f"#{c}#{p}": at, f"#has {c}#{p}": T.BooleanType()}
        records = []
        for row, change in updates:
            rec = {c: row.values[c] for c in identity}
            for c in plain:
                rec |= {f"#{c}": row.values.get(c), f"#has {c}": c in change}
            for c, p in parts:
                own = row.values.get(c) if isinstance(row.values.get(c), Parts) else {}
                rec |= {f"#{c}#{p}": own.get(p), f"#has {c}#{p}": c in change and p in own}
            records.append(rec)
        news = self._frame(node, records, [*identity, *extra], extra)
        joined = self.session.table(node.relation).join(news, list(identity), "left")
        outs = []
        for c in node.columns:
            out = F.col(f"`{c}`")
            if c in plain:
                out = F.when(F.col(f"`#has {c}`"), F.col(f"`#{c}`")).otherwise(out)
            for c2, p in parts:
                if c2 == c:
                    base = F.coalesce(out, F.lit(None).cast(kinds[c]))
                    base = F.when(base.isNotNull(), base).otherwise(F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds[c])))
                    out = F.when(F.col(f"`#has {c}#{p}`"), base.withField(p.replace("#", "."), F.col(f"`#{c}#{p}`"))).otherwise(out)
            outs.append(out.alias(c))
        self._put(node, "update", joined.select(*outs))

    def _put(self, node: Node, what: str, df: DataFrame) -> None:
        from ..plans.session import logical_text, plan_tree

        self.session.put(node.relation, df)
        if self.want_sql:
            self.texts.append({"path": list(node.path), what: logical_text(df)})
        if self.want_plan:
            self.plans.append({"path": list(node.path), "plan": plan_tree(df)})

    # a frame as payload: rows of one relation, of any number
    def _frame_written(self, node: Node, data: DataFrame, read_back: bool) -> DataFrame | None:
        """Inserts, upserts or updates the rows of a frame, whose columns are the select's keys. The rows stay
        where they are: they meet the table in joins on the identity. Values are cast to the columns' types.
        What is read back is in no order."""
        mode, r, shape, kinds = node.write_mode, node.relation, self.shapes[node.number], self._kinds(node)
        if mode not in ("insert", "upsert", "update-existing") or any(k in shape.children and node.children[shape.children[k]].write_mode != "readonly" for k in data.columns):
            raise QueryError("WRITE_FORBIDDEN", "a frame is inserted, upserted or updated into one relation")
        given = {path[0]: key for key, path in shape.columns.items() if key in data.columns}
        if any(len(shape.columns[key]) > 1 for key in given.values()):
            raise QueryError("WRITE_FORBIDDEN", "a frame writes whole columns")
        identity = self.identity(node)
        lacking = [c for c in identity if c not in given and not r.field_of(c).identity]
        if lacking or (mode != "insert" and any(c not in given for c in identity)) or (read_back and not identity):
            raise QueryError("WRITE_FORBIDDEN", f"the identity of {r.name} is not in the frame")
        table, columns = self.session.table(r), list(node.columns)
        new = data.select(*(F.col(f"`{key}`").cast(kinds[c]).alias(c) for c, key in given.items()))
        if mode != "update-existing":
            if any(r.field_of(c).identity for c in columns):
                new = _numbered(new, "#at")
            new = new.select(*(self._prepared(node, new, c, given, kinds[c]).alias(c) for c in columns))
        if self.session.spark.sparkContext.getCheckpointDir() is not None:
            new = new.checkpoint()  # read several times, and maybe never the same twice
        stat = {"path": [], "table": f"{r.schema}.{r.name}", "submitted": new.count(), "inserted": 0, "updated": 0, "deleted": 0}
        self.stats.append(stat)
        for c in new.columns:
            if (not r.field_of(c).nullable or c in r.primary_key) and not r.field_of(c).generated and not new.where(F.col(f"`{c}`").isNull()).isEmpty():
                raise QueryError("PG_NOT_NULL_VIOLATION", f"{r.name}.{c} is null")
        sets = [u for u in dict.fromkeys((identity, *r.unique_sets())) if u and set(u) <= set(new.columns)]
        for u in sets:
            if not new.dropna(subset=list(u)).groupBy(*u).count().where("count > 1").isEmpty():
                raise QueryError("PG_UNIQUE_VIOLATION", f"{r.name}({', '.join(u)}) is in the payload twice")
        old = None
        if mode != "insert":
            change = set(given) if mode == "update-existing" else set(self._insertable(node))
            allowed = node.request.update_columns
            change = (change if allowed is None else change & set(allowed)) - set(identity) - set(r.primary_key)
            side = new.select(*identity, *(F.col(f"`{c}`").alias(f"#{c}") for c in change), F.lit(True).alias("#hit"))
            stat["updated"] = new.join(table, list(identity), "left_semi").count()
            old = table.join(side, list(identity), "left").select(*(F.when(F.col("`#hit`"), F.col(f"`#{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in change else F.col(f"`{c}`") for c in columns))
        if mode == "update-existing":
            self._put(node, "update", old)
        else:
            fresh = new if mode == "insert" else new.join(table, list(identity), "left_anti")
            for u in sets:
                if (mode == "insert" or u != identity) and not fresh.join(table, list(u), "left_semi").isEmpty():
                    raise QueryError("PG_UNIQUE_VIOLATION", f"{r.name}({', '.join(u)}) is not unique")
            stat["inserted"] = stat["submitted"] - stat["updated"]
            if stat["updated"]:
                self._put(node, "update", old)
            self._put(node, "insert", self.session.table(r).unionByName(fresh.select(*columns)))
        if not read_back:
            return None
        reader = Reader(self.session, self.params)
        ids = new.select(*(F.col(f"`{c}`").alias(f"{c}#id") for c in identity))
        base = reader.scan(node)
        base = base.join(ids, _all([F.col(f"`{node.prefix}{c}`") == F.col(f"`{c}#id`") for c in identity]), "left_semi")
        return reader.root(_without(node, where=None, limit=None, offset=None, order_by=[]), base)

    def _prepared(self, node: Node, new: DataFrame, c: str, given: dict[str, str], kind: T.DataType):
        """A column of a whole new row: what the frame has, or a number, or the default."""
        f = node.relation.field_of(c)
        allowed = node.request.insert_columns
        has = c in given and (allowed is None or c in allowed or c in self.identity(node))
        out = F.col(f"`{c}`") if has else F.lit(None).cast(kind)
        if f.identity:
            top = self.session.table(node.relation).agg(F.max(c)).first()[0] or 0
            top = max(top, new.agg(F.max(c)).first()[0] or 0) if has else top
            return F.coalesce(out, (F.lit(top) + F.col("`#at`")).cast(kind))
        if f.has_default:
            value = f.default() if callable(f.default) else f.default
            default = self._literal(node, c, value, kind)
            return default if not has else out if f.nullable else F.coalesce(out, default)
        return out

    # phase two
    def _deletes(self, node: Node, rows: list[Row], _parent) -> None:
        for alias, child in node.children.items():
            if child.write_mode == "readonly":
                continue
            owners = [r for r in rows if r.stored and alias in r.joins]
            below = [x for r in owners for x in r.joins[alias] or ()]
            self._deletes(child, below, node)
            if child.write_mode in DELETING and owners:
                self._delete_missing(node, child, owners, below)

    def _delete_missing(self, node: Node, child: Node, owners: list[Row], kept: list[Row]) -> None:
        identity = self.identity(child)
        reader = Reader(self.session, self.params)
        scope = reader.filtered(Node(**{**child.__dict__, "used": set(), "aggregates": {}}), reader.scan(child))
        own = [own for own, _ in child.on]
        parents = self._frame(child, [{o: r.values.get(far) for o, far in child.on} for r in owners], own).distinct()
        rows = scope.df.select(*(scope.column(c).alias(c) for c in dict.fromkeys([*identity, *own])))
        doomed = rows.join(parents, own, "left_semi").select(*identity)
        ids = [x.values for x in kept if x.stored and all(x.values.get(c) is not None for c in identity)]
        if ids:
            doomed = doomed.join(self._frame(child, ids, list(identity)), list(identity), "left_anti")
        n = doomed.count()
        if n:
            small = F.broadcast(doomed) if n <= BROADCAST_ROWS else doomed
            columns = list(child.columns)
            self._put(child, "delete", self.session.table(child.relation).join(small, list(identity), "left_anti").select(*columns))
        next(s for s in self.stats if s["path"] == list(child.path))["deleted"] += n

    # update and delete by where
    def _where_driven(self, node: Node, read_back: bool):
        r, reader = node.relation, Reader(self.session, self.params)
        table, columns = self.session.table(r), list(node.columns)
        stat = {"path": [], "table": f"{r.schema}.{r.name}", "submitted": 0, "inserted": 0, "updated": 0, "deleted": 0}
        self.stats.append(stat)
        own = not reader._reaches(node, [node.request.where])
        if not own and not r.primary_key:
            raise QueryError("WRITE_FORBIDDEN", f"{r.name} has no key to find rows by")
        matched = reader.filtered(node, reader.scan(node))
        n = matched.df.count()
        renamed = table.select(*(F.col(f"`{c}`").alias(f"{node.prefix}{c}") for c in columns))
        key = [f"{node.prefix}{c}" for c in r.primary_key]
        if own:
            hit = F.coalesce(matched.compiler()(node.request.where), F.lit(False))
        else:
            ids = matched.df.select(*(F.col(f"`{k}`").alias(f"{k}#hit") for k in key)).distinct()
            ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
            renamed = renamed.join(ids, _all([F.col(f"`{k}`") == F.col(f"`{k}#hit`") for k in key]), "left")
            hit = F.col(f"`{key[0]}#hit`").isNotNull()
        if node.write_mode == "delete":
            stat["deleted"] = n
            self._put(node, "delete", renamed.where(~hit).select(*(F.col(f"`{node.prefix}{c}`").alias(c) for c in columns)))
            return [] if read_back else None
        if not isinstance(self.data, dict):
            raise invalid("the data of an update is one object")
        stat["submitted"], stat["updated"] = 1, n
        row = self._row(node, self.data)
        allowed = node.request.update_columns
        change = {c for c in row.given if allowed is None or c in allowed}
        kinds = self._kinds(node)
        outs = []
        for c in columns:
            out = F.col(f"`{node.prefix}{c}`")
            if c in change:
                value = row.values[c]
                if value is None and not r.field_of(c).nullable:
                    raise QueryError("PG_NOT_NULL_VIOLATION", f"{r.name}.{c} is null")
                if _partial(value):
                    new = out
                    for p, v in value.items():
                        new = new.withField(p.replace("#", "."), F.lit(v))
                else:
                    new = self._literal(node, c, value, kinds[c])
                out = F.when(hit, new).otherwise(out)
            outs.append(out.alias(c))
        self._put(node, "update", renamed.select(*outs))
        # the usual read: rows that no longer match are written but not returned
        return Reader(self.session, self.params).root(node) if read_back else None

    def _literal(self, node: Node, c: str, value: Any, kind: T.DataType):
        if isinstance(value, (dict, list)):
            import json

            return F.from_json(F.lit(json.dumps(value, default=str)), kind.json() if isinstance(kind, T.StructType) else kind)
        if isinstance(value, bytearray):
            value = bytes(value)
        if isinstance(value, dt.datetime) and value.tzinfo is None:
            return F.lit(value.isoformat(sep=" ")).cast(kind)
        return F.lit(value).cast(kind)

    def _read_back(self, node: Node, rows: list[Row]) -> DataFrame | list:
        """The written roots in the payload's order, through the request's own select."""
        identity = self.identity(node) or tuple(node.columns)
        if not rows:
            return []
        reader = Reader(self.session, self.params)
        records = [{**{c: r.values.get(c) for c in identity}, "#row": i} for i, r in enumerate(rows)]
        order = self._frame(node, records, [*identity, "#row"], {"#row": T.LongType()})
        order = order.select(*(F.col(f"`{c}`").alias(f"{c}#id") for c in identity), "#row")
        base = reader.scan(node)
        same = _all([F.col(f"`{node.prefix}{c}`").eqNullSafe(F.col(f"`{c}#id`")) for c in identity])
        base = base.join(order, same).drop(*(f"{c}#id" for c in identity))
        return reader.root(_without(node, where=None, limit=None, offset=None, order_by=[]), base, "#row")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Numbers rows from 1 without gaps: in partitions, and after the rows of those before."""
    placed = df.withColumn("#id", F.monotonically_increasing_id()).withColumn("#part", F.shiftright("`#id`", 33))
    before = Window.orderBy("`#part`").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = placed.groupBy("`#part`").count().select("`#part`", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("#ahead"))
    return placed.join(F.broadcast(parts), "#part").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("`#ahead`") + F.col("`#id`").bitwiseAND((1 << 33) - 1) + 1).alias(name))


def _without(node: Node, **changes) -> Node:
    """The node with other clauses; what it reads back is chosen by identity."""
    from dataclasses import replace

    return Node(**{**node.__dict__, "request": replace(node.request, **changes)})


def _partial(v: Any) -> bool:
    return isinstance(v, Parts)


def _plain(v: Any) -> Any:
    return bytes(v) if isinstance(v, bytearray) else v


def _local(v: Any) -> Any:
    if isinstance(v, Parts):
        return v.whole()
    return bytes(v) if isinstance(v, bytearray) else v
