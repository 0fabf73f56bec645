"""Requests resolved against the catalog: a tree of nodes with relations, join keys and cardinality,
and which of a node's children anything needs (others are never planned)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from ..errors import QueryError, invalid, unknown
from ..sources.catalog import Function, Relation
from .syntax import Expr, Request

if TYPE_CHECKING:
    from .session import Session


@dataclass
class Node:
    request: Request
    relation: Relation | None
    columns: dict[str, str]
    number: int
    path: tuple[str, ...] = ()
    parent: Node | None = None
    function: Function | None = None
    on: list[tuple[str, str]] = field(default_factory=list)  # (own column, parent's column)
    to_one: bool = False
    implicit: bool = False  # a computed field over rows: not part of *
    children: dict[str, Node] = field(default_factory=dict)
    embedded: bool = False
    used: set[str] = field(default_factory=set)  # children that are joined for a value or a hop
    aggregates: dict[str, list[Expr]] = field(default_factory=dict)
    write_mode: str = ""

    @property
    def prefix(self) -> str:
        return f"t{self.number}_"

    @property
    def scalar(self) -> bool:
        return self.function is not None and not self.function.table

    def subtree(self):
        yield self
        for c in self.children.values():
            yield from c.subtree()


class Resolver:
    def __init__(self, session: Session):
        self.session, self.catalog = session, session.catalog
        self.number = 0

    def tree(self, request: Request) -> Node:
        root = self._node(request, None, (), 1)
        root.embedded = True
        self._mark(root)
        return root

    def _node(self, r: Request, parent: Node | None, path: tuple[str, ...], depth: int) -> Node:
        if depth > self.catalog.max_depth:
            raise invalid(f"queries nest {self.catalog.max_depth} deep at most")
        if parent is None and r.on:
            raise invalid("the root has nothing to join on")
        self.number += 1
        if r.is_function:
            node = self._function_node(r, parent, path)
        else:
            relation = self.catalog.relation(r.name, r.schema)
            node = Node(r, relation, dict(self.session.table(relation).dtypes), self.number, path, parent)
            if parent is not None:
                node.to_one = self._link(node, parent)
        for alias, child in r.join.items():
            node.children[alias] = self._node(child, node, (*path, alias), depth + 1)
        for name, computed in (node.relation.computed if node.relation else {}).items():
            if computed.relation and name not in node.children and name not in node.columns:
                self.number += 1
                target = self.catalog.relation(computed.relation)
                node.children[name] = Node(Request(computed.relation, select=Expr("star", (False, (), ()))), target, dict(self.session.table(target).dtypes), self.number, (*path, name), node, None, list(computed.on), implicit=True)
        return node

    def _function_node(self, r: Request, parent: Node | None, path: tuple[str, ...]) -> Node:
        args = r.arguments if r.arguments is not None else []
        f = self.catalog.function(r.name, r.schema, None if isinstance(args, dict) else len(args), args if isinstance(args, dict) else ())
        if f is None:
            raise unknown(f"no function {r.name}")
        if r.on:
            raise invalid("a function joins by its arguments")
        if not f.table:
            return Node(r, None, {}, self.number, path, parent, f, to_one=True)
        columns = self.session.function_columns(f)
        if f.relation:
            relation = self.catalog.relation(f.relation)
        else:
            if parent is not None:
                raise QueryError("JOIN_MISSING_INDEX", f"{f.name} returns records without a key, which cannot be joined")
            relation = Relation(f.name, load=None, view=True)  # type: ignore[arg-type]
        return Node(r, relation, columns, self.number, path, parent, f, to_one=not f.many)

    def _link(self, node: Node, parent: Node) -> bool:
        if not node.request.on:
            raise invalid(f"join {node.path[-1]} has no on")
        if parent.relation is None:
            raise invalid("a scalar function has no columns to join on")
        for own, far in node.request.on.items():
            if own not in node.columns:
                raise unknown(f"{node.relation.name} has no column {own}")
            if far not in parent.columns:
                raise unknown(f"{parent.relation.name} has no column {far}")
        node.on = sorted(node.request.on.items())
        own, far = zip(*node.on, strict=True)
        return self.catalog.link(node.relation, tuple(own), parent.relation, tuple(far))

    # which children are needed
    def _mark(self, node: Node) -> None:
        r = node.request
        exprs = [o.expr for o in r.order_by] + list(r.distinct_on)
        exprs += [r.where] if r.where is not None else []
        if node.embedded or r.distinct:
            exprs.append(r.select)
        if r.distinct_on and r.order_by and not r.distinct:
            lead = [o.expr for o in r.order_by[: len(r.distinct_on)]]
            if any(x not in r.distinct_on for x in lead):
                raise invalid("order_by must begin with the terms of distinct_on")
        for e in exprs:
            self._refs(node, e)
        for child in node.children.values():
            for a in (child.request.arguments or {}).values() if isinstance(child.request.arguments, dict) else child.request.arguments or []:
                self._refs(node, a)
        for alias, child in node.children.items():
            if alias in node.used or alias in node.aggregates:
                self._mark(child)

    def _refs(self, node: Node, e: Expr) -> None:
        if e.op == "agg":
            alias = self.target(node, e)
            todo = node.aggregates.setdefault(alias, [])
            if e not in todo:
                todo.append(e)
            for x in (*e.args[2], *((e.args[3],) if e.args[3] is not None else ()), *(o[0] for o in e.args[5])):
                self._agg_refs(node.children[alias], alias, x)
            return
        if e.op == "." and isinstance(e.args[0], str):
            self._name(node, e.args[0], e.args[1:])
            return
        if e.op == "star":
            if e.args[0]:
                for alias, child in node.children.items():
                    if not child.implicit and alias not in e.args[1]:
                        self._name(node, alias, ())
            for _, x in e.args[2]:
                self._refs(node, x)
            return
        for a in e.args:
            for x in a if isinstance(a, tuple) else (a,):
                if isinstance(x, Expr):
                    self._refs(node, x)
                elif isinstance(x, tuple):
                    for y in x:
                        if isinstance(y, Expr):
                            self._refs(node, y)

    def _name(self, node: Node, name: str, hops: tuple[str, ...]) -> None:
        if name == node.request.alias and hops and name not in node.columns and name not in node.children:
            name, hops = hops[0], hops[1:]
        child = node.children.get(name)
        if child is None:
            return
        node.used.add(name)
        if not hops:
            child.embedded = True
        elif not child.to_one:
            raise invalid(f"{name} holds many rows: aggregate it")
        elif hops[0] in child.children:
            self._name(child, hops[0], hops[1:])
        elif hops[0] not in child.columns and child.request.select.op in ("object", "star"):
            for k, x in child.request.select.args if child.request.select.op == "object" else child.request.select.args[2]:
                if k == hops[0]:
                    self._refs(child, x)

    def _agg_refs(self, child: Node, alias: str, e: Expr) -> None:
        for x in e.walk():
            if x.op == "." and x.args[0] == alias and len(x.args) > 1:
                self._name(child, x.args[1], x.args[2:])

    def target(self, node: Node, e: Expr) -> str:
        for a in e.args[2]:
            for x in a.walk():
                if x.op == "." and isinstance(x.args[0], str) and x.args[0] in node.children:
                    if node.children[x.args[0]].to_one:
                        raise invalid(f"{x.args[0]} is one row: there is nothing to aggregate")
                    return x.args[0]
        raise invalid("agg takes fields of a joined relation of many rows")
