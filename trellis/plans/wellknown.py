"""Named queries with declared parameters."""

from __future__ import annotations

import json
import logging
from decimal import Decimal
from pathlib import Path
from typing import Any

from ..errors import QueryError
from . import syntax

log = logging.getLogger(__name__)
NUMBERS = frozenset("int2 int4 int8 smallint int integer bigint float4 float8 real float numeric decimal".split()) | {"double precision"}
TEXTS = frozenset("text varchar char bpchar name uuid date timestamp timestamptz time timetz interval".split()) | {"character varying"}


class WellKnown:
    """Queries by name. Of a name declared twice none is active, nor is a query that does not parse,
    leaves a parameter unused or uses one that is not declared."""

    def __init__(self, declared: list[dict]):
        self.queries: dict[str, tuple[syntax.Request, dict[str, dict]]] = {}
        self.problems: dict[str, QueryError] = {}
        names: set[str] = set()
        for d in declared:
            name = d.get("name", "")
            try:
                if name in names:
                    raise QueryError("WELL_KNOWN_DUPLICATE_NAME", f"{name} is declared twice")
                request, params = syntax.request(d.get("query")), d.get("params") or {}
                used = _params(request)
                if lost := set(params) - used:
                    raise QueryError("WELL_KNOWN_UNUSED_PARAM", f"{name} does not use {sorted(lost)}")
                if lost := used - set(params):
                    raise QueryError("WELL_KNOWN_UNKNOWN_PARAM", f"{name} does not declare {sorted(lost)}")
                self.queries[name] = request, params
            except QueryError as e:
                log.warning("well-known query %s is not active: %s", name, e)
                self.problems[name] = e
                self.queries.pop(name, None)
            names.add(name)

    @classmethod
    def read(cls, folders: str) -> WellKnown:
        """Every .json (and, with a YAML library, .yml and .yaml) file under ``:``-separated folders."""
        found: list[dict] = []
        for folder in filter(None, folders.split(":")):
            for p in sorted(Path(folder).rglob("*")):
                if p.name.startswith("_") or p.suffix not in (".json", ".yml", ".yaml"):
                    continue
                try:
                    if p.suffix == ".json":
                        got = json.loads(p.read_text())
                    else:
                        import yaml  # optional

                        got = yaml.safe_load(p.read_text())
                    found += got if isinstance(got, list) else [got]
                except (ValueError, ImportError) as e:
                    log.warning("%s is not read: %s", p, e)
        return cls(found)

    def bind(self, name: str, given: dict[str, Any]) -> tuple[syntax.Request, dict[str, Any]]:
        if name not in self.queries:
            raise QueryError("WELL_KNOWN_UNKNOWN_QUERY", f"no well-known query {name}")
        request, params = self.queries[name]
        out = {}
        for p, declared in params.items():
            if p in given:
                _check(p, str(declared.get("type", "")).lower(), given[p])
                out[p] = given[p]
            elif "default" in declared:
                out[p] = declared["default"]
            else:
                raise QueryError("WELL_KNOWN_PARAM_REQUIRED", f"{name} needs {p}")
        return request, out


def _check(name: str, kind: str, value: Any) -> None:
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    wrong = value is not None and (
        (kind in NUMBERS and not number) or (kind in TEXTS and not isinstance(value, str)) or (kind in ("bool", "boolean") and not isinstance(value, bool))
        or (kind.endswith("[]") and not isinstance(value, list)))
    if wrong:
        raise QueryError("WELL_KNOWN_PARAM_TYPE_MISMATCH", f"{name} is a {kind}")


def _params(r: syntax.Request) -> set[str]:
    args = list(r.arguments.values()) if isinstance(r.arguments, dict) else r.arguments or []
    exprs = [r.select, *args, *r.distinct_on, *(o.expr for o in r.order_by), *([r.where] if r.where is not None else [])]
    out = {x.args[0] for e in exprs for x in _deep(e) if x.op == "$param"}
    for child in r.join.values():
        out |= _params(child)
    return out


def _deep(e: Any):
    if isinstance(e, syntax.Expr):
        yield e
        for a in e.args:
            yield from _deep(a)
    elif isinstance(e, tuple):
        for a in e:
            yield from _deep(a)
