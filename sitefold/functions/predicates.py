"""Predicates as data: each builder returns a Column, and ``from_json`` reads a serialised tree.

A comparison with null is null, as in SQL, so a filter drops the row for ``neq`` too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_ as _and
from operator import or_ as _or
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(name: str, value: Any) -> Column:
    return F.col(name) == F.lit(value)


def neq(name: str, value: Any) -> Column:
    return F.col(name) != F.lit(value)


def gte(name: str, value: Any) -> Column:
    return F.col(name) >= F.lit(value)


def lte(name: str, value: Any) -> Column:
    return F.col(name) <= F.lit(value)


def start_with(name: str, value: str) -> Column:
    """Literal prefix; Catalyst pushes it to the scan."""
    return F.col(name).startswith(value)


def json_eq(name: str, key: str, value: str) -> Column:
    return F.col(name)[key] == F.lit(value)


def json_neq(name: str, key: str, value: str) -> Column:
    return F.col(name)[key] != F.lit(value)


def _array(values: Sequence[Any]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def contains(name: str, values: Sequence[Any]) -> Column:
    """The array holds all values."""
    return F.size(F.array_except(_array(values), F.col(name))) == 0


def contained(name: str, values: Sequence[Any]) -> Column:
    """All elements of the array are among the values."""
    return F.size(F.array_except(F.col(name), _array(values))) == 0


def any_of(name: str, values: Sequence[Any]) -> Column:
    """Each value is a member of the array."""
    return reduce(_and, (F.array_contains(name, v) for v in values))


def is_in(name: str, values: Sequence[Any]) -> Column:
    return F.col(name).isin(*values)


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(_and, parts) if parts else F.lit(True)


def one_of(parts: Sequence[Column]) -> Column:
    return reduce(_or, parts) if parts else F.lit(True)


def none_of_all(parts: Sequence[Column]) -> Column:
    """Not all of the parts."""
    return ~all_of(parts)


_ONE = {"EQ": eq, "NEQ": neq, "GTE": gte, "LTE": lte, "START_WITH": start_with}
_MANY = {"CONTAINS": contains, "CONTAINED": contained, "ANY": any_of, "IN": is_in}
_JOINED = {"AND": all_of, "OR": one_of, "NOT": none_of_all}


def from_json(tree: dict[str, Any]) -> Column:
    """A tree with ``query``, ``fieldName`` and ``svalue``/``ovalue``/``avalues``/``valueCollection``, or with
    ``conjunction`` and ``restQueries``. Conjunctions nest. An empty tree is true. For the two JSON
    comparisons ``avalues`` is key and value."""
    if name := tree.get("query"):
        field_name = tree["fieldName"]
        if name in _ONE:
            return _ONE[name](field_name, tree["svalue"] if "svalue" in tree else tree["ovalue"])
        values = tree.get("avalues") or tree.get("valueCollection") or ()
        if name in ("JSON_EQ", "JSON_NEQ"):
            return (json_eq if name == "JSON_EQ" else json_neq)(field_name, *values)
        if name in _MANY:
            return _MANY[name](field_name, values)
        raise ValueError(f"unknown query {name}")
    if name := tree.get("conjunction"):
        if name not in _JOINED:
            raise ValueError(f"unknown conjunction {name}")
        return _JOINED[name]([from_json(x) for x in tree["restQueries"]])
    return F.lit(True)


@dataclass
class ObjectFilter:
    """Nine optional parts, all to hold, all bounds inclusive; an empty or zero part is left out."""

    name_prefix: str = ""
    statuses: Sequence[str] = ()
    creation_before: datetime | None = None
    creation_after: datetime | None = None
    expires_before: datetime | None = None
    expires_after: datetime | None = None
    size_less: int = 0
    size_greater: int = 0
    metadata: dict[str, str] = field(default_factory=dict)

    def _dates(self):
        for name, value, build in (("creation", self.creation_before, lte), ("creation", self.creation_after, gte), ("expires", self.expires_before, lte), ("expires", self.expires_after, gte)):
            if value is not None:
                yield name, build(name, value)

    def _rest(self) -> list[Column]:
        parts = [start_with("name", self.name_prefix)] if self.name_prefix else []
        parts += [lte("size", self.size_less)] if self.size_less else []
        parts += [gte("size", self.size_greater)] if self.size_greater else []
        return parts + [json_eq("metadata", k, v) for k, v in self.metadata.items()]

    def on_catalog(self) -> Column:
        """A null date fails its bound."""
        statuses = [is_in("status", self.statuses)] if self.statuses else []
        return all_of(self._rest() + statuses + [c for _, c in self._dates()])

    def on_storage(self) -> Column:
        """The listing has no status, and a null date passes its bound."""
        return all_of(self._rest() + [F.col(name).isNull() | c for name, c in self._dates()])
