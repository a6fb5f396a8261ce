"""Control flow of experiments: sequences, grids with early stops, runs by group, and their context."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .. import errors
from ..frame import RoleFrame

SPACES = ("variables", "additional_fields", "analysis_tables", "groups")


@dataclass(frozen=True)
class Context:
    """A frame and what operators found out about it. Writing returns a new context."""

    frame: RoleFrame
    variables: Mapping[str, Any] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def set_value(self, space: str, name: str, value: Any, **options) -> Context:
        if space == "variables":
            return replace(self, variables={**self.variables, name: value})
        if space == "analysis_tables":
            return replace(self, tables={**self.tables, name: value})
        if space == "additional_fields":
            return replace(self, frame=self.frame.add_column(value, name, **options))
        raise errors.SpaceError(f"{space!r}; one of {SPACES}")

    def has(self, space: str, name: str) -> bool:
        held = {"variables": self.variables, "analysis_tables": self.tables, "additional_fields": self.frame.roles}
        if space not in held:
            raise errors.SpaceError(f"{space!r}; one of {SPACES}")
        return name in held[space]

    def ids(self, prefix: str) -> list[str]:
        """Names of tables and variables that start with an operator's name."""
        return [n for n in (*self.tables, *self.variables) if n.split("/")[0] == prefix]

    def one_id(self, prefix: str) -> str:
        found = self.ids(prefix)
        if not found:
            raise errors.NotFoundInContextError(prefix)
        return found[0]

    def field_search(self, roles, types: Iterable[type] | None = None) -> list[str]:
        return self.frame.search_columns(roles, types)

    def field_data_search(self, roles, types: Iterable[type] | None = None) -> RoleFrame:
        return self.frame.select(self.field_search(roles, types))

    def copy(self, frame: RoleFrame | None = None) -> Context:
        return replace(self, frame=frame or self.frame)


Executor = Callable[[Context], Context]


def sequence(*steps: Executor) -> Executor:
    def run(context: Context) -> Context:
        for step in steps:
            context = step(context)
        return context

    return run


def transform(step: Callable[[RoleFrame], RoleFrame]) -> Executor:
    return lambda c: c.copy(step(c.frame))


def tabulate(name: str, make: Callable[[Context], DataFrame]) -> Executor:
    return lambda c: c.set_value("analysis_tables", name, make(c))


def on_role(roles, make: Callable[[Context, list[str]], DataFrame], name: str, types: Iterable[type] | None = None) -> Executor:
    """One computation over all columns of a role at once."""

    def run(context: Context) -> Context:
        columns = context.field_search(roles, types)
        if not columns:
            raise errors.NoColumnsError(f"no column with role {roles}")
        return context.set_value("analysis_tables", name, make(context, columns))

    return run


def when(condition: Callable[[Context], bool], then: Executor, otherwise: Executor | None = None) -> Executor:
    return lambda c: then(c) if condition(c) else otherwise(c) if otherwise else c


def grid(parameters: Mapping[str, Iterable]) -> list[dict[str, Any]]:
    """All combinations, the last name varying fastest."""
    names = list(parameters)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*(list(parameters[n]) for n in names))]


def over_grid(parameters: Mapping[str, Iterable], run: Callable[[dict], Any], stop: Callable[[Any], bool] | None = None) -> list[tuple[dict, Any]]:
    """run(combination) for each, until ``stop`` accepts a result."""
    out = []
    for combination in grid(parameters):
        out.append((combination, run(combination)))
        if stop is not None and stop(out[-1][1]):
            break
    return out


def repeated(n: int, run: Callable[[int], Any]) -> list[Any]:
    return [run(i) for i in range(n)]


def by_group(frame: RoleFrame, column: str, run: Callable[[RoleFrame], Any]) -> dict[Any, Any]:
    """run for the rows of each group value; prefer another grouping key in an aggregate where there is one."""
    return {key: run(part) for key, part in frame.groupby(column)}
