"""Registered queries: a name, a function of (spark, sf_dir), and its SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def register(function):
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return register


def merged(*registries: Registry) -> Registry:
    whole = Registry()
    for part in registries:
        for name, function in part.queries.items():
            whole.add(name, part.sql.get(name))(function)
    return whole
