"""A query and its SQL twin are registered together, so that neither drifts from the other."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]  # the operators of the survey that it exercises
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, *rows: str, sql: str | None = None):
    """Register the decorated callable under `name`."""

    def add(run):
        if name in _QUERIES and _QUERIES[name].run.__module__ != run.__module__:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, rows, run, sql)
        return run

    return add


def registered(name: str) -> Query:
    """A query that another builds on; its module has been imported."""
    return _QUERIES[name]


def load_core() -> dict[str, Query]:
    """Every core query; importing a module of this folder registers its queries."""
    import tarnwick.queries as folder

    for module in sorted(m.name for m in pkgutil.iter_modules(folder.__path__)):
        if not module.startswith("registry"):
            importlib.import_module(f"{folder.__name__}.{module}")
    return dict(_QUERIES)
