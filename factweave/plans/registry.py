"""All registered queries of the library, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.sources.views import Views, with_views

MODULES = ("filters", "texts", "counts", "search", "graphs", "writes", "mining", "access", "live", "flows")

_found: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function from views to a DataFrame; ``sql`` is what a plain engine would run for the same rows."""

    def keep(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _found:
            raise ValueError(f"{name} is registered twice")
        _found[name] = f, with_views(sql, extra) if sql else None
        return f

    return keep


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"factweave.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _found.items() if sql}
