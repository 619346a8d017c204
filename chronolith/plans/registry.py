"""Named queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "asof_prev_view"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under a name; ``sql`` is its equivalent for the driver's oracle."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from . import aggregates, composites, decisions, diagnostics, features, folds, incremental, joins, models, opponents, pages, records, scalars, sets, stores, streams, validation, windows  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
