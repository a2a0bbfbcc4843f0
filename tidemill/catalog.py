"""Every query of the engine and its DuckDB oracle, by name."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and, if SQL can say it, its oracle."""

    def wrap(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return wrap


def _load() -> None:
    from tidemill import queries as package

    for m in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{m.name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark, sf_dir: str):
    """Candles, feature packs, a fixed logistic model, and its graded decisions."""
    return queries()["flow_compile"](spark, sf_dir)
