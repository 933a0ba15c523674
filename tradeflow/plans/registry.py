"""Named queries: a Spark builder plus, where SQL can say the same, a DuckDB oracle.

``register(name, oracle=...)`` decorates ``fn(spark, sf_dir) -> DataFrame``.
The oracle is plain SQL over the driver's tables (registered as views), with
fixture views from :mod:`tradeflow.plans.fixtures` prepended as CTEs.
Every computed column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    ids: tuple[str, ...]
    bench: bool


QUERIES: dict[str, Query] = {}


def register(name: str, ids: tuple[str, ...] | str = (), oracle: str | Callable[[], str] | None = None,
             bench: bool = False):
    """Register ``fn`` under ``name``; ``ids`` are the SURVEY operator IDs it covers."""
    if isinstance(ids, str):
        ids = tuple(i.strip() for i in ids.split(",") if i.strip())

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        sql = oracle() if callable(oracle) else oracle
        QUERIES[name] = Query(name, fn, sql, tuple(ids), bench)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens at import)."""
    import importlib
    import pkgutil

    import tradeflow.plans as plans
    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
        importlib.import_module(f"tradeflow.plans.{mod}")
    return QUERIES
