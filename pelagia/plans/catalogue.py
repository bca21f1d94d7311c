"""Registered queries of the gridded-field operators, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pelagia.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A tracer on the field's grid: still water on land, a concentration from the cell's place.
VIEWS = views.DUCK | {
    "v_tracer": "SELECT time_idx, depth_idx, j, i, lat, lon, COALESCE(water_u, 0e0) AS water_u, COALESCE(water_v, 0e0) AS water_v, "
    "CAST((i * 7 + j * 13 + time_idx * 5) % 101 AS DOUBLE) / 100e0 AS c FROM v_field"
}
NEEDS = {"v_tracer": "v_field"}


def r(sql: str, digits: int = 6) -> str:
    """SQL that rounds as schema.rounded() does."""
    return f"round({sql}, {digits}) + 0e0"


def with_views(sql: str, *names: str) -> str:
    """sql (a SELECT, or further CTEs and a SELECT) behind the definitions of the named views."""
    if not names:
        return sql
    ordered = [*dict.fromkeys(n for name in names for n in ([NEEDS[name], name] if name in NEEDS else [name]))]
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    return f"{head} {sql}" if sql.lstrip().upper().startswith("SELECT") else f"{head}, {sql}"


def query(sql: str | None = None, *names: str) -> Callable:
    """Register a function under its name, with the SQL of its rows if there is one."""

    def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *names)
        return f

    return registered


def load() -> None:
    """Import the modules that register queries."""
    from pelagia.plans import field_queries, function_queries, further_queries, later_queries, model_queries, more_queries, scalar_queries, series_queries  # noqa: F401


load()
