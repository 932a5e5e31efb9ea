"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fovea.runtime import rounded

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    survey_id: str
    run: QueryFn
    body: str | None
    needs: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        return None if self.body is None else with_views(self.body, *self.needs)


CATALOG: dict[str, Query] = {}
_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    """Register a named subquery for the reference SQL."""
    _VIEWS[name] = (sql, needs)


def _ordered(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _ordered(_VIEWS[name][1], done)
            done.append(name)
    return done


def with_views(body: str, *needs: str) -> str:
    parts = [f"{n} AS ({_VIEWS[n][0]})" for n in _ordered(needs, [])]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(name: str, survey_id: str, sql: str | None = None, needs: str = "", doubles: str = ""):
    """Register a query. ``doubles`` names the SQL columns compared at six decimals."""

    def register(fn: QueryFn) -> QueryFn:
        body = sql
        if sql is not None and doubles:
            cols = ", ".join(f'round(CAST("{c}" AS DOUBLE) + 1e-10, 6) + 0.0 AS "{c}"' for c in doubles.split())
            body = f"SELECT * REPLACE ({cols}) FROM ({sql})"
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        CATALOG[name] = Query(name, survey_id, run, body, tuple(needs.split()))
        return fn

    return register
