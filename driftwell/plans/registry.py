"""All queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.plans import panel_queries, regime_queries, stat_queries, universe_queries

MODULES = (panel_queries, stat_queries, regime_queries, universe_queries)


def _dated(f):
    """Dates leave as text, which both engines write alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: df[c].cast("string") for c, t in df.dtypes if t == "date"})

    return run


def _dated_sql(sql: str, dates: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_queries.efficiency_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _dated(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _dated_sql(sql, m.DATES.get(name, ())) for m in MODULES for name, sql in m.SQL.items()}
