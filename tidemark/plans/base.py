"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.sources.adapter import AS_OF, Catalog, oracle_tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = f"timestamp'{AS_OF}'"
SINCE_30D = "2000-12-02 00:00:00"


def query(sql: str | None = None, ctes: str = ""):
    """Register a function of a Catalog under its name; sql may use the catalog's k_ tables and what ctes define over them."""

    def register(f: Callable[[Catalog], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {oracle_tables()}{', ' + ctes if ctes else ''} {sql}"
        return f

    return register


def even(x: str, digits: int) -> str:
    """DuckDB: rounded half to even, as a double."""
    return f"CAST(round_even({x}, {digits}) AS DOUBLE)"
