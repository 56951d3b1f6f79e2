"""Name -> query and name -> DuckDB SQL of the risk analytics."""

from tidemark.plans import accounts, entries, graphs, monitors, profiles, relational, scores, stores  # noqa: F401  each registers its queries
from tidemark.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
