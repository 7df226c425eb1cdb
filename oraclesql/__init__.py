"""DuckDB oracle texts for the registered queries (correctness gate)."""
from oraclesql.ctes import CTES, with_ctes  # noqa: F401
