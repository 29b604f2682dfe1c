"""Queries over the driver's tables, by name, and the same in DuckDB SQL."""

from .queries import QUERIES, SQL
from . import composed  # noqa: F401  registers its queries
