"""Independent DuckDB statements for every registered query."""

from oracle.statements import statements

__all__ = ["statements"]
