"""Named queries and, where SQL can express them, their DuckDB twins."""
