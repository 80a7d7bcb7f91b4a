"""The registered queries: operators bound to the given tables, each with a DuckDB twin where SQL can express it."""
