"""Plain-SQL statements of every registered query, for comparison in DuckDB."""
