"""Column functions: SQL text, table names, index matching."""
