"""Live capture of queries."""
