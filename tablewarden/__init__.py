"""Database evidence analytics on Spark: see README.md."""
