"""Column functions: `fn(columns) -> Column`, all inside Spark's expression engine."""
