"""Operators over whole tables: `op(df, *, columns and parameters) -> DataFrame`."""
