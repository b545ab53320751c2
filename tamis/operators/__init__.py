"""Operators on tables: validation, splitting, profiling, schema contracts."""
