"""Registered queries: library calls over the given tables, with SQL twins."""
