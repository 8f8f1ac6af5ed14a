"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("core", "multi", "inference", "canonical", "codebooks", "delivery")

QUERIES, SQL = {}, {}

for _name in MODULES:
    _module = import_module(f"study_queries.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
