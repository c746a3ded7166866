"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_filter", "quality", "secrets", "pii", "jaccard", "toxicity", "packing", "decontaminate", "token_counts", "chat")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    _mod = import_module(f"sparkwarden.llm.{_m}")
    QUERIES |= _mod.QUERIES
    ORACLE_SQL |= _mod.ORACLE_SQL
