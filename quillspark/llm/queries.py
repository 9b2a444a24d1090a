"""The queries of this subpackage and their SQL, gathered from the operators' modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lm", "langid", "quality", "warc", "jaccard", "pii", "licences", "decontaminate", "tokens", "mixing", "chat", "whitening", "align")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
