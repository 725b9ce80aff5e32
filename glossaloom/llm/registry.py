"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "pii", "langid", "kdtree", "records", "decontam", "html_blocks", "spans", "warc", "simhash", "fim", "repair", "coordinates")


def _merged(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"glossaloom.llm.{module}"), name)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
