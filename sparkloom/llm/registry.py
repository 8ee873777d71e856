"""All queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import importlib

MODULES = ("tokens", "mixing", "html", "decontaminate", "repeats", "licenses", "secrets", "media", "toxicity", "similarity")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{name}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE_SQL")
