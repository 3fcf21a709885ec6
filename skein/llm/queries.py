"""All queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "vectors", "lines", "mixing", "quality", "html", "neardup", "substrings", "sharding", "language", "urls", "phrases", "alignment")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"skein.llm.{name}"), what)
    return out


def queries() -> dict:
    from corpus_pipeline import run

    return _gather("QUERIES") | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
