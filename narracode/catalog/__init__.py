"""Named queries over the given tables, with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from narracode.catalog.registry import ORACLES, QUERIES, Query

MODULES = ["sources", "labels", "metrics", "losses", "windows", "scalars", "answers", "features", "models"]


def _load() -> None:
    for name in MODULES:
        import_module(f"narracode.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
