"""Registered queries over the given tables and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES, Query

_MODULES = (
    "text_queries",
    "split_queries",
    "rollout_queries",
    "token_queries",
    "latent_queries",
    "hook_queries",
)


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE_SQL)
