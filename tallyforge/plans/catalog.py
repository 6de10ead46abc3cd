"""All queries of the library and their SQL."""

from __future__ import annotations

from . import analytics, episodes, grades, registry, reports, rescoring, stored, streams, texts  # noqa: F401  (importing a module registers its queries)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
