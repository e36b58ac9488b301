"""Every query of the engine's core, with its SQL twin where SQL can say it."""

from __future__ import annotations

from . import reference


def queries() -> dict:
    return dict(reference.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(reference.SQL)
