"""The registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from textloom.plans import content, files, more, state


def queries() -> dict:
    return {**content.QUERIES, **state.QUERIES, **files.QUERIES, **more.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**content.SQL, **state.SQL, **files.SQL, **more.SQL}
