"""All queries of the library and their SQL."""

from __future__ import annotations

from . import dice, files, groups

_QUERIES = {**dice.QUERIES, **groups.QUERIES, **files.QUERIES}
_SQL = {**dice.SQL, **groups.SQL, **files.SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
