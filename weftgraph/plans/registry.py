"""The register of queries and of their SQL, and the pieces that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_HOST = "nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(trim({u}), '^[A-Za-z][A-Za-z0-9+.\\-]*:(//)?|^//', ''), '^([^/?#\\\\]*)', 1), '^.*@', '')), ':\\d*$', ''), '^www\\.', ''), '')"
_PATH = "regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def quoted(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def host_sql(u: str) -> str:
    return _HOST.replace("{u}", u)


def path_sql(u: str) -> str:
    return _PATH.replace("{u}", u)
