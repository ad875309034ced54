"""The register of queries: each binds an operator to the views and carries the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vantage.sources.views import Views, oracle

#: The horizon that queries read at, and an earlier one.
H, EARLIER = 40, 29

CATALOG: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register ``f(views)`` under ``key``; ``sql`` may use the views and ``$h`` for the horizon."""

    def keep(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if key in CATALOG:
            raise ValueError(f"{key} is registered twice")
        CATALOG[key] = (f, oracle(sql.replace("$h", str(H))) if sql else None)
        return f

    return keep
