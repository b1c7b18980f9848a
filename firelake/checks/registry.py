"""All registered queries."""

from __future__ import annotations

from firelake.checks import aggregates, functions, joins, models, rows, sources, streams
from firelake.checks.query import Query


def registered() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in (rows, functions, joins, aggregates, models, sources, streams):
        for name, query in module.queries().items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found
