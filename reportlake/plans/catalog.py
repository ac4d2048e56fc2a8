"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from .views import duck

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, with its DuckDB twin if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = duck(sql)
        return f

    return add


from . import control_plans, heading_plans, mapping_plans, more_plans, org_plans, score_plans, source_plans, stream_plans, text_plans  # noqa: E402, F401
