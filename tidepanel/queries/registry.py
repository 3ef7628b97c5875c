"""All registered queries and their SQL by name."""

from __future__ import annotations

from ..plans.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query (spark, sf_dir) and, if SQL can express it, its oracle over the named views."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return add


from . import features, ingest, joins, evaluation, outcomes, serving  # noqa: E402, F401
