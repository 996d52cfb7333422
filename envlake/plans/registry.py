"""Every registered query, by SURVEY §2 key."""

from __future__ import annotations

import functools

from envlake.session import apply_pinned_conf


def _pinned(fn):
    """Run a query with envlake's session settings (UTC, AQE) on any caller's session."""
    @functools.wraps(fn)
    def run(spark, sf_dir):
        apply_pinned_conf(spark)
        return fn(spark, sf_dir.rstrip("/"))
    return run


def all_queries() -> dict:
    from envlake.plans import (health_queries, lake_queries, readings_queries, stream_queries,
                               sync_queries)
    q = {}
    for m in (readings_queries, health_queries, sync_queries, lake_queries, stream_queries):
        q.update(m.QUERIES)
    return {k: _pinned(v) for k, v in q.items()}
