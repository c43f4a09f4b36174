"""Queries: streaming maintenance over the event log."""

from __future__ import annotations

from graphloom.plans.registry import query
from graphloom.streaming import rollups as r


@query("stream_daily_completed", """WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS w FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, w GROUP BY ALL HAVING max(ts::DATE)::TIMESTAMP + INTERVAL 1 DAY <= any_value(w)""")
def _(s, d):
    return r.daily_completed(r.event_stream(s, f"{d}/events.parquet"))


@query("stream_totals", "SELECT user_id, count(*)::BIGINT AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1")
def _(s, d):
    return r.totals(r.event_stream(s, f"{d}/events.parquet"))


@query("stream_sessions", None)
def _(s, d):
    return r.sessions(r.event_stream(s, f"{d}/events.parquet"))
