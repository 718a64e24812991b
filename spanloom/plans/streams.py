"""The streaming census over a batch of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapters import table
from ..streaming.census import stream_census
from .registry import query


@query("STR-01", "select cast(date_trunc('day', ts) as date)::varchar as day, event_type as family, count(distinct event_id)::bigint as n from events group by 1, 2")
def _(spark, d):
    out = stream_census(table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "family", "n")
