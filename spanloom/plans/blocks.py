"""The block caller and the triage of its output, end to end on the interval adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..sources.adapters import intervals
from .registry import query


def _segments(spark, d):
    iv = intervals(spark, d)
    base = F.lit(9100)
    seg = iv.select(F.col("grp").alias("clade"), "member", (F.col("s") - base).alias("rs"), (F.col("e") - base).alias("re"), (F.col("s") - base + 3).alias("ms"), (F.col("e") - base + 3).alias("me"), F.when(F.col("piece") % 2 == 0, "-").otherwise("+").alias("strand"))
    return seg, seg.groupBy("clade").agg(F.countDistinct("member").alias("n"))


@query("A1-blocks")
def _(spark, d):
    """Segments to scored blocks, with a recurrence that the sparse order intervals can reach."""
    segments, windows = _segments(spark, d)
    return B.call_blocks(segments, windows, least_recurrence=0.02, least_members=3, least_len=5, bin_size=1024)[0].withColumn("composite", F.round("composite", 4))


@query("A1-block-members")
def _(spark, d):
    segments, windows = _segments(spark, d)
    return B.call_blocks(segments, windows, least_recurrence=0.02, least_members=3, least_len=5, bin_size=1024)[1]
