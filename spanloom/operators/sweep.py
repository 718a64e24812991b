"""Sweeps over interval tables: merging, coverage and maximal runs, as windows over sorted edges.

Contigs are swept in stretches of ``STRETCH`` positions: a window per stretch, and one over the stretches' summaries that
carries the total, the reach or the last value into the next.  Rows are summed up per position first, so a task's sort holds
at most ``STRETCH`` rows of one contig, and at most (length / ``STRETCH``) summaries of it, however many intervals there are.
Positions are whole numbers.  Where groups are small by nature, as the pieces of a member, ``stretch=None`` sorts each whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 1 << 16


def _latest(column: str) -> Column:
    return F.last(column, ignorenulls=True)


#: What is carried: how a window gathers it, how a stretch is summed up, and how the carried and the stretch's own combine.
CARRIED = {
    "sum": (F.sum, lambda v, x: F.sum(v), lambda before, own: F.coalesce(before + own, own, before)),
    "max": (F.max, lambda v, x: F.max(v), lambda before, own: F.greatest(before, own)),
    "last": (_latest, lambda v, x: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(x))), lambda before, own: F.coalesce(own, before)),
    "next": (_latest, lambda v, x: F.min_by(v, F.when(F.col(v).isNotNull(), F.col(x))), lambda before, own: F.coalesce(own, before)),
}


def running(rows: DataFrame, groups: Sequence[str], x: str, value: str, how: str, name: str, own: bool = True, stretch: int | None = STRETCH) -> DataFrame:
    """``rows`` with ``name``: the sum, max or last non-null ``value`` of a group's rows up to each row (or before it, unless ``own``).

    ``next`` looks ahead instead, to the nearest non-null value from a row on.  Positions ``x`` have to be distinct in a group.
    """
    gather, summary, combine = CARRIED[how]
    order = F.col(x).desc() if how == "next" else F.col(x)
    stop = 0 if own else -1
    if stretch is None:
        return rows.withColumn(name, gather(value).over(W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, stop)))
    cut = rows.withColumn("_stretch", F.floor(F.col(x) / stretch))
    inside = cut.withColumn(name, gather(value).over(W.partitionBy(*groups, "_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, stop)))
    along = W.partitionBy(*groups).orderBy(F.col("_stretch").desc() if how == "next" else F.col("_stretch")).rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(*groups, "_stretch").agg(summary(value, x).alias("_sum"))
    carried = sums.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_stretch").alias("_at"), gather("_sum").over(along).alias("_carried"))
    met = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] + [F.col("_stretch") == F.col("_at")]
    joined = inside.join(carried.where("_carried is not null"), met, "left").withColumn(name, combine(F.col("_carried"), F.col(name)))
    return joined.select(*rows.columns, name)


def merge(rows: DataFrame, *group: str, stretch: int | None = STRETCH) -> DataFrame:
    """Union of each group's intervals; touching ones become one.  Columns: group, s, e."""
    longest = rows.groupBy(*group, "s").agg(F.max("e").alias("e"))
    reached = running(longest, group, "s", "e", "max", "_reach", own=False, stretch=stretch)
    marked = reached.withColumn("_fresh", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0))
    island = running(marked, group, "s", "_fresh", "sum", "_island", stretch=stretch)
    return island.groupBy(*group, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def coverage(rows: DataFrame, group: str, member: str, merged: bool = False, stretch: int | None = STRETCH) -> DataFrame:
    """Depth from each edge on, in distinct members: a member counts once over its span, or over its merged pieces."""
    own = merge(rows, group, member, stretch=None) if merged else rows.groupBy(group, member).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    edges = own.select(group, F.explode(F.array(F.struct(F.col("s").alias("x"), F.lit(1).alias("d")), F.struct(F.col("e").alias("x"), F.lit(-1).alias("d")))).alias("_e"))
    steps = edges.groupBy(group, F.col("_e.x").alias("x")).agg(F.sum("_e.d").alias("d"))
    return running(steps, [group], "x", "d", "sum", "depth", stretch=stretch).select(group, "x", "depth")


def runs(covered: DataFrame, group: str, need: str | int, stretch: int | None = STRETCH) -> DataFrame:
    """Maximal stretches with depth of ``need`` or more, from ``coverage`` rows.  Columns: group, s, e."""
    enough = F.col("depth") >= (F.col(need) if isinstance(need, str) else F.lit(need))
    marked = covered.select(group, "x", F.coalesce(enough, F.lit(False)).alias("_ok"))
    before = running(marked, [group], "x", "_ok", "last", "_before", own=False, stretch=stretch)
    # a run lasts from where the depth becomes enough to where it no longer is, or to the group's last edge
    turns = before.where(F.col("_ok") != F.coalesce("_before", F.lit(False))).withColumn("_off", F.when(~F.col("_ok"), F.col("x")))
    ends = running(turns, [group], "x", "_off", "next", "_end", stretch=stretch).where("_ok")
    last = covered.groupBy(F.col(group).alias("_group")).agg(F.max("x").alias("_last"))
    closed = ends.join(last, F.col(group).eqNullSafe(F.col("_group")))
    return closed.select(group, F.col("x").alias("s"), F.coalesce("_end", "_last").alias("e")).where("s < e")
