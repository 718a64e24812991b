"""Joins beyond plain equality.  Range joins cut the axis into bins and join on (group, bin), so they stay hash joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sweep import STRETCH, running


def near(anchors: DataFrame, others: DataFrame, group: str, pos: str, reach: int) -> DataFrame:
    """All (anchor, other) rows of a group with positions at most ``reach`` apart.

    Columns of ``others`` get the prefix ``o_``.  An anchor goes to the three bins of width ``reach`` about it, the other
    side to one, so each pair meets once.
    """
    a = anchors.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(pos) / reach) - 1, F.floor(F.col(pos) / reach) + 1)))
    o = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns]).withColumn("_obin", F.floor(F.col(f"o_{pos}") / reach))
    met = a.join(o, (F.col(group) == F.col(f"o_{group}")) & (F.col("_bin") == F.col("_obin")))
    return met.where(F.abs(F.col(pos) - F.col(f"o_{pos}")) <= reach).drop("_bin", "_obin")


def overlapping(left: DataFrame, right: DataFrame, group: str, bin_size: int, slack: int = 0) -> DataFrame:
    """All pairs of half-open intervals (s, e) of a group that overlap by a base, after growing the right by ``slack``.

    Columns of ``right`` get the prefix ``r_``.  Both sides are cut into bins; a pair is kept only in the bin where the
    later of the two starts, so it appears once.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / bin_size), F.floor((e - 1) / bin_size)))
    a = left.withColumn("_bin", bins(F.col("s"), F.col("e")))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("_rs", F.col("r_s") - slack).withColumn("_re", F.col("r_e") + slack).withColumn("_rbin", bins(F.col("_rs"), F.col("_re")))
    met = a.join(r, (F.col(group) == F.col(f"r_{group}")) & (F.col("_bin") == F.col("_rbin")))
    first = F.floor(F.greatest("s", "_rs") / bin_size)
    met = met.where((F.col("s") < F.col("_re")) & (F.col("_rs") < F.col("e")) & (F.col("_bin") == first))
    return met.withColumn("overlap", F.least("e", "_re") - F.greatest("s", "_rs")).drop("_bin", "_rbin", "_rs", "_re")


def nearest_sides(points: DataFrame, others: DataFrame, group: str, pos: str, key: str, stretch: int | None = STRETCH) -> DataFrame:
    """As-of both ways: the greatest other position at or before a point and the least at or after it.

    Distinct positions are swept in stretches, so no task sorts a whole group; a point without a group or position has null.
    """
    spots = points.select(group, F.col(pos).alias("_x"), F.lit(None).cast("long").alias("_o")).union(others.select(group, F.col(pos), F.col(pos)))
    spots = spots.where(F.col(group).isNotNull() & F.col("_x").isNotNull()).groupBy(group, "_x").agg(F.max("_o").alias("_o"))
    swept = running(running(spots, [group], "_x", "_o", "last", "before", stretch=stretch), [group], "_x", "_o", "next", "after", stretch=stretch)
    wanted = points.select(group, F.col(key), F.col(pos).alias("_x"))
    return wanted.join(swept.drop("_o"), [group, "_x"], "left").select(group, key, F.col("_x").alias(pos), "before", "after")


def best_of(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:  # noqa: ANN002
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Bits of a packed number that hold the key; the value has those above, but for the sign.
KEY_BITS = 47


def greatest_of(rows: DataFrame, keys: Sequence[str], value: str, key: str) -> DataFrame:
    """keys, value, key: the greatest value of each group and the least key that has it; whole numbers, ``value`` not negative.

    Both are packed into one number, whose maximum is taken by hashing, so rows are neither sorted nor shuffled one by one;
    what does not fit a long is packed into a decimal.
    """
    v, k = F.col(value), F.col(key)
    low = F.lit(1 << KEY_BITS)
    fits = (v >= 0) & (v < 1 << (62 - KEY_BITS)) & (k >= 0) & (k < low)
    wide = F.lit("18446744073709551616").cast("decimal(20,0)")
    packed = F.max(F.when(fits, F.shiftleft(v.cast("long"), KEY_BITS) + (low - 1 - k))).alias("_p")
    other = F.max(F.when(~fits, (v.cast("decimal(17,0)") * wide - k.cast("decimal(20,0)")).cast("decimal(38,0)"))).alias("_w")
    best = rows.groupBy(*keys).agg(packed, other)
    near, far = F.shiftright("_p", KEY_BITS), F.floor((F.col("_w") + F.lit("9223372036854775807").cast("decimal(20,0)")) / wide).cast("long")
    k_near = low - 1 - F.col("_p").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    k_far = (far.cast("decimal(17,0)") * wide - F.col("_w")).cast("long")
    first = F.col("_w").isNull() | (near > far) | ((near == far) & (k_near < k_far))
    return best.select(*keys, F.when(first, near).otherwise(far).alias(value), F.when(first, k_near).otherwise(k_far).alias(key))


def provenance(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """Full outer join of two pair tables with the source of each pair."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    source = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), f"{left_name}_only").otherwise(f"{right_name}_only")
    return a.join(b, list(keys), "full_outer").withColumn("source", source).drop("_l", "_r")


def first_root(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the first table that has a key wins."""
    all_of = None
    for n, t in enumerate(tables):
        t = t.withColumn("_root", F.lit(n))
        all_of = t if all_of is None else all_of.unionByName(t)
    least = F.min("_root").over(W.partitionBy(key))
    return all_of.withColumn("_least", least).where("_root = _least").drop("_root", "_least")
