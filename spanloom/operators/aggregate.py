"""Aggregations.  All of them are Spark aggregates with partial sums before the shuffle; order statistics are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import hit_status


def census(rows: DataFrame, family: str, distinct: dict[str, Column], flags: dict[str, Column], genomes: str) -> DataFrame:
    """Per family: rows, distinct counts, mean flags, and rows per distinct ``genomes``."""
    counts = [F.countDistinct(c).alias(f"n_{k}") for k, c in distinct.items()]
    shares = [F.avg(c.cast("double")).alias(f"frac_{k}") for k, c in flags.items()]
    out = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n_rows"), *counts, *shares)
    return out.withColumn("per_genome", F.col("n_rows") / F.col(f"n_{genomes}"))


def at_fractions(rows: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float], clamp: bool = True) -> DataFrame:
    """groups, and for each name the value at place floor(fraction · n) of the group's sorted values, 0-based.

    Equal values are counted first, with partial sums; places come from running counts over the distinct ones.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*groups)
    ranked = counted.withColumn("_upto", F.sum("_n").over(whole.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole))

    def at(fraction: float) -> Column:
        place = F.floor(F.lit(fraction) * F.col("_all"))
        place = F.least(F.col("_all") - 1, place) if clamp else place
        return F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col(value)))

    return ranked.groupBy(*groups).agg(*[at(f).alias(name) for name, f in fractions.items()], F.max(value).alias("most"))


def mad(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, median, mad: the median absolute deviation, 0 for a single value."""
    middle = rows.groupBy(group).agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))
    spread = rows.join(middle, group).groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("_mad"))
    return middle.join(spread, group).select(group, "median", F.when(F.col("n") < 2, 0.0).otherwise(F.col("_mad")).alias("mad"))


def modal(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least one on ties, and its count."""
    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), value)))
    return top.where("_rn = 1").drop("_rn")


def fdr_at_own_score(rows: DataFrame, family: str, score: str, decoy: Column, replicates: int) -> DataFrame:
    """For each real row: decoys at or above its score per replicate, over reals at or above it."""
    w = W.partitionBy(family).orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("n_decoy", F.sum(decoy.cast("long")).over(w)).withColumn("n_real", F.sum((~decoy).cast("long")).over(w))
    return out.where(~decoy).withColumn("fdr", F.col("n_decoy") / replicates / F.col("n_real"))


def grid(keys: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Every key with every mode: an explode of a short literal list, not a join."""
    return keys.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))


def null_strength(n_blocks: Column, has_null: Column) -> Column:
    """Absent, empty and clean nulls are different things."""
    return F.when(~has_null, "none").when(n_blocks.isNull(), "blockless").when(n_blocks == 0, "clean").otherwise("resolved")


def dominance(rows: DataFrame, group: str, flag: Column, least: float = 0.5) -> DataFrame:
    """group, n_first, call: rows with the flag, and whether more than this share of a group has it."""
    one = flag.cast("long")
    return rows.groupBy(group).agg(F.sum(one).alias("n_first"), F.when(F.avg(one) > least, "dominant").otherwise("mixed").alias("call"))


def neighbour_support(rows: DataFrame, anchor: str, group: str, near: Column, supported: float = 0.5, weak: float = 0.1) -> DataFrame:
    """group, support, band: the share of anchors that have such a neighbour near."""
    share = F.avg("_near")
    band = F.when(share >= supported, "supported").when(share >= weak, "weak").otherwise("absent")
    return rows.groupBy(anchor, group).agg(F.max(near.cast("int")).alias("_near")).groupBy(group).agg(share.alias("support"), band.alias("band"))


def ladder_choice(rungs: DataFrame, family: str, rung: str, n: str, median: str) -> DataFrame:
    """The rung with most clades, then the least median identity (missing or 0 counts as 1), then the first."""
    identity = F.coalesce(F.nullif(F.col(median), F.lit(0.0)), F.lit(1.0))
    return rungs.groupBy(family).agg(F.min_by(F.struct(rung, n), F.struct(-F.col(n), identity, rung)).alias("_r")).select(family, f"_r.{rung}", f"_r.{n}")


def sensitive_status(hits: DataFrame, bag: str, domain: str, evalue: str, curated: Column, gathering: float, lead: float) -> DataFrame:
    """bag, status, from the best e-value of each domain."""
    best = hits.groupBy(bag, domain).agg(F.min(evalue).alias("_e"))
    per = best.groupBy(bag).agg(F.min("_e").alias("_best"), F.min(F.when(curated, F.col("_e"))).alias("_curated"))
    return per.select(bag, hit_status(F.col("_curated"), F.col("_best"), gathering, lead).alias("status"))


def pool_summary(rows: DataFrame, target: str, source: str, member: str, most: float = 0.4) -> DataFrame:
    """target, sources, distinct_sum, max_source_fraction, pool: strong if no source gives more than this share."""
    per = rows.groupBy(target, source).agg(F.countDistinct(member).alias("_n"))
    share = F.max("_n") / F.sum("_n")
    return per.groupBy(target).agg(F.count(F.lit(1)).alias("sources"), F.sum("_n").alias("distinct_sum"), share.alias("max_source_fraction"), F.when(share <= most, "strong").otherwise("weak").alias("pool"))


def element_records(rows: DataFrame, bag: str, inserted: Column, noncoding: Column) -> DataFrame:
    """bag, inserted, noncoding, coding: medians, and what the non-coding one leaves of the inserted one."""
    a, b = F.median(inserted), F.median(noncoding)
    return rows.groupBy(bag).agg(a.alias("inserted"), b.alias("noncoding"), (a - F.coalesce(b, F.lit(0.0))).alias("coding"))


def element_geometry(rows: DataFrame, bag: str, up: Column, down: Column, inserted: Column, anchor: Column, slack: float, least: float = 0.15) -> DataFrame:
    """bag, accept_up, accept_down, extent: sides that enough members have, and how far the element reaches past its anchor."""
    extent = F.greatest(F.lit(0), F.median(inserted) - F.median(anchor)) + slack
    return rows.groupBy(bag).agg((F.avg(up.cast("int")) >= least).alias("accept_up"), (F.avg(down.cast("int")) >= least).alias("accept_down"), extent.alias("extent"))


def locus_rollup(blocks: DataFrame, locus: str, start: str, end: str, sides: dict[str, Column], verdict: str) -> DataFrame:
    """locus, first_s, last_e, total, architecture, best.  ``sides``: two names with their conditions; ``verdict``: least is best."""
    (one, a), (two, b) = ((n, F.max(c.cast("int")) == 1) for n, c in sides.items())
    shape = F.when(a & b, "both").when(a, one).when(b, two).otherwise("other")
    return blocks.groupBy(locus).agg(F.min(start).alias("first_s"), F.max(end).alias("last_e"), F.sum(F.col(end) - F.col(start)).alias("total"), shape.alias("architecture"), F.min(verdict).alias("best"))


def marker_summary(rows: DataFrame, group: str, anchor: str, distance: Column) -> DataFrame:
    """group, n_anchors, nearest: how many of a block's anchors have a marker of the group, and the least distance."""
    return rows.groupBy(group).agg(F.countDistinct(anchor).alias("n_anchors"), F.min(distance).alias("nearest"))


def off_bag_enrichment(bags: DataFrame, family: str, bag: str, hits: str, total: str, siblings: int = 3) -> DataFrame:
    """bag, enrichment: a bag's hit rate over that of the first ``siblings`` other bags of its family; null where they have none."""
    ranked = bags.withColumn("_rn", F.row_number().over(W.partitionBy(family).orderBy(bag)))
    few = ranked.where(F.col("_rn") <= siblings + 1).select(F.col(family).alias("_f"), F.col("_rn").alias("_sn"), F.col(hits).alias("_h"), F.col(total).alias("_t"))
    # of the first siblings + 1 bags one's own is left out, or the last
    other = (F.col("_sn") != F.col("_rn")) & ((F.col("_rn") <= siblings + 1) | (F.col("_sn") <= siblings))
    met = ranked.join(few, (F.col(family) == F.col("_f")) & other, "left").groupBy(bag, hits, total).agg(F.sum("_h").alias("_oh"), F.sum("_t").alias("_ot"))
    off = F.col("_oh") / F.nullif(F.col("_ot"), F.lit(0))
    return met.select(bag, (F.col(hits) / F.col(total) / F.nullif(off, F.lit(0.0))).alias("enrichment"))
