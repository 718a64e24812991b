"""Operators on records of outside tools: files that belong together by place, model libraries, reports, region tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.verdicts import covariation_verdict


def zip_records(left: DataFrame, right: DataFrame, group: str, left_order: Sequence[str], right_order: Sequence[str], unique: Sequence[str] = ()) -> DataFrame:
    """Rows of two tables that belong together by their place in a group; raises where one has more rows than the other.

    Of rows that agree in ``group`` and ``unique`` only the first stays.  The orders' columns are dropped.
    """
    a = left.withColumn("_at", F.row_number().over(W.partitionBy(group).orderBy(*left_order))).drop(*left_order)
    b = right.withColumn("_bt", F.row_number().over(W.partitionBy(group).orderBy(*right_order))).drop(*right_order).withColumnRenamed(group, "_g")
    met = a.join(b, (F.col(group) == F.col("_g")) & (F.col("_at") == F.col("_bt")), "full_outer")
    whole = F.col("_at").isNotNull() & F.col("_bt").isNotNull()
    name = F.when(whole, F.col(group)).otherwise(F.raise_error(F.concat(F.lit("records of unequal number in "), F.coalesce(F.col(group), F.col("_g")).cast("string"))))
    met = met.withColumn(group, name).drop("_g", "_bt")
    if unique:
        first = F.row_number().over(W.partitionBy(group, *unique).orderBy("_at"))
        met = met.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    return met.drop("_at")


def fetch_models(library: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The library's records of the wanted models, with the columns of ``wanted``; raises where a model is not there."""
    found = library.withColumn("_there", F.lit(True))
    met = wanted.join(found, name, "left")
    checked = F.when(F.col("_there"), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no such model: "), F.col(name))))
    return met.withColumn(name, checked).drop("_there")


def covariation_summary(pairs: DataFrame, group: str, evalue: float = 0.05) -> DataFrame:
    """group, found, expected, tp, ppv and verdict from a tool's table of tested pairs: i, j, in_structure, evalue, power."""
    hit = F.col("evalue") < evalue
    tp = F.sum((hit & F.col("in_structure")).cast("long"))
    out = pairs.groupBy(group).agg(F.sum(hit.cast("long")).alias("found"), F.sum("power").alias("expected"), tp.alias("tp"))
    out = out.withColumn("ppv", F.when(F.col("found") > 0, F.col("tp") / F.col("found")).otherwise(0.0))
    return out.withColumn("verdict", covariation_verdict(F.col("expected"), F.col("tp"), F.col("ppv")))


def structure_regions(scores: DataFrame, group: str, pos: str, score: str, floor: float, least: int) -> DataFrame:
    """group, s, e, mean_score, max_score: maximal runs of consecutive positions that score ``floor`` or more, from ``least`` positions on."""
    run = F.col(pos) - F.row_number().over(W.partitionBy(group).orderBy(pos))
    kept = scores.where(F.col(score) >= floor).withColumn("_run", run)
    out = kept.groupBy(group, "_run").agg(F.min(pos).alias("s"), (F.max(pos) + 1).alias("e"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))
    return out.where(F.col("e") - F.col("s") >= least).drop("_run")


def best_recurrence(regions: DataFrame, keys: Sequence[str], site: str, cluster: str) -> DataFrame:
    """keys, best: of the clusters of a bag's regions the one at most sites, as a share of all the bag's sites."""
    sites = regions.groupBy(*keys).agg(F.countDistinct(site).alias("_sites"))
    most = regions.groupBy(*keys, cluster).agg(F.countDistinct(site).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_most"))
    return most.join(sites, list(keys)).select(*keys, (F.col("_most") / F.col("_sites")).alias("best"))


def region_null(regions: DataFrame, decoys: DataFrame, family: str, bag: str, site: str, cluster: str) -> DataFrame:
    """family, bag, best, null_mean, null_max, p: a bag's best recurrence against decoys of other bags' sites of its family.

    ``decoys``: family, bag, replicate, site.  Bags without a decoy have nulls.
    """
    real = best_recurrence(regions, [family, bag], site, cluster)
    drawn = decoys.select(family, bag, "replicate", site).join(regions.select(family, site, cluster), [family, site])
    made = best_recurrence(drawn, [family, bag, "replicate"], site, cluster).withColumnRenamed("best", "_null")
    met = real.join(made, [family, bag], "left").groupBy(family, bag, "best")
    at_least = F.sum((F.col("_null") >= F.col("best")).cast("int"))
    out = met.agg(F.avg("_null").alias("null_mean"), F.max("_null").alias("null_max"), F.count("_null").alias("_n"), at_least.alias("_ge"))
    return out.withColumn("p", F.when(F.col("_n") > 0, (F.col("_ge") + 1) / (F.col("_n") + 1))).drop("_n", "_ge")


def palindromic(identity: Column, length: Column, block: Column, least_identity: float = 70.0, least_share: float = 0.5) -> Column:
    """Whether a hit of a block to a reverse complement explains it: similar enough, over enough of the block."""
    return (identity >= least_identity) & (length >= least_share * block)
