"""Preconditions that stop a plan instead of letting it record a verdict on incomplete input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_complete(rows: DataFrame, audit: DataFrame, shard: str = "shard", complete: str = "complete") -> DataFrame:
    """``rows``, unless a shard of the audit table is not complete (null counts as not)."""
    missing = [r[0] for r in audit.where(~F.coalesce(F.col(complete), F.lit(False))).select(shard).orderBy(shard).limit(5).collect()]
    if missing:
        raise ValueError(f"incomplete input: {', '.join(map(str, missing))}")
    return rows


def require_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    if absent := [n for n in names if n not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return rows


def require_rows(rows: DataFrame, message: str) -> DataFrame:
    if not rows.take(1):
        raise ValueError(message)
    return rows


def shard_problems(rows: DataFrame, summaries: DataFrame, shard: str = "shard", but: Sequence[str] = ()) -> DataFrame:
    """shard, problem: what speaks against merging ``rows``; none if nothing does.

    ``summaries`` has a row per shard: its name, ``expected`` rows (null: not known), ``complete`` (null counts as not) and
    ``parameters`` (map of strings).  Parameters have to equal those of the first shard by name, but for the names in
    ``but``, such as paths.  Shards without a summary, or with more than one, are problems too.
    """
    counts = rows.groupBy(F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    own = F.map_filter(F.coalesce("parameters", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*but) if but else F.lit(True))
    told = summaries.select(F.col(shard).alias("of"), "expected", F.coalesce("complete", F.lit(False)).alias("complete"), F.array_sort(F.map_entries(own)).alias("_p"))
    told = told.withColumn("_first", F.first("_p").over(W.partitionBy(F.lit(0)).orderBy("of"))).withColumn("_times", F.count(F.lit(1)).over(W.partitionBy("of")))
    met = counts.join(told, F.col("shard").eqNullSafe(F.col("of")), "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    differing = F.array_sort(F.array_distinct(F.transform(F.array_union(F.array_except("_p", "_first"), F.array_except("_first", "_p")), lambda x: x["key"])))
    found = F.array(
        F.when(F.col("complete").isNull(), "no summary"),
        F.when(F.col("_times") > 1, "several summaries"),
        F.when(~F.col("complete"), "incomplete"),
        F.when(F.col("n") != F.col("expected"), F.concat(F.col("n").cast("string"), F.lit(" rows, "), F.col("expected").cast("string"), F.lit(" expected"))),
        F.when(F.size(differing) > 0, F.concat(F.lit("parameters differ: "), F.array_join(differing, ", "))),
    )
    return met.select(F.coalesce("shard", "of").alias("shard"), F.explode(F.array_compact(found)).alias("problem")).distinct()


def merge_audited(rows: DataFrame, summaries: DataFrame, shard: str = "shard", but: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows without their shard, and the failures that shards report (``failures``, an array) carried along.

    A problem of any shard is an error: nothing is merged.
    """
    if problems := shard_problems(rows, summaries, shard, but).orderBy("shard", "problem").take(20):
        raise ValueError("; ".join(f"{r['shard']}: {r['problem']}" for r in problems))
    return rows.drop(shard), summaries.select(shard, F.explode("failures").alias("failure"))
