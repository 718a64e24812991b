"""Rank statistics.  Ranks are windows; everything else is an aggregate over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def midranks(rows: DataFrame, groups: Sequence[str], value: str, name: str = "midrank") -> DataFrame:
    """Ranks from 1, ties sharing their mean.  Equal values are counted first, so only distinct values are sorted."""
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2)
    return rows.join(ranks.drop("_n"), [*groups, value])


def auc(rows: DataFrame, groups: Sequence[str], value: str, positive: Column) -> DataFrame:
    """Area under the curve per group from midranks; null if a class is empty."""
    counted = rows.withColumn("_p", positive.cast("long")).groupBy(*groups, value).agg(F.sum("_p").alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = counted.withColumn("_r", F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2)
    out = ranked.groupBy(*groups).agg(F.sum(F.col("_r") * F.col("_p")).alias("_s"), F.sum("_p").alias("n_pos"), (F.sum("_n") - F.sum("_p")).alias("n_neg"))
    area = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return out.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), area)).drop("_s")


def spearman(rows: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of midranks; null if either side is constant."""
    both = midranks(midranks(rows, groups, x, "_rx"), groups, y, "_ry")
    out = both.groupBy(*groups).agg(F.corr("_rx", "_ry").alias("_c"), F.countDistinct("_rx").alias("_a"), F.countDistinct("_ry").alias("_b"))
    return out.select(*groups, F.when((F.col("_a") > 1) & (F.col("_b") > 1), F.col("_c")).alias("rho"))


def permutation_p(rows: DataFrame, key: str, value: str, label: str, replicates: int, seed: int, block_rows: int = 2048, chunk: int = 1000) -> DataFrame:
    """observed, p: share of label permutations whose positive mean is at least the observed one, (ge + 1) / (n + 1).

    Rows are dealt by hashes of their keys into blocks of about ``block_rows``, larger ones beyond 256 blocks.  A replicate draws how many of its positives
    each block has, from the multivariate hypergeometric law of the blocks' sizes, and which rows of the block these are;
    together that is a uniform permutation.  Blocks are shared by tasks of ``chunk`` replicates, and of all that only the
    sums per replicate and block are shuffled, never rows x replicates.  Draws depend on the seed and the keys alone.

    Null values have no part in a mean, but in the draws; rows of null labels are never positive.
    """
    n_rows, n_pos, observed = rows.agg(F.count(F.lit(1)), F.sum(label), F.avg(F.when(F.col(label) == 1, F.col(value)))).first()
    n_pos, blocks, chunks = int(n_pos or 0), min(256, max(1, -(-n_rows // block_rows))), -(-replicates // chunk)
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).cast("int").alias("_block"), F.col(key).cast("string").alias("_key"), F.col(value).cast("double").alias("_value"))
    sizes = np.zeros(blocks, np.int64)
    for r in dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect():  # a number a block
        sizes[r["_block"]] = r["n"]

    def draw(some: pa.Table) -> pa.Table:
        some = some.sort_by([("_key", "ascending"), ("_value", "ascending")])
        block, part = some["_block"][0].as_py(), some["_chunk"][0].as_py()
        held = some["_value"].to_numpy()
        there = ~np.isnan(held)
        sums = np.stack([np.where(there, held, 0.0), there], 0)
        first, last = part * chunk, min((part + 1) * chunk, replicates)
        taken = np.random.default_rng([seed, part]).multivariate_hypergeometric(sizes, n_pos, last - first, method="marginals")[:, block]
        rng, out = np.random.default_rng([seed, part, block]), np.zeros((last - first, 2))
        for r, n in enumerate(taken.tolist()):
            out[r] = sums[:, rng.permutation(len(held))[:n]].sum(1)
        return pa.table({"_rep": pa.array(np.arange(first, last), pa.int32()), "_s": pa.array(out[:, 0]), "_n": pa.array(out[:, 1])})

    shared = dealt.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("_block", "_chunk").applyInArrow(draw, "_rep int, _s double, _n double")
    means = shared.groupBy("_rep").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).select((F.col("_s") / F.nullif(F.col("_n"), F.lit(0.0))).alias("_m"))
    reached = F.sum((F.col("_m") >= F.lit(observed)).cast("int"))
    return means.where(F.lit(n_pos > 0)).agg(reached.alias("_ge"), F.count(F.lit(1)).alias("_all")).where("_all > 0").select(F.lit(observed).cast("double").alias("observed"), ((F.coalesce("_ge", F.lit(0)) + 1) / (F.col("_all") + 1)).alias("p"))
