"""Deterministic samplers.  Order comes from SHA-1 of seed and id, so results do not depend on row order or partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import jaccard, kmers, tie_key
from .scratch import written


def hash_rank(rows: DataFrame, groups: Sequence[str], key: str, seed: int | str) -> DataFrame:
    """Adds ``rank``: the row's place in its group by sha1("seed:id")."""
    tie = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(tie, key)))


def hash_sample(rows: DataFrame, groups: Sequence[str], key: str, cap: int, seed: int | str) -> DataFrame:
    """The ``cap`` rows of each group with the smallest hashes; all rows if ``cap`` is not positive."""
    if cap <= 0:
        return rows
    return hash_rank(rows, groups, key, seed).where(F.col("rank") <= cap).drop("rank")


def stride(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Every (n // most)-th row of a group in key order, at most ``most``."""
    w = W.partitionBy(group)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    kept = ranked.where((F.col("_rn") % step == 0) & (F.floor(F.col("_rn") / step) < most))
    return kept.drop("_rn", "_n")


def first_n(rows: DataFrame, group: str, n: int, *order) -> DataFrame:  # noqa: ANN002
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def interleave(rows: DataFrame, kind: str, first: str, *order) -> DataFrame:  # noqa: ANN002
    """Adds ``turn``: ranked lists of two kinds taken alternately, ``first`` leading, the longer one going on alone.

    The turn follows from a row's rank in its list and the length of the shorter list, so no sort of all rows is needed.
    """
    sizes = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("_n")).groupBy().agg(F.when(F.count(F.lit(1)) > 1, F.min("_n")).otherwise(0).alias("_m"))
    shorter = F.broadcast(sizes)  # one row
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(kind).orderBy(*order))).withColumn("_one", F.lit(1))
    met = ranked.join(shorter.withColumn("_one", F.lit(1)), "_one")
    both = 2 * F.col("_rn") - F.when(F.col(kind) == first, 1).otherwise(0)
    return met.withColumn("turn", F.when(F.col("_rn") <= F.col("_m"), both).otherwise(F.col("_m") + F.col("_rn"))).drop("_rn", "_one", "_m")


def median_length(rows: DataFrame, group: str, length: str, key: str) -> DataFrame:
    """The row at n // 2 in order of (length, key)."""
    w = W.partitionBy(group)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(length, key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rn") == F.floor(F.col("_n") / 2)).drop("_rn", "_n")


def profiles(rows: DataFrame, group: str, key: str, seq: str, pref: str, seed: int, k: int = 5) -> DataFrame:
    """grp, id, pref, tie, text (a digest of the sequence) and bag, the hashes of its k-mers; both null without a sequence."""
    bag = F.when(F.col(seq).isNotNull(), F.transform(kmers(F.col(seq), k), lambda x: F.xxhash64(x)))
    named = F.col(key).cast("string")
    return rows.select(F.col(group).cast("string").alias("grp"), named.alias("id"), F.coalesce(F.col(pref).cast("double"), F.lit(0.0)).alias("pref"), tie_key(seed, named).alias("tie"), F.sha1(seq).alias("text"), bag.alias("bag"))


def spread(placed: DataFrame, n: int) -> DataFrame:
    """grp, round, seed, bag: up to ``n`` rows of each group that are far from each other, in the order of their choice.

    A round is one pass and one aggregation over the rows as they lie: the row with the greatest gap to all seeds before it,
    then ``pref``, then ``tie``.  Gaps are worked out anew from the few seeds of a group, so neither rows nor gaps are joined,
    shuffled or written between rounds, and a group of any size is spread over all tasks.
    """
    out = None
    best = F.max_by(F.struct("id", "bag"), F.struct("gap", "pref", "tie")).alias("s")
    for number in range(n):
        if out is None:
            state = placed.withColumn("gap", F.lit(1.0))
        else:
            held = out.groupBy(F.col("grp").alias("_grp")).agg(F.collect_list(F.struct("seed", "bag")).alias("_seeds"))
            near = F.array_min(F.transform("_seeds", lambda s: 1 - jaccard(F.col("bag"), s["bag"])))  # noqa: B023
            left = placed.join(held, F.col("grp").eqNullSafe(F.col("_grp"))).where(~F.exists("_seeds", lambda s: s["seed"] == F.col("id")))
            state = left.withColumn("gap", F.least(F.lit(1.0), near))
        top = written(state.groupBy("grp").agg(best).select("grp", F.lit(number).alias("round"), F.col("s.id").alias("seed"), F.col("s.bag").alias("bag")), "seeds")
        if out is not None and not top.take(1):
            break
        out = top if out is None else out.unionByName(top)
    return out


def by_typicality(placed: DataFrame, seeds: DataFrame, most: int, probes: int = 40) -> DataFrame:
    """grp, id, seed, depth up to ``most``: rows under their most similar seed, from the most preferred and typical one on.

    Equal similarities are told apart by a hash of row and seed together, so near-copies do not all fall to one seed.
    Typical is who is similar to the ``probes`` rows of the group with the smallest hashes.  That is worked out where it
    can matter: for rows with fewer than ``most`` more preferred ones under their seed.
    """
    held = seeds.groupBy("grp").agg(F.collect_list(F.struct("seed", "bag")).alias("seeds"))
    likeness = lambda s: F.struct(jaccard(F.col("bag"), s["bag"]).alias("j"), F.sha1(F.concat("tie", F.lit("|"), s["seed"])).alias("h"), s["seed"].alias("seed"))
    near = written(placed.join(held, "grp").withColumn("seed", F.array_max(F.transform("seeds", likeness))["seed"]).select("grp", "id", "seed", "pref", "tie"), "near-seeds")
    bags = placed.select("grp", "id", "bag")
    few = near.withColumn("_rn", F.row_number().over(W.partitionBy("grp", "seed").orderBy("tie", "id"))).where(F.col("_rn") <= probes)
    probe = bags.join(few, ["grp", "id"]).groupBy("grp", "seed").agg(F.sort_array(F.collect_list(F.struct("_rn", "bag"))).alias("probe"))
    weight = F.aggregate(F.transform("probe", lambda p: jaccard(F.col("bag"), p["bag"])), F.lit(0.0), lambda x, y: x + y)
    first = near.withColumn("_rank", F.rank().over(W.partitionBy("grp", "seed").orderBy(F.desc("pref")))).where(F.col("_rank") <= most)
    weighed = bags.join(first, ["grp", "id"]).join(probe, ["grp", "seed"]).select("grp", "id", "seed", "pref", "tie", weight.alias("weight"))
    order = W.partitionBy("grp", "seed").orderBy(F.desc("pref"), F.desc("weight"), F.desc("tie"))
    return weighed.select("grp", "id", "seed", F.row_number().over(order).alias("depth")).where(F.col("depth") <= most)


def sample_groups(rows: DataFrame, group: str, key: str, seq: str, pref: str, cap: int, seed: int, mode: str = "stratified", dedup: bool = False) -> DataFrame:
    """group, id of the sample of each group: exactly ``cap`` rows, or all of a group that has no more.

    Modes: ``stratified`` takes the rows under far-apart seeds in turns, the typical ones first; ``representatives`` the
    first row under each of ``cap`` seeds; ``diverse`` the seeds themselves; ``hash`` and ``first`` go by hash and by key.
    Rows without a sequence come last, by hash.  ``dedup`` lays out each distinct sequence once, copies then come last too.
    """
    if cap <= 0:
        return rows.select(group, F.col(key).alias("id"))
    if mode == "hash":
        return hash_sample(rows, [group], key, cap, seed).select(group, F.col(key).alias("id"))
    if mode == "first":
        return first_n(rows, group, cap, key).select(group, F.col(key).alias("id"))
    every = profiles(rows, group, key, seq, pref, seed)
    sizes = every.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    small = every.join(sizes.where(F.col("_n") <= cap).select("grp"), "grp", "left_semi").select("grp", "id")
    large = written(every.join(sizes.where(F.col("_n") > cap).select("grp"), "grp", "left_semi"), "profiles")
    placed = large.where("bag is not null")
    if dedup:
        first = W.partitionBy("grp", "text").orderBy(F.desc("pref"), F.desc("tie"))
        placed = placed.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    seeds = spread(placed, cap)
    if mode == "diverse":
        laid = seeds.select("grp", F.col("seed").alias("id"), F.lit(1).alias("depth"), F.lpad(F.col("round").cast("string"), 10, "0").alias("_turn"))
    else:
        laid = by_typicality(placed, seeds, 1 if mode == "representatives" else cap).select("grp", "id", "depth", F.col("seed").alias("_turn"))
    if mode == "representatives":
        laid = laid.where("depth = 1")
    else:
        rest = large.join(laid.select("grp", "id"), ["grp", "id"], "left_anti").select("grp", "id", F.lit(None).cast("int").alias("depth"), F.col("tie").alias("_turn"))
        laid = laid.unionByName(rest)
    turn = F.row_number().over(W.partitionBy("grp").orderBy(F.col("depth").asc_nulls_last(), "_turn", "id"))
    chosen = laid.withColumn("_rn", turn).where(F.col("_rn") <= cap).select("grp", "id")
    return small.unionByName(chosen).withColumnRenamed("grp", group)


def pick_references(windows: DataFrame, group: str, key: str, seq: str, length: str, most: int, seed: int = 1) -> DataFrame:
    """group, id of up to ``most`` references of each group: representatives, the longest windows being preferred."""
    return sample_groups(windows, group, key, seq, length, most, seed, "representatives")
