"""Recurrent blocks: from alignments to scored blocks, and helices from covarying pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import trim_member
from ..functions.verdicts import length_consistency, tightness
from .joins import best_of, overlapping
from .scratch import written
from .sweep import coverage, runs


def best_reference(hsps: DataFrame) -> DataFrame:
    """All alignments of a member to the reference of its single best one; the earlier row wins ties."""
    best = best_of(hsps, ["clade", "q"], F.desc("bitscore"), "hsp").select("clade", "q", "s")
    return hsps.join(best, ["clade", "q", "s"])


def composite_score(members: DataFrame, block: str, member: str, total: int | str) -> DataFrame:
    """Recurrence · tightness · strand consistency · length consistency of each block.

    ``members``: block, member, s, e, strand; ``total``: windows of the clade, a number or a column.
    """
    n = F.lit(total) if isinstance(total, int) else F.col(total)
    keys = [block] if isinstance(total, int) else [block, total]
    rows = members.withColumn("_len", F.col("e") - F.col("s"))
    middle = rows.groupBy(*keys).agg(F.countDistinct(member).alias("members"), F.median("s").alias("median_start"), F.median("_len").alias("median_len"), F.avg((F.col("strand") == "+").cast("double")).alias("_plus"))
    spread = rows.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col("s") - F.col("median_start"))).alias("mad_start"), F.median(F.abs(F.col("_len") - F.col("median_len"))).alias("mad_len"))
    out = middle.join(spread, keys).withColumn("recurrence", F.col("members") / n).withColumn("tightness", tightness(F.col("mad_start"))).withColumn("strand_consistency", F.greatest("_plus", 1 - F.col("_plus"))).withColumn("length_consistency", length_consistency(F.col("mad_len"), F.col("median_len")))
    return out.withColumn("composite", F.col("recurrence") * F.col("tightness") * F.col("strand_consistency") * F.col("length_consistency")).drop("_plus")


def call_blocks(segments: DataFrame, windows: DataFrame, least_recurrence: float = 0.5, least_members: int = 5, least_len: int = 40, bin_size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Blocks and their members from segments in the anchor frame.

    ``segments``: clade, member, rs, re, ms, me, strand; ``windows``: clade, n.  A block is a maximal run of the reference
    axis under segments of enough distinct members; each member adds its best overlapping segment, trimmed to the run.
    """
    need = F.greatest(F.lit(least_members), F.bround(F.lit(least_recurrence) * F.col("n"))).cast("long")
    clades = windows.where(F.col("n") >= least_members).select("clade", "n", need.alias("need"))
    on_axis = segments.select("clade", "member", F.col("rs").alias("s"), F.col("re").alias("e"))
    depth = written(coverage(on_axis, "clade", "member", merged=True), "block-depth").join(clades, "clade")
    called = runs(depth, "clade", "need").where(F.col("e") - F.col("s") >= least_len)
    called = written(called.withColumn("block", F.row_number().over(W.partitionBy("clade").orderBy("s"))), "blocks")
    pieces = segments.select("clade", "member", F.col("rs").alias("s"), F.col("re").alias("e"), "ms", "me", "strand")
    met = overlapping(called, pieces, "clade", bin_size)
    cut = met.withColumn("t", trim_member(F.col("s"), F.col("e"), F.col("r_s"), F.col("r_e"), F.col("r_ms"), F.col("r_me"), F.col("r_strand"))).where("t is not null")
    best = best_of(cut, ["clade", "block", "r_member"], F.desc("overlap"), "r_s", "r_ms")
    members = best.select("clade", "block", F.col("r_member").alias("member"), F.col("t.s").alias("s"), F.col("t.e").alias("e"), F.col("r_strand").alias("strand"))
    enough = members.groupBy("clade", "block").agg(F.count(F.lit(1)).alias("_n")).join(clades, "clade").where("_n >= need").select("clade", "block", "n")
    members = members.join(enough, ["clade", "block"])
    scored = composite_score(members.withColumn("_b", F.struct("clade", "block")), "_b", "member", "n").select("_b.clade", "_b.block", "n", "members", "median_start", "median_len", "recurrence", "tightness", "strand_consistency", "length_consistency", "composite")
    return scored, members.drop("n")


def helices(pairs: DataFrame, group: str, gap: int = 4) -> DataFrame:
    """group, i, j, helix: in order of (i, j) a pair joins the first helix whose last pair lies within ``gap`` of it on both sides.

    No helix reaches over a step of more than ``gap`` in i, so each stretch between such steps is folded by itself, in the
    JVM; helices are numbered from 0 along the group.
    """
    order = W.partitionBy(group).orderBy("i", "j")
    step = F.when(F.col("i") - F.lag("i").over(order) <= gap, 0).otherwise(1)
    pair = F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    stretches = pairs.select(group, "i", "j").withColumn("_s", step).withColumn("_s", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    held = stretches.groupBy(group, "_s").agg(F.sort_array(F.collect_list(pair)).alias("_p"))
    kind = "struct<last:array<struct<i:bigint,j:bigint>>,named:array<struct<i:bigint,j:bigint,h:int>>>"

    def fold(state, p):  # noqa: ANN001, ANN202
        near = F.transform(state["last"], lambda q: (F.abs(p["i"] - q["i"]) <= gap) & (F.abs(p["j"] - q["j"]) <= gap))
        found = F.array_position(near, True).cast("int")
        at = F.when(found > 0, found).otherwise(F.size(state["last"]) + 1)
        moved = F.when(found > 0, F.transform(state["last"], lambda q, x: F.when(x == found - 1, p).otherwise(q))).otherwise(F.concat(state["last"], F.array(p)))
        named = F.concat(state["named"], F.array(F.struct(p["i"].alias("i"), p["j"].alias("j"), at.alias("h"))))
        return F.struct(moved.alias("last"), named.alias("named")).cast(kind)

    none = F.struct(F.array().alias("last"), F.array().alias("named")).cast(kind)
    folded = held.withColumn("_f", F.aggregate("_p", none, fold)).select(group, "_s", "_f.named", F.size("_f.last").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = folded.withColumn("_before", before).select(group, "_before", F.explode("named").alias("_x"))
    return out.select(F.col(group).cast("string").alias(group), "_x.i", "_x.j", (F.col("_before") + F.col("_x.h") - 1).cast("long").alias("helix"))
