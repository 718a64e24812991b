"""Null models: permutation decoys, shuffled anchors and background windows, all drawn by hash instead of a generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(low: Column, high: Column, *key: Column | str) -> Column:
    """An integer in [low, high) that depends on the key only."""
    return low + F.pmod(F.conv(F.substring(F.sha1(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("bigint"), high - low)


def permutation_decoys(windows: DataFrame, family: str, clade: str, key: str, replicates: int, seed: int, least: int = 8) -> DataFrame:
    """Decoy clades: for each clade and replicate, as many windows of the family's other clades, spread over them.

    A source gives its windows in hash order; sources take turns by size; a source gives at most ceil(n / sources) before
    any gives more.  Columns: family, clade, replicate, source, key, taken_from (rows of that source in the decoy).
    """
    sizes = windows.groupBy(family, clade).agg(F.count(F.lit(1)).alias("_size"))
    per_family = sizes.groupBy(family).agg(F.count(F.lit(1)).alias("_clades"), F.sum("_size").alias("_total"))
    targets = sizes.where(F.col("_size") >= least).join(per_family, family).where((F.col("_clades") > 1) & (F.col("_total") - F.col("_size") >= F.col("_size")))
    targets = targets.select(family, clade, F.col("_size").alias("_need"), F.ceil(F.col("_size") / (F.col("_clades") - 1)).alias("_quota")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    pool = windows.join(sizes, [family, clade]).select(family, F.col(clade).alias("source"), key, "_size")
    # a decoy needs at most _need windows of a source, so each source's first ones in an order of its own suffice
    drawn = pool.withColumn("_own", F.row_number().over(W.partitionBy(family, "source").orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)))
    met = targets.join(drawn, family).where((F.col("source") != F.col(clade)) & (F.col("_own") <= F.col("_need")))
    w = W.partitionBy(family, clade, "replicate", "source").orderBy(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(clade).cast("string"), F.col(key).cast("string"))), key)
    ranked = met.withColumn("_rank", F.row_number().over(w)).withColumn("_over", (F.col("_rank") > F.col("_quota")).cast("int"))
    turn = W.partitionBy(family, clade, "replicate").orderBy("_over", "_rank", F.desc("_size"), "source")
    taken = ranked.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= F.col("_need"))
    return taken.withColumn("taken_from", F.count(F.lit(1)).over(W.partitionBy(family, clade, "replicate", "source"))).select(family, clade, "replicate", "source", key, "taken_from")


def decoy_quality(decoys: DataFrame, family: str, clade: str, least_sources: int = 4, most: float = 0.5) -> DataFrame:
    per = decoys.groupBy(family, clade, "replicate", "source").agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(family, clade, "replicate").agg(F.count(F.lit(1)).alias("sources"), (F.max("_n") / F.sum("_n")).alias("max_source_fraction"))
    return out.withColumn("degenerate", (F.col("sources") < least_sources) | (F.col("max_source_fraction") > most))


def family_strength(families: DataFrame, quality: DataFrame, family: str) -> DataFrame:
    """none without decoys, degenerate if more than half are, else strong."""
    share = quality.groupBy(family).agg(F.avg(F.col("degenerate").cast("int")).alias("_share"))
    return families.join(share, family, "left").select(family, F.when(F.col("_share").isNull(), "none").when(F.col("_share") > 0.5, "degenerate").otherwise("strong").alias("strength"))


def shuffled_anchors(windows: DataFrame, key: str, offset: str, anchor_len: str, length: str, apart: int, seed: int) -> DataFrame:
    """A pseudo-anchor at least ``apart`` from the real one, on a random strand; null where the window has no room."""
    room_left = F.greatest(F.lit(0), F.col(offset) - apart - F.col(anchor_len) + 1)
    right_from = F.col(offset) + F.col(anchor_len) + apart
    room_right = F.greatest(F.lit(0), F.col(length) - F.col(anchor_len) - right_from + 1)
    total = room_left + room_right
    at = uniform(F.lit(0).cast("bigint"), F.greatest(total, F.lit(1)), F.lit(str(seed)), F.col(key).cast("string"))
    place = F.when(at < room_left, at).otherwise(right_from + at - room_left)
    minus = F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.lit(2)) == 1
    out = windows.withColumn("pseudo_offset", F.when(total > 0, place)).withColumn("pseudo_strand", F.when(minus, -1).otherwise(1))
    return out.withColumn("pseudo_offset", F.when(minus, F.col(length) - F.col("pseudo_offset") - F.col(anchor_len)).otherwise(F.col("pseudo_offset")))


def background(windows: DataFrame, contigs: DataFrame, genome: str, key: str, length: str, seed: int, replicates: int = 1) -> DataFrame:
    """Windows of the same lengths at hash-drawn places of the same genome; 0-based start, exclusive end."""
    rows = windows.join(contigs, genome).where(F.col("contig_len") >= F.col(length)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    start = uniform(F.lit(0).cast("bigint"), F.col("contig_len") - F.col(length) + 1, F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string"))
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.col(length))


def manifest(made: Column, wanted: Column, retained: float = 0.9) -> Column:
    return F.when(made.isNull() | (made == 0), "none").when(made >= retained * wanted, "matched").otherwise("short")


def renamed(proteins: DataFrame, decoys: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Proteins of the base ids under the decoys' ids."""
    return decoys.join(proteins, key).select(*names)
