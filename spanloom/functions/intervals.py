"""Interval algebra as Spark columns.  One convention inside: 0-based, half-open; readers and writers convert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import reverse_complement

ARRAY = "array<struct<s:bigint,e:bigint>>"


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def merged(parts: Column) -> Column:
    """Union of an array of (s, e); touching intervals become one."""

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        fresh = F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        return F.when(F.size(acc) == 0, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))).when(x["s"] <= last["e"], grown).otherwise(fresh)

    return F.aggregate(F.array_sort(parts).cast(ARRAY), F.array().cast(ARRAY), add)


def subtract(s: Column, e: Column, mask: Column) -> Column:
    """What a merged, sorted mask leaves of [s, e), as an array of pieces."""
    inner = F.filter(mask, lambda m: (m["e"] > s) & (m["s"] < e))
    cuts = F.concat(F.array(s), F.transform(inner, lambda m: F.least(m["e"], e)))
    stops = F.concat(F.transform(inner, lambda m: F.greatest(m["s"], s)), F.array(e))
    return F.filter(F.zip_with(cuts, stops, lambda a, b: F.struct(a.alias("s"), b.alias("e"))), lambda p: p["s"] < p["e"])


def covered(s: Column, e: Column, mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda t, m: t + overlap(s, e, m["s"], m["e"]))


def coding_fraction(s: Column, e: Column, mask: Column) -> Column:
    """1 for an empty interval."""
    return F.when(e <= s, F.lit(1.0)).otherwise(covered(s, e, mask) / (e - s))


def flank(start: Column, end: Column, strand: Column, contig_len: Column, size: int, least: int) -> Column:
    """Window of ``size`` either side of a 1-based inclusive anchor, clamped; flanks swap on the minus strand; null on short contigs."""
    ws, we = F.greatest(F.lit(1), start - size), F.least(contig_len, end + size)
    up, down = start - ws, we - end
    left, right = F.when(strand < 0, down).otherwise(up), F.when(strand < 0, up).otherwise(down)
    body = F.struct(ws.alias("win_start"), we.alias("win_end"), left.alias("anchor_offset"), left.alias("left_flank"), right.alias("right_flank"), (left < size).alias("truncated_left"), (right < size).alias("truncated_right"))
    return F.when(contig_len >= least, body)


def trim_member(block_s: Column, block_e: Column, ref_s: Column, ref_e: Column, mem_s: Column, mem_e: Column, strand: Column) -> Column:
    """The part of a member segment under a block: scaled by the length ratio, mirrored on minus, null if empty."""
    lo, hi = F.greatest(block_s, ref_s), F.least(block_e, ref_e)
    ratio = (mem_e - mem_s) / (ref_e - ref_s)
    plus_s, plus_e = mem_s + F.bround((lo - ref_s) * ratio), mem_s + F.bround((hi - ref_s) * ratio)
    minus_s, minus_e = mem_e - F.bround((hi - ref_s) * ratio), mem_e - F.bround((lo - ref_s) * ratio)
    s = F.greatest(F.when(strand == "-", minus_s).otherwise(plus_s), mem_s).cast("bigint")
    e = F.least(F.when(strand == "-", minus_e).otherwise(plus_e), mem_e).cast("bigint")
    return F.when((hi > lo) & (e > s), F.struct(s.alias("s"), e.alias("e")))


def to_query(x: Column, ref_s: Column, ref_e: Column, mem_s: Column, mem_e: Column, strand: Column) -> Column:
    """A reference coordinate on the member axis."""
    share = (x - ref_s) * (mem_e - mem_s) / (ref_e - ref_s)
    return F.when(strand == "-", mem_e - F.bround(share)).otherwise(mem_s + F.bround(share)).cast("bigint")


def to_genome(win_s: Column, win_e: Column, p0: Column, p1: Column, strand: Column) -> Column:
    """Window-relative [p0, p1) as 1-based inclusive contig coordinates."""
    plus = F.struct((win_s + p0).alias("start"), (win_s + p1 - 1).alias("end"))
    minus = F.struct((win_e - p1 + 1).alias("start"), (win_e - p0).alias("end"))
    return F.when(strand < 0, minus).otherwise(plus)


def round_trip(contig: Column, window: Column, place: Column, p0: Column, p1: Column, strand: Column) -> Column:
    """Whether the contig's letters at ``place`` (of ``to_genome``) are the window's letters [p0, p1), turned on strand -."""
    cut = F.substr(contig, place["start"].cast("int"), (place["end"] - place["start"] + 1).cast("int"))
    turned = F.when(strand < 0, reverse_complement(cut)).otherwise(cut)
    return (turned == F.substr(window, (p0 + 1).cast("int"), (p1 - p0).cast("int"))) & (F.length(turned) == p1 - p0)


def signed_distance(anchor_s: Column, anchor_e: Column, s: Column, e: Column) -> Column:
    """Negative before the anchor, positive after, 0 if they overlap; both half-open."""
    return F.when(e <= anchor_s, e - anchor_s).when(s >= anchor_e, s - anchor_e).otherwise(F.lit(0))


def side_of(s: Column, e: Column, anchor_len: Column) -> Column:
    """In the anchor frame: upstream ends at or before 0, downstream starts at or after the anchor's end."""
    return F.when(e <= 0, "upstream").when(s >= anchor_len, "downstream").otherwise("overlaps")


def soft_pad(s: Column, e: Column, pad: int, length: Column) -> Column:
    return F.struct(F.greatest(F.lit(0), s - pad).alias("s"), F.least(length, e + pad).alias("e"))


def soft_case(seq: Column, mask: Column) -> Column:
    """Upper case outside the mask, lower case inside; the mask is sorted and disjoint."""
    step = F.aggregate(
        mask,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, m: F.struct(F.concat(acc["done"], F.upper(F.substr(seq, (acc["at"] + 1).cast("int"), (m["s"] - acc["at"]).cast("int"))), F.lower(F.substr(seq, (m["s"] + 1).cast("int"), (m["e"] - m["s"]).cast("int")))).alias("done"), m["e"].alias("at")),
    )
    return F.concat(step["done"], F.upper(F.substr(seq, (step["at"] + 1).cast("int"), F.length(seq))))
