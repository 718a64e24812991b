"""Acceptance rules and geometry of hits, blocks and elements as Spark columns.  Defaults are the fixed thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_floor(length: Column, family: Column, floors: Mapping[str, float], default: float) -> Column:
    """Whether a row is long enough for the family that it was assigned to."""
    least = F.lit(default)
    for name, value in floors.items():
        least = F.when(family == name, F.lit(value)).otherwise(least)
    return length >= least


def homologous(identity: Column, share: Column, evalue: Column, least_identity: float = 0.30, least_share: float = 0.70, most_evalue: float = 1e-10) -> Column:
    return (identity >= least_identity) & (share >= least_share) & (evalue <= most_evalue)


def confidence(score: Column, floor: float = 0.80, high: float = 0.90) -> Column:
    """Null under the floor, else whether the score is high."""
    return F.when(score >= floor, score >= high)


def full_length_ungapped(gaps: Column, identity: Column, start: Column, end: Column, least_identity: float = 95.0, latest_start: int = 3, earliest_end: int = 118) -> Column:
    return (gaps == 0) & (identity >= least_identity) & (start <= latest_start) & (end >= earliest_end)


def insertion_origin(identity: Column, length: Column, block: Column, least_identity: float = 80.0, least_share: float = 0.5) -> Column:
    """Where a block lies by its best hit to the insertion sites; without sites (no identity) that is unknown."""
    inside = (identity >= least_identity) & (length >= least_share * block)
    return F.when(identity.isNull(), "unknown_no_sites").when(inside, "in_insertion").otherwise("host_flank")


def empty_allele_presence(identity: Column, coverage: Column, least_identity: float = 90.0, least_coverage: float = 0.5) -> Column:
    """Whether a candidate is in the host without the element; without an empty allele it is untested, not rejected."""
    there = (identity >= least_identity) & (coverage >= least_coverage)
    return F.when(identity.isNull(), "untested").when(there, "host_present_in_empty").otherwise("element_borne")


def abutting(score: Column, family: Column, gap: Column, spread: Column, least_score: float = 0.90, excluded: Sequence[str] = ("Cas3",), most_gap: int = 10, most_spread: float = 25) -> Column:
    """High-scoring blocks that keep one small distance to their anchor."""
    return (score >= least_score) & ~family.isin(*excluded) & (F.abs(gap) <= most_gap) & (spread <= most_spread)


def composite(*factors: Column, digits: int = 4) -> Column:
    """The product of a block's scores, rounded half to even."""
    out = factors[0]
    for x in factors[1:]:
        out = out * x
    return F.bround(out, digits)


def trimmed_reference(ref_s: Column, ref_e: Column, back: Column, strand: Column) -> Column:
    """The reference coordinate ``back`` bases into a segment, counted from its far end on the minus strand; truncated."""
    return F.when(strand == "-", ref_e - back.cast("int")).otherwise(ref_s + back.cast("int")).cast("bigint")


def insertion_point(s: Column, e: Column, at: Column, strand: Column) -> Column:
    """A place ``at`` bases into a hit, mirrored on the minus strand."""
    return F.when(strand == "-", e - at).otherwise(s + at).cast("bigint")


def dominant_side(before: Column, after: Column, least: float = 0.9) -> Column:
    """The side on which at least this share of a block's members lie, each against its own anchor."""
    return F.when(before >= least, "upstream").when(after >= least, "downstream").otherwise("mixed")


def block_distance(median_start: Column, anchor_len: Column) -> Column:
    """From a block's median start to the anchor: negative before it, 0 inside, else from its end; truncated."""
    return F.when(median_start < 0, median_start.cast("long")).otherwise(F.greatest(F.lit(0), (median_start - anchor_len).cast("long")))


def trimmed_window(seq: Column, offset: Column, anchor_len: Column, start: int, length: int) -> Column:
    """The window cut to [start, start + length) and the anchor's new offset; null where the anchor does not lie inside."""
    whole = (F.length(seq) >= start + length) & (offset >= start) & (offset + anchor_len <= start + length)
    cut = F.struct(F.substring(seq, start + 1, length).alias("seq"), (offset - start).cast("bigint").alias("offset"))
    return F.when(whole, cut)


def in_anchor_frame(pos: Column, anchor: Column) -> Column:
    return (pos - anchor).cast("bigint")


def hit_status(curated_evalue: Column, best_evalue: Column, gathering: float, lead: float) -> Column:
    """What is known of a bag by its sensitive hits: under the curated threshold, under a lenient one, or neither."""
    return F.when(curated_evalue <= gathering, "curated").when(best_evalue <= lead, "sub_threshold_lead").otherwise("orphan")
