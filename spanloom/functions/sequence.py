"""Sequence functions as Spark columns: everything stays in generated code, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide codes and their complements, both cases.
IUPAC = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENT = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def windows(seq: Column, k: int) -> Column:
    """All stretches of ``k`` letters in order, in one pass over the sequence; none if it is shorter."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def kmers(seq: Column, k: int = 5) -> Column:
    """Distinct k-mers in order of appearance; a shorter string is its own token."""
    return F.when(F.length(seq) >= k, F.array_distinct(windows(seq, k))).otherwise(F.array(seq))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    shared = F.array(F.size(F.array_intersect(a, b)))
    share = F.transform(shared, lambda n: n / (F.size(a) + F.size(b) - n))[0]
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def tie_key(seed: str | int, key: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    hits = F.length(seq) - F.length(F.regexp_replace(seq, "[GCgc]", ""))
    return F.when(F.length(seq) > 0, hits / F.length(seq))


def identity(a: Column, b: Column) -> Column:
    """Equal columns over columns where not both rows have a gap; 0 if there are none."""
    cells = lambda x: F.split(x, "")
    used = F.aggregate(F.zip_with(cells(a), cells(b), lambda x, y: F.when((x == "-") & (y == "-"), 0).otherwise(1)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    same = F.aggregate(F.zip_with(cells(a), cells(b), lambda x, y: F.when((x == y) & (x != "-"), 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(used > 0, same / used).otherwise(F.lit(0.0))
