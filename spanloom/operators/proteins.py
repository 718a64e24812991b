"""Reading frames and their proteins.

A frame goes from the first start codon after a stop to the next stop, on either strand; an approximation of a gene caller.
Coordinates are 0-based and half-open, on the sequence as it was read, stop codon included.  Starts and stops of all
frames come from one pass over the codons as arrays; letters other than ACGT make codons that neither start nor stop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bacterial code, codons in order of their letters TCAG, the last running fastest.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG")

_ORDER = "TCAG"
_number = {a + b + c: 16 * i + 4 * j + k for i, a in enumerate(_ORDER) for j, b in enumerate(_ORDER) for k, c in enumerate(_ORDER)}
_OTHER = 64
_LETTER = np.frombuffer(f"{AMINO_ACIDS}X".encode(), np.uint8)
_IS_STOP = _LETTER == ord("*")
_IS_START = np.isin(np.arange(65), [_number[c] for c in STARTS])
_CODE = np.full(256, 4, np.int64)
_CODE[np.frombuffer(_ORDER.encode(), np.uint8)] = np.arange(4)


def codons(codes: np.ndarray) -> np.ndarray:
    """The number of the codon that begins at each letter, 64 where one of its letters is none of ACGT."""
    a, b, c = (codes[o : max(0, len(codes) - 2) + o] for o in range(3))
    return np.where((a < 4) & (b < 4) & (c < 4), 16 * a + 4 * b + c, _OTHER)


def frames_of(seq: str, least: int) -> Iterator[tuple[int, int, int, str]]:
    """s, e, strand and protein of each frame of ``least`` or more bases; a start codon is read as M, the stop as nothing."""
    codes, n = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)], len(seq)
    # in the order TCAG the complement of T (0) is A (2), that of C (1) is G (3)
    for strand, own in ((1, codes), (-1, np.where(codes < 4, codes ^ 2, codes)[::-1])):
        every = codons(own)
        for shift in range(3):
            frame = every[shift::3]
            stops, starts = np.flatnonzero(_IS_STOP[frame]), np.flatnonzero(_IS_START[frame])
            if not len(stops) or not len(starts):
                continue
            place = np.searchsorted(starts, np.r_[-1, stops[:-1]], "right")
            first = starts[np.minimum(place, len(starts) - 1)]
            long = (place < len(starts)) & (first < stops) & (3 * (stops - first + 1) >= least)
            for i, j in zip(first[long].tolist(), stops[long].tolist(), strict=True):
                s, e = shift + 3 * i, shift + 3 * j + 3
                yield (s, e, 1, "M" + _LETTER[frame[i + 1 : j]].tobytes().decode()) if strand > 0 else (n - e, n - s, -1, "M" + _LETTER[frame[i + 1 : j]].tobytes().decode())


def open_frames(rows: DataFrame, key: str, seq: str, least: int) -> DataFrame:
    """id, s, e, strand, protein; frames of repeated rows of an id that have equal coordinates are collapsed.

    Null and empty sequences have no frames.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *x) for i, s in zip(batch["id"], batch["seq"], strict=True) if isinstance(s, str) for x in frames_of(s, least)]
            yield pd.DataFrame(found, columns=["id", "s", "e", "strand", "protein"]).astype({"s": "int64", "e": "int64", "strand": "int32"})

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("id"), F.col(seq).alias("seq")).where("seq is not null").mapInPandas(run, f"id {kind}, s long, e long, strand int, protein string")
    return found.groupBy("id", "s", "e", "strand").agg(F.min("protein").alias("protein"))


def query_proteins(rows: DataFrame, bag: str, key: str, seq: str, least: int = 60, most: int = 3, seed: int = 1) -> DataFrame:
    """bag, id, s, e, strand, protein: up to ``most`` representatives among a bag's proteins of ``least`` or more letters.

    All of a bag that has no more; rows without a bag or an id are left out.
    """
    from .sampling import sample_groups

    bags = rows.select(F.col(bag).alias("bag"), F.col(key).alias("id")).where("bag is not null and id is not null").distinct()
    found = open_frames(rows, key, seq, 3 * (least + 1)).join(bags, "id")
    named = found.withColumn("name", F.concat_ws(":", "id", "s", "e", "strand")).withColumn("size", F.length("protein"))
    kept = sample_groups(named, "bag", "name", "protein", "size", most, seed, "representatives").withColumnRenamed("id", "name")
    return named.join(kept, ["bag", "name"], "left_semi").select("bag", "id", "s", "e", "strand", "protein")
