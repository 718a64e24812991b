"""Operator 1, language ID by compression.

Each language gets a zstandard *raw-content* dictionary from a bounded sample of its labelled texts.  A text is cut
into blocks, every block is compressed with every language's dictionary, and the language whose dictionary gives the
smallest total wins.  Blocks keep the dictionary's help in proportion on long texts, which would otherwise serve as
their own dictionary.  A narrow margin is reported as ``rejected``.

The model's sample has one bound, ``passages``: all labelled texts, whole, are cut into passages of ``passage_chars`` code
points, and about so many of a language's passages are chosen by hash, wherever in a text they stand.  All that are chosen
make the dictionary, so it does not depend on row order, partitions or the length of texts.

Cases: a null text, an empty one and one without letters give ``und``, score 0.0, not rejected.  A text of any length is
compressed whole.  Ties go to the language with the smaller code.  Repeated rows are judged one by one; repeated passages
stand in a dictionary once.  An empty table gives an empty result.  With no labelled rows every text is ``und``.  Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, pieces

_LETTER = regex.compile(r"\p{L}")
#: A-Z to a-z, other ASCII than letters to a space; bytes of other scripts stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower case UTF-8 with every run of other ASCII characters than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def fit_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", passages: int = 200, passage_chars: int = 1000) -> dict[str, bytes]:
    """Raw dictionary contents by language, from about ``passages`` passages of each."""
    rows = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text <> ''")
    rows = rows.withColumn("_n", F.ceil(F.length("text") / passage_chars))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum("_n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, passages / n))) for k, n in sorted(counts.items())], F.lit(0.0))
    order = lambda i: F.xxhash64(F.lit("language sample"), F.col("key"), i)
    chosen = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.pmod(order(i), F.lit(1 << 40)) < F.col("_share"))
    picked = rows.withColumn("_share", share * (1 << 40)).select("lang", "text", "key", F.explode(chosen).alias("i"))
    sample = picked.select("lang", F.substr("text", (F.col("i") * passage_chars + 1).cast("int"), F.lit(passage_chars)).alias("text"), order(F.col("i")).alias("_order")).collect()
    held: dict[str, dict[bytes, None]] = {}
    for row in sorted(sample, key=lambda r: (r["_order"], r["text"])):
        held.setdefault(row["lang"], {})[normalise(row["text"])] = None
    return {k: b" ".join(v) for k, v in sorted(held.items())}


class Classifier:
    """One compressor per language, with matches from four bytes up."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 8000):
        self.langs, self.block, self.coders = sorted(dictionaries), block, []
        for k in self.langs:
            held = zstandard.ZstdCompressionDict(dictionaries[k].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            log = max(17, len(dictionaries[k]).bit_length())
            how = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log - 2, chain_log=log - 2, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0)
            held.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=held))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text per language."""
        clean = normalise(text)
        blocks = [clean[i : i + self.block] for i in range(0, len(clean), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.coders], dtype=float)

    def classify(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0, False
        size = self.sizes(text)
        best = int(size.argmin())
        gap = np.minimum((size - size[best]) * 2.0, 700)
        score = float(1 / np.exp2(-gap).sum())
        rest = np.delete(size, best)
        narrow = bool(len(rest) and rest.min() - size[best] < margin * size[best])
        return self.langs[best], score, narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score (share of the winner under 2^-bytes·2 weights), rejected (margin under ``margin``)."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(held.value)
        for batch, texts in pieces(batches):
            found = [model.classify(x, margin) for x in texts]
            yield pa.RecordBatch.from_arrays([ids_of(batch), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
