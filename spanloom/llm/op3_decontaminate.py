"""Operator 3, benchmark decontamination by a prefix-filtered set join over item-sized windows.

A benchmark item is cut into windows of ``size`` consecutive words; a shorter item is one window.  A window's set are its
shingles of ``width`` consecutive words (or all its words, if fewer), ordered by rarity in the corpus: one pass counts, over
all documents, the shingles that the benchmark has.  As containment has to be complete, one *necessary* prefix shingle is
enough, the window's rarest.  A second pass finds the places of prefix shingles in the documents, with the words around
them, and these are joined with the windows by shingle.  The shingle's place in the window fixes where the window would
begin (positional bound), it has to lie inside the document (length bound), and what is left is verified word by word.

What is broadcast are two bitmaps of 2^``bits`` bits, one of all benchmark shingles and one of prefix shingles: their size
does not depend on the benchmark's, and they only keep other shingles out of the joins.  Nothing of the benchmark or of the
documents goes through the driver.  Equal texts share their result by digest, so copies are joined once per task.

Cases: null and empty texts have no words, hence no hit; null or empty items have no windows, items without an id are left
out.  Items with equal text are each reported; repeated item ids once.  Overlapping occurrences count each word once.  Ties
of rarity go to the smaller hash, then to the earlier place.  Texts and items of any length are taken whole.  Repeated
document rows are judged alike; an empty table or benchmark gives zero hits.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ids_of, materialize, pieces, release

#: A-Z to a-z; digits, letters and bytes of other scripts stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
WORDS_HELD = 200_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ (out >> np.uint64(29))) * _ODD[1] + hashes[i : i + n] * _ODD[0]
        out = (out ^ (out >> np.uint64(32))) * _ODD[2]
    return out ^ (out >> np.uint64(29))


def windows_of(benchmark: DataFrame, item: str, text: str, size: int, width: int) -> DataFrame:
    """item, words, shingles: a row per distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch, texts in pieces(batches, limit=500_000):
            for name, x in zip(ids_of(batch, "item").to_pylist(), texts, strict=True):
                words = words_of(x)
                held = sorted({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}) if words else []
                for i in range(0, len(held), 50_000):
                    part = held[i : i + 50_000]
                    hashed = [shingles(known.of(list(w)), min(width, len(w))).view(np.int64) for w in part]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([[v.decode() for v in w] for w in part], pa.list_(pa.string())), pa.array(hashed, pa.list_(pa.int64()))], names=["item", "words", "shingles"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")
    return rows.mapInArrow(run, "item string, words array<string>, shingles array<long>").distinct()


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits ranges of the hash space hold a shingle; at most 2^(bits - 5) numbers reach the driver."""
    place = F.shiftrightunsigned(F.col("shingle"), 64 - bits)
    rows = found.select(F.shiftright(place, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(31)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def held_in(some: np.ndarray, found: np.ndarray, bits: int) -> np.ndarray:
    place = found >> np.uint64(64 - bits)
    return (some[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def count_shingles(docs: DataFrame, some: np.ndarray, bits: int, widths: list[int]) -> DataFrame:
    """shingle, n: how often the shingles of the bitmap occur in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for _, texts in pieces(batches):
            hashed = [known.of(words_of(x)) for x in texts]
            found = np.concatenate([np.zeros(0, np.uint64), *(shingles(h, w) for h in hashed for w in widths)])
            name, n = np.unique(found[held_in(held.value, found, bits)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, windows: DataFrame, some: np.ndarray, bits: int, widths: list[int]) -> DataFrame:
    """item, words, shingle, place: each window's rarest shingle and where it stands in it."""
    placed = windows.select("item", "words", F.posexplode("shingles").alias("place", "shingle"))
    rare = placed.join(count_shingles(docs, some, bits, widths), "shingle", "left").select("item", "words", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place").alias("s"))
    return rare.groupBy("item", "words").agg(F.min("s").alias("s")).select("item", "words", "s.shingle", "s.place")


def places(docs: DataFrame, some: np.ndarray, bits: int, widths: list[int], size: int) -> DataFrame:
    """Per row: id, digest, words, and the places of prefix shingles with the words around them; of equal texts in a task one has places."""
    held = docs.sparkSession.sparkContext.broadcast(some)
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("shingle", pa.int64()), ("at", pa.int32()), ("near", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Hashes(), set()
        for batch, texts in pieces(batches):
            total, found = [], []
            digests = ids_of(batch, "digest")
            for digest, x in zip(digests.to_pylist(), texts, strict=True):
                words, own = words_of(x), []
                total.append(len(words))
                if words and digest not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(digest)
                    hashed = known.of(words)
                    for w in widths:
                        every = shingles(hashed, w)
                        hit = np.flatnonzero(held_in(held.value, every, bits))
                        for i, s in zip(hit.tolist(), every[hit].view(np.int64).tolist(), strict=True):
                            first = max(0, i - size + 1)
                            own.append({"pos": i, "shingle": s, "at": i - first, "near": [v.decode() for v in words[first : i + size]]})
                found.append(own or None)
            yield pa.RecordBatch.from_arrays([ids_of(batch), digests, pa.array(total, pa.int64()), pa.array(found, kind)], names=["doc_id", "digest", "n_words", "found"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_words long, found array<struct<pos:long,shingle:long,at:int,near:array<string>>>")


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, size: int, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, n_words) and verified occurrences (digest, start, n, item), each once."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.col(text).alias("text"))
    windows = materialize(windows_of(benchmark, item, item_text, size, width), "benchmark-windows")
    widths = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(width))).distinct().collect())
    every = bitmap(windows.select(F.explode("shingles").alias("shingle")), bits)
    prefix = materialize(prefixes(rows, windows, every, bits, widths), "benchmark-prefixes")
    release(windows)
    found = materialize(places(rows, bitmap(prefix.select("shingle"), bits), bits, widths, size), "benchmark-places")
    joined = found.where("found is not null").select("digest", F.explode("found").alias("f")).select("digest", "f.*").join(prefix, "shingle")
    first, n = F.col("at") - F.col("place"), F.size("words")
    inside = (first >= 0) & (first + n <= F.size("near"))
    met = joined.where(inside).where(F.slice("near", first + 1, n) == F.col("words"))
    hits = materialize(met.select("digest", (F.col("pos") - F.col("place")).alias("start"), n.alias("n"), "item").distinct(), "benchmark-hits")
    return found.select("doc_id", "digest", "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, width: int = 3, bits: int = 26) -> DataFrame:
    """Per row: words, hit words, items with occurring windows, and the spans of hit words."""
    rows, hits = occurrences(docs, benchmark, key, text, item, item_text, size, width, bits)
    places_hit = hits.select("digest", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("p")).distinct()
    island = F.col("p") - F.row_number().over(W.partitionBy("digest").orderBy("p"))
    runs = places_hit.withColumn("_i", island).groupBy("digest", "_i").agg(F.min("p").alias("start"), F.count(F.lit(1)).alias("words"))
    spans = runs.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"), F.sum("words").alias("n_hit"))
    items = hits.groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    met = materialize(spans.join(items, "digest").withColumnRenamed("digest", "_digest"), "benchmark-documents")
    out = rows.join(met, rows["digest"] == met["_digest"], "left")
    none = F.array().cast("array<struct<start:long,words:long>>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def keep(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, width: int = 3, bits: int = 26) -> DataFrame:
    """The rows in which no window of any item occurs, with all their columns."""
    _, hits = occurrences(docs, benchmark, key, text, item, item_text, size, width, bits)
    met = materialize(hits.select(F.col("digest").alias("_spanloom_digest")).distinct(), "benchmark-documents")
    return docs.join(met, digest_of(text) == F.col("_spanloom_digest"), "left_anti").select(*docs.columns)
