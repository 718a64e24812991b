"""Operator 4, toxicity by FTRL-proximal logistic regression.

Features are hashed word uni- and bigrams and skip-grams over one and two words, present or not, in 2^``bits`` slots.
Training is follow-the-regularised-leader with per-coordinate rates; its L1 term leaves few weights other than zero,
which are broadcast in sparse form.  It runs over a bounded sample of labelled rows (``sample_rows`` per label at most,
in expectation), picked and ordered by hash of the id.  Their features are hashed where the texts are; the one training
task gets arrays of slots, and holds state only for slots that some row of the sample touches.  Scoring covers every row.

Cases: a null or empty text has no features and gets the bias' score.  Repeated words count once.  Rows whose label is
null are not learned from; repeated labels count each, and rows of equal hash are ordered by id, then by features.  Without
labelled rows every score is 0.5.  A text of any length is scored whole, in one piece of its own.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, ids_of, materialize, pieces

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Hash multipliers of the four kinds of features: a word, a pair, a pair over one word, a pair over two.
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
WORDS_HELD = 500_000


class Known(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Hasher:
    """Slots of features; each of the four kinds has a quarter of the 2^bits slots, so words collide with words only."""

    def __init__(self, bits: int):
        self.shift, self.quarter = np.uint64(64 - bits + 2), 1 << (bits - 2)
        self.known = Known()

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and where each text starts."""
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        look, parts, starts = self.known.__getitem__, [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            own = text.lower().encode("utf-8", "replace").translate(_FOLD).split() if text else []
            parts.append(np.fromiter(map(look, own), np.uint64, len(own)))
            starts[i + 1] = starts[i] + len(own)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts

    def features(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind: the rows and slots of its features."""
        row = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        with np.errstate(over="ignore"):
            first, out = words * _KINDS[0], [(row, ((words * _KINDS[0]) >> self.shift).astype(np.int64))]
            for gap in (1, 2, 3):
                if len(words) > gap:
                    same = row[gap:] == row[:-gap]
                    mixed = (first[:-gap] + words[gap:] * _KINDS[gap]) >> self.shift
                    out.append((row[:-gap][same], mixed[same].astype(np.int64) + gap * self.quarter))
        return out


class Ftrl:
    """Per-coordinate FTRL-proximal over ``size`` coordinates and a last one, the bias, which is not regularised."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def slots_of(hasher: Hasher, text: str | None) -> np.ndarray:
    """The distinct slots of a text's features, in order."""
    return np.unique(np.concatenate([s for _, s in hasher.features(*hasher.words([text]))])).astype(np.int32)


def train(examples: list[tuple[np.ndarray, int]], bits: int = 24, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, passes: int = 7, positive_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights other than zero, the bias last.  ``examples``: distinct slots and label of each row."""
    if not examples:
        return np.zeros(0, np.int64), np.zeros(0)
    touched = np.zeros(1 << bits, bool)
    for slots, _ in examples:
        touched[slots] = True
    names = np.flatnonzero(touched)
    del touched
    model = Ftrl(len(names), alpha, beta, l1, l2)
    own = [(np.append(np.searchsorted(names, slots), len(names)).astype(np.int32), int(label)) for slots, label in examples]
    for _ in range(passes):
        for at, label in own:
            model.learn(at, label, positive_weight if label else 1.0)
    kept, weights = [], []
    for i in range(0, len(names) + 1, 1 << 18):
        at = np.arange(i, min(len(names) + 1, i + (1 << 18)))
        w = model.weights(at)
        kept.append(at[w != 0])
        weights.append(w[w != 0])
    at = np.concatenate(kept)
    return np.append(names, 1 << bits)[at], np.concatenate(weights)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 6_000, bits: int = 24, **how: float) -> tuple[np.ndarray, np.ndarray]:
    """Fits on a bounded sample of ``labels``: about ``sample_rows`` rows of either label at most, and their texts."""
    rows = labels.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), (F.col(label).cast("double") > 0.5).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample_rows / counts.get(1, 1))).otherwise(min(1.0, sample_rows / counts.get(0, 1)))
    order = F.xxhash64(F.lit("toxicity sample"), F.col("doc_id"))
    sample = materialize(rows.withColumn("_order", order).where(F.pmod("_order", F.lit(1_000_000)) < share * 1_000_000), "toxicity-sample")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # the sample's bound keeps its ids under a megabyte; past that Spark chooses the join by the written table's size
    picked = texts.join(F.broadcast(sample) if sample.count() <= 4 * sample_rows else sample, "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch, held in pieces(batches):
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("_order", "doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([slots_of(hasher, x).tobytes() for x in held], pa.binary())], names=["_order", "doc_id", "label", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.frombuffer(x, np.int32), y) for batch in batches for x, y in zip(batch.column("slots").to_pylist(), batch.column("label").to_pylist(), strict=True)]
        slots, weights = train(examples, bits, **how)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(weights, pa.float64())], names=["slot", "weight"])

    features = picked.select("_order", "doc_id", "label", "text").mapInArrow(hashed, "_order long, doc_id long, label int, slots binary")
    model = features.repartition(1).sortWithinPartitions("_order", "doc_id", "slots").select("slots", "label").mapInArrow(run, "slot long, weight double").toPandas()
    return model["slot"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


class Scorer:
    """Scores from sparse weights; a small table of slot groups settles most features without a search."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray], bits: int, group: int = 4):
        self.hasher, self.group = Hasher(bits), group
        self.slots, self.weights = model[0], model[1]
        self.bias = float(self.weights[-1]) if len(self.slots) and self.slots[-1] == 1 << bits else 0.0
        self.some = np.zeros((1 << (bits - group)) + 1, bool)
        self.some[self.slots >> group] = True

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; every feature of a text counts once."""
        words, starts = self.hasher.words(texts)
        logit = np.full(len(texts), self.bias)
        for row, slot in self.hasher.features(words, starts):
            hit = np.flatnonzero(self.some[slot >> self.group])
            at = np.minimum(np.searchsorted(self.slots, slot[hit]), max(0, len(self.slots) - 1))
            sure = self.slots[at] == slot[hit] if len(hit) else np.zeros(0, bool)
            pairs = np.unique(row[hit][sure].astype(np.int64) * max(1, len(self.slots)) + at[sure])
            if len(pairs):
                logit += np.bincount(pairs // len(self.slots), self.weights[pairs % len(self.slots)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", bits: int = 24, threshold: float = 0.7) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value, bits)
        for batch, texts in pieces(batches):
            found = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([ids_of(batch), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", bits: int = 24, threshold: float = 0.7) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def verdicts() -> Callable[[list[str | None]], np.ndarray]:
        scorer = Scorer(held.value, bits)
        return lambda texts: scorer.score(texts) < threshold

    return filter_rows(docs, verdicts, text)
