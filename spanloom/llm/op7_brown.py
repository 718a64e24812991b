"""Operator 7, language-model scores by Brown class-based bigrams.

Every word belongs to a *unit*: each of the most frequent words is one, all others share units by a hash of their ending.
Exchange clustering moves the ``frequent`` first words and the endings between classes while the class-bigram likelihood of
the training texts grows; the ``extended`` next words then each go to the class that makes their own neighbours likeliest.
A text's probability is the product over its tokens of class transition, unit given class and word given unit, all
smoothed, so every word has a probability, seen or not.

One pass over the texts leaves, per piece of the table, its word numbers and the hashes of its vocabulary; texts are never
shuffled.  Vocabularies are cut into ranges of the hash space.  A range's task sums the training counts of its words over
all pieces, exactly, and returns each piece the counts of its words.  A word takes one entry per piece however often it
occurs, so frequent words do not make a range hot, and nothing of a vocabulary is broadcast but its ``frequent`` and
``extended`` most frequent words.  Tables of unit pairs are bounded by the number of units, of class pairs by that of
classes.  All counts are sums over pieces, so no result depends on partitions or batches.

Cases: a null or empty text is the end token alone.  Rows without an id are training rows.  A text of any length is in one
piece, by itself if need be.  Repeated rows count each.  Ties of frequency go to the smaller hash, ties of the exchange to
the class of the smaller number, and a word that gains nothing stays.  An empty table gives an empty result; without
training rows every token is unknown.  Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_of, materialize, pieces, release

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_"
#: Pairs that a task holds before it reports them.
PAIRS_HELD = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def ending_of(word: bytes, endings: int) -> int:
    return xxhash.xxh3_64_intdigest((word.rstrip(_EDGE) or word)[-3:]) % endings


def read_pieces(rows: DataFrame, endings: int, piece_bytes: int) -> DataFrame:
    """Per piece: its rows, their word numbers, and the vocabulary in order of its hashes with endings and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece = TaskContext.get().partitionId(), 0
        for batch, texts in pieces(batches, limit=piece_bytes):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            parts = [words_of(x) for x in texts]
            size = np.array([len(x) for x in parts], np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in parts)])
            hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            ending = np.fromiter((ending_of(w, endings) for w in number), np.uint16, len(number))
            out = np.asarray(ids_of(batch, "held_out").to_pylist(), bool)
            trained = np.bincount(ids, np.repeat(~out, size), minlength=len(number)).astype(np.uint32)
            order = np.argsort(hashed, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            own = [(task << 32) + piece, ids_of(batch).to_pylist(), out.tolist(), size.tolist(), place[ids].tobytes(), hashed[order].tobytes(), ending[order].tobytes(), trained[order].tobytes()]
            piece += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(own, kinds, strict=True)], names=["piece", "doc_id", "held_out", "size", "ids", "hash", "ending", "trained"])

    return materialize(rows.mapInArrow(run, "piece long, doc_id array<long>, held_out array<boolean>, size array<long>, ids binary, hash binary, ending binary, trained binary"), "brown-pieces")


def deal(ranges: int):  # noqa: ANN201
    """A piece's vocabulary to one row per range of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for piece, hashed, ending, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashed, ending, trained = np.frombuffer(hashed, np.uint64), np.frombuffer(ending, np.uint16), np.frombuffer(trained, np.uint32)
                edge = np.searchsorted(((hashed >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    part = slice(edge[p], edge[p + 1])
                    for x, y in zip(out, (piece, p, hashed[part].tobytes(), ending[part].tobytes(), trained[part].tobytes()), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["piece", "range", "hash", "ending", "trained"])

    return run


def count_range(endings: int, most: int):  # noqa: ANN201
    """One hash range: each piece's words' counts over all pieces, the ``most`` most frequent words, and sums by ending."""

    def run(whole: pa.Table) -> pa.Table:
        whole = whole.sort_by("piece")
        hashed = [np.frombuffer(x, np.uint64) for x in whole.column("hash").to_pylist()]
        trained = np.concatenate([np.frombuffer(x, np.uint32) for x in whole.column("trained").to_pylist()])
        ending = np.concatenate([np.frombuffer(x, np.uint16) for x in whole.column("ending").to_pylist()])
        name, first, inverse = np.unique(np.concatenate(hashed), return_index=True, return_inverse=True)
        count = np.bincount(inverse, trained, minlength=len(name)).astype(np.int64)
        ending = ending[first]
        top = np.lexsort((name.view(np.int64), -count))[:most]
        top = top[count[top] > 0]
        sums = np.bincount(ending, count, minlength=endings).astype(np.int64)
        kinds = np.bincount(ending[count > 0], minlength=endings)
        edge = np.cumsum([0, *(len(x) for x in hashed)])
        own = count[inverse]
        columns = [[*whole.column("piece").to_pylist(), -1], [whole.column("range")[0].as_py()] * (len(hashed) + 1), [*(own[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)), count[top].tobytes()]]
        columns += [[None] * len(hashed) + [x] for x in (name[top].tobytes(), ending[top].tobytes(), sums.tolist(), kinds.tolist())]
        kinds_of = (pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds_of, strict=True)], names=["piece", "range", "counts", "hash", "ending", "sums", "kinds"])

    return run


def top_words(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, training counts and endings of the most frequent words, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, hashed, ending in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashed, np.int64)), pa.array(np.frombuffer(counts, np.int64)), pa.array(np.frombuffer(ending, np.uint16).astype(np.int32))], names=["hash", "n", "ending"])

    found = counted.where("piece < 0").select("counts", "hash", "ending").mapInArrow(run, "hash long, n long, ending int")
    rows = found.orderBy(F.desc("n"), "hash").limit(most).toArrow()
    return rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy(), rows.column("ending").to_numpy().astype(np.int64)


class Units:
    """Numbers of units: 0 the end, then the frequent words, then the endings, then the extended words."""

    def __init__(self, hashed: np.ndarray, frequent: int, endings: int):
        self.frequent, self.endings = min(frequent, len(hashed)), endings
        self.first_ending, self.exchanged = self.frequent + 1, self.frequent + 1 + endings
        self.count = self.exchanged + len(hashed) - self.frequent
        number = np.arange(1, len(hashed) + 1)
        number[self.frequent :] += endings
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.number = hashed[order], number[order]

    def of(self, hashed: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """Units of a vocabulary."""
        out = self.first_ending + ending.astype(np.int64)
        if len(self.hashed):
            at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
            hit = self.hashed[at] == hashed
            out[hit] = self.number[at[hit]]
        return out


def sequence_of(unit: np.ndarray, ids: bytes, size: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' units with the end (0) after each, and where each row starts, one more at the end."""
    starts = np.r_[0, np.cumsum(np.array(size, np.int64) + 1)]
    sequence = np.zeros(starts[-1], np.int64)
    mask = np.ones(starts[-1], bool)
    mask[starts[1:] - 1] = False
    sequence[mask] = unit[np.frombuffer(ids, np.uint32)]
    return sequence, starts


def pairs_of(table: DataFrame, units: Units, kind: np.ndarray, width: int, word: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbours in training rows, the end standing before a first word too: number a * width + b, and n.

    ``kind`` gives a unit's number.  With ``word``, a is an extended word and b its neighbour's, the ones after it coming
    ``width`` / 2 later than the ones before it.
    """
    held = table.sparkSession.sparkContext.broadcast((units, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, kind = held.value
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for out, size, ids, hashed, ending in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sequence, starts = sequence_of(units.of(np.frombuffer(hashed, np.uint64), np.frombuffer(ending, np.uint16)), ids, size)
                keep = np.repeat(~np.array(out, bool), np.diff(starts))
                before = np.r_[0, sequence[:-1]]
                a, b = before[keep], sequence[keep]
                if word:
                    left, right = b >= units.exchanged, a >= units.exchanged
                    found = np.concatenate(((b[left] - units.exchanged) * width + kind[a[left]], (a[right] - units.exchanged) * width + width // 2 + kind[b[right]]))
                else:
                    found = kind[a] * width + kind[b]
                found, times = np.unique(found, return_counts=True)
                pair, inverse = np.unique(np.concatenate((pair, found)), return_inverse=True)
                n = np.bincount(inverse, np.concatenate((n, times)), minlength=len(pair)).astype(np.int64)
                if len(pair) > PAIRS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                    pair, n = pair[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    found = table.select("held_out", "size", "ids", "hash", "ending").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    return found.column("pair").to_numpy(), found.column("n").to_numpy()


class Bigrams:
    """Unit pairs by either side, for the exchange."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, units: int):
        self.a, self.b, self.n, self.units = a.astype(np.int32), b.astype(np.int32), n.astype(float), units
        self.by_a, self.by_b = (np.argsort(x, kind="stable").astype(np.int32) for x in (self.a, self.b))
        self.edge_a, self.edge_b = (np.r_[0, np.cumsum(np.bincount(x, minlength=units))] for x in (a, b))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.a, self.n, self.units), np.bincount(self.b, self.n, self.units)

    def about(self, u: int, own: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Counts of a unit by the class after it and before it, without itself, and with itself."""
        after, before = self.by_a[self.edge_a[u] : self.edge_a[u + 1]], self.by_b[self.edge_b[u] : self.edge_b[u + 1]]
        itself = float(self.n[after][self.b[after] == u].sum())
        out, into = np.bincount(own[self.b[after]], self.n[after], classes), np.bincount(own[self.a[before]], self.n[before], classes)
        out[own[u]] -= itself
        into[own[u]] -= itself
        return out, into, itself


def exchange(bigrams: Bigrams, classes: int, passes: int = 6) -> np.ndarray:
    """Class of each unit.  Units start dealt out by frequency; each in turn moves to the class of highest likelihood."""
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    total = sum(bigrams.sums())
    order = np.argsort(-total, kind="stable")
    order = order[order != 0]
    own = np.zeros(bigrams.units, np.int64)  # the end keeps class 0 for itself
    own[order] = 1 + np.arange(len(order)) % (classes - 1)
    pair = np.bincount(own[bigrams.a] * classes + own[bigrams.b], bigrams.n, classes * classes).reshape(classes, classes)
    for _ in range(passes):
        moved = 0
        for u in order.tolist():
            if not total[u]:
                break
            k = own[u]
            out, into, itself = bigrams.about(u, own, classes)
            pair[k] -= out
            pair[:, k] -= into
            pair[k, k] -= itself
            left, right = pair.sum(1) + into, pair.sum(0) + out  # the unit's neighbours keep their own sums
            at, to = np.flatnonzero(out), np.flatnonzero(into)
            gain = (f(pair[:, at] + out[at]) - f(pair[:, at])).sum(1) + (f(pair[to] + into[to, None]) - f(pair[to])).sum(0)
            d = np.arange(classes)
            diagonal = pair[d, d]
            gain += f(diagonal + out[d] + into[d] + itself) - f(diagonal + out[d]) - f(diagonal + into[d]) + f(diagonal)
            gain -= f(left + out.sum() + itself) - f(left) + f(right + into.sum() + itself) - f(right)
            gain[0] = -np.inf
            best = int(gain.argmax())
            best = best if gain[best] > gain[k] + 1e-9 else k
            pair[best] += out
            pair[:, best] += into
            pair[best, best] += itself
            moved += best != k
            own[u] = best
        if not moved:
            break
    return own


def transitions(pair: np.ndarray, pull: float = 10.0) -> np.ndarray:
    """Log10 probabilities of the class after a class, drawn to that of the class alone."""
    alone = (pair.sum(0) + 1) / (pair.sum() + len(pair))
    return np.log10((pair + pull * alone) / (pair.sum(1, keepdims=True) + pull))


def assign(about: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class of each further word.  ``about``: a row per word, counts of the class before it, then of the class after it."""
    classes = len(pair)
    before, after = about[:, :classes], about[:, classes:]
    step = transitions(pair)
    size = np.log10(pair.sum(0) + 1)
    gain = before @ step + after @ step.T - before.sum(1, keepdims=True) * size
    gain[:, 0] = -np.inf
    return gain.argmax(1)


class Model:
    """Log10 probabilities of class transitions and of units, from training counts."""

    def __init__(self, units: Units, own: np.ndarray, pair: np.ndarray, unit: np.ndarray, kinds: np.ndarray):
        """``unit``: training tokens of each unit; ``kinds``: distinct training words of each ending."""
        classes = len(pair)
        self.units, self.own, self.transition = units, own, transitions(pair)
        size = np.bincount(own, unit, classes)
        ends = slice(units.first_ending, units.exchanged)
        self.emission = np.log10((unit + 0.5) / (size + 0.5 * np.bincount(own, minlength=classes))[own])
        self.emission[ends] -= np.log10(unit[ends] + kinds + 1)  # then (c + 1) follows per word
        self.shared = np.zeros(units.count, bool)
        self.shared[ends] = True
        self.ends, self.tokens = float(unit[0]), int(unit.sum())
        self.distinct = int((unit[~self.shared] > 0).sum() + kinds.sum())


def fit(table: DataFrame, counted: DataFrame, frequent: int, extended: int, endings: int, classes: int) -> Model:
    """Units, classes and probabilities from pieces and counts."""
    hashed, n, ending = top_words(counted, frequent + extended)
    units = Units(hashed, frequent, endings)
    sums = counted.where("piece < 0").select(F.posexplode("sums").alias("at", "n"), "kinds").select("at", "n", F.get("kinds", F.col("at")).alias("k")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()
    tokens, kinds = np.zeros(endings), np.zeros(endings)
    for r in sums:
        tokens[r["at"]], kinds[r["at"]] = r["n"], r["k"]
    tokens -= np.bincount(ending, n, endings)
    kinds -= np.bincount(ending, minlength=endings)
    shared = np.arange(units.count)
    shared[units.exchanged :] = units.first_ending + ending[units.frequent :]
    pair, times = pairs_of(table, units, shared, units.exchanged)
    bigrams = Bigrams(pair // units.exchanged, pair % units.exchanged, times, units.exchanged)
    own = exchange(bigrams, classes)
    ends = bigrams.sums()[1][0]
    if units.count > units.exchanged:
        coarse = np.bincount(own[bigrams.a] * classes + own[bigrams.b], bigrams.n, classes * classes).reshape(classes, classes)
        at, times = pairs_of(table, units, own[shared], 2 * classes, word=True)
        about = np.bincount(at, times, (units.count - units.exchanged) * 2 * classes).reshape(-1, 2 * classes)
        own = np.r_[own, assign(about, coarse)]
    pair, times = pairs_of(table, units, own, classes)
    return Model(units, own, np.bincount(pair, times, classes * classes).reshape(classes, classes), np.r_[ends, n[: units.frequent], tokens, n[units.frequent :]].astype(float), kinds)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", frequent: int = 2_048, extended: int = 30_000, endings: int = 511, classes: int = 48, range_bytes: int = 32_000_000, piece_bytes: int = 12_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = read_pieces(rows, endings, piece_bytes)
    dealt = table.select("piece", "hash", "ending", "trained").mapInArrow(deal(max(24, -(-size // range_bytes))), "piece long, range int, hash binary, ending binary, trained binary")
    kind = "piece long, range int, counts binary, hash binary, ending binary, sums array<long>, kinds array<long>"
    counted = materialize(dealt.groupBy("range").applyInArrow(count_range(endings, frequent + extended), kind), "brown-ranges")
    held = docs.sparkSession.sparkContext.broadcast(fit(table, counted, frequent, extended, endings, classes))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        model, columns = held.value, [[] for _ in range(6)]
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in right.sort_by("range").column("counts").to_pylist())])
        for ids, out, size, words, hashed, ending in zip(*(left.column(c).to_pylist() for c in ("doc_id", "held_out", "size", "ids", "hash", "ending")), strict=True):
            unit = model.units.of(np.frombuffer(hashed, np.uint64), np.frombuffer(ending, np.uint16))
            sequence, starts = sequence_of(unit, words, size)
            base = np.full(len(sequence), np.log10(model.ends + 1))
            known, local = np.full(len(sequence), int(model.ends > 0)), model.emission[sequence]
            mask = np.ones(len(sequence), bool)
            mask[starts[1:] - 1] = False
            c = counts[np.frombuffer(words, np.uint32)]
            base[mask], known[mask] = np.log10(c + 1), c > 0
            local += base * model.shared[sequence]
            local += model.transition[model.own[np.r_[0, sequence[:-1]]], model.own[sequence]]
            per_row = lambda x: np.add.reduceat(x, starts[:-1]).tolist()
            n = np.diff(starts)
            for x, y in zip(columns, (ids, out, n.tolist(), per_row(known.astype(np.int64)), (np.add.reduceat(base, starts[:-1]) - n * np.log10(model.tokens + model.distinct + 1)).tolist(), per_row(local)), strict=True):
                x += y
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    left = table.select("piece", "doc_id", "held_out", "size", "ids", "hash", "ending").groupBy("piece")
    right = counted.where("piece >= 0").select(F.col("piece").alias("_piece"), "range", "counts").groupBy("_piece")
    found = left.cogroup(right).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    tokens = held.value.tokens
    return found.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
