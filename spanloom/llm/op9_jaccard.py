"""Operator 9, exact Jaccard join of documents as sets of word n-grams, by pivots and triangle-inequality windows.

Jaccard distance is a metric; two documents link within the radius r = 1 - similarity.

* Reduction.  A document can only be linked if most of its shingles occur in another document too.  One pass deals all
  shingles into blocks of the hash space; a block finds those that occur twice and sends them back, with the order of
  magnitude of their count.  Only documents with enough of them stay *open*, and their reduced sets, which hold the shared
  shingles from rare to frequent, are enough for every later distance.  Shingles that a bounded sample shows to be very
  frequent take no part in the deal, so no block gets a hot one.
* Level 1.  A bounded number of *pivots*, open documents more than 2r apart, is broadcast.  Every open document computes
  its exact distance to all of them.  Within 2r of a pivot it lies in the Voronoi region of its nearest one, else in the
  outer region; one within r of its pivot is linked to it.  By the triangle inequality a boundary document is replicated
  into each region where it can have a partner: those of pivots within 2r of its nearest distance and within r of the
  region's radius, the greatest distance of its own documents; and the outer one unless a pivot is within r.  A pair of two
  own regions is in reach in both and meets in the lesser one, so regions greater than the own one hold no copies.
* Next levels.  A region is divided by the shingles that a link makes necessary, and each such list has pivots of its own,
  its most central documents: the others are compared with those first, level by level with more of them, and what links
  becomes one component.  Pairs inside one component are never made, which settles large groups of copies.
* Last level.  What is left, pairs of different components inside a list, passes the length and positional bounds and is
  compared exactly.

Sets meet in parts of bounded size and are compared whole.  Components of the links are found by star contraction.
Shingles and exact-set classes are 64-bit hashes.  Documents with equal sets are one class and are compared once.

Cases: a null or empty text, or one without words, has an empty set and is its own component.  A text of fewer words than
``width`` is one shingle.  A very long text is one set like others; sets of over ``pivot_shingles`` / 100 shingles are not
used as pivots, which affects no link.  Ties between centres of a list go to the smaller class.  Repeated rows fall into
one class.  An empty table gives an empty result; other columns are ignored.  Rows with a null id take part like others
and are never the smallest id of a component with one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ids_of, materialize, pieces, release, tidy
from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
WORDS_HELD = 200_000
#: Shingles travel as their block of the hash space and their low bits.
LOW = np.uint64(48)
#: Documents in a message, so that 16 bits number them; order of the shingles that the sample shows to be frequent.
MESSAGE_ROWS, FREQUENT = 60_000, 63
#: The region of documents that no pivot is near; what distances may be off by rounding.
OUTER, SLACK = -1, 1e-9


class Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int):
        self.width, self.known = width, Known()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        look, width, out = self.known.__getitem__, self.width, []
        parts = []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
            parts.append(np.fromiter(map(look, words), np.uint64, len(words)))
        sizes = np.array([len(x) for x in parts], np.int64)
        every = np.concatenate([*parts, np.zeros(width, np.uint64)])
        starts = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            full = np.zeros(len(every) - width + 1, np.uint64)
            for i in range(width):
                full += every[i : i + len(full)] * _MIX[i]
            full = _finish(full, width)
            for n, s, own in zip(sizes.tolist(), starts.tolist(), parts, strict=True):
                if n >= width:
                    found = np.sort(full[s : s + n - width + 1])
                    if n > width:
                        found = found[np.r_[True, found[1:] != found[:-1]]]
                    out.append(found)
                else:
                    out.append(_finish((own * _MIX[:n]).sum(keepdims=True), n) if n else own)
        return out


def _finish(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[5] + np.uint64(n)
    x = (x ^ (x >> np.uint64(29))) * _MIX[6]
    return x ^ (x >> np.uint64(32))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def block_of(token: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of the hash space, so sorted shingles are sorted by block."""
    return ((token >> LOW) * np.uint64(blocks)) >> np.uint64(16)


def name_of(token: np.ndarray, blocks: int) -> np.ndarray:
    """What stands for a shingle from the deal on."""
    return (block_of(token, blocks) << LOW) | (token & np.uint64((1 << 48) - 1))


def pack(token: np.ndarray) -> bytes:
    """The low bits, six bytes each."""
    return token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(held, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def frequent_shingles(rows: DataFrame, share: float, width: int, least: int, most: int) -> np.ndarray:
    """Shingles that at least ``least`` distinct sets of a sample hold, the ``most`` most frequent of them; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for _, texts in pieces(batches):
            found = shingler.sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["class", "tokens"])

    picked = rows.where(F.pmod(F.xxhash64(F.lit("shingle sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    sets = picked.mapInArrow(run, "class long, tokens array<long>").dropDuplicates(["class"])
    counted = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["token"] for r in counted.orderBy(F.desc("n"), "token").limit(most).collect()], np.int64).view(np.uint64))


def send(width: int, blocks: int, frequent: Callable[[], np.ndarray], message_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to messages: a header with a message's documents and their frequent shingles, and a row per block with others.

    Headers are dealt out by block numbers past the last.  Of equal sets in a task only one has its shingles sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, known = Shingler(width), set(), frequent()
        task, number, rows, sets, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.uint16)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            hot = known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every if len(known) else np.zeros(len(every), bool)
            name = (task << 32) + number
            out: list[list] = [[blocks + (31 * task + number) % (1 << 20)], [name], *([[x] for x in zip(*rows, strict=True)]), [pack(name_of(every[hot], blocks))], [owner[hot].tobytes()], [block_of(every[hot], blocks).astype(np.uint16).tobytes()]]
            every, owner = every[~hot], owner[~hot]
            edge = np.searchsorted(block_of(every, blocks), np.arange(blocks + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                part = slice(edge[b], edge[b + 1])
                for x, y in zip(out, (b, name, None, None, None, pack(every[part]), owner[part].tobytes(), None), strict=True):
                    x.append(y)
            kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["block", "message", "doc_id", "class", "n", "token", "owner", "order"])

        for batch, texts in pieces(batches):
            for doc, found in zip(ids_of(batch).to_pylist(), shingler.sets(texts), strict=True):
                own = class_of(found)
                fresh = own not in seen
                if fresh:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(own)
                rows.append((doc, own, len(found)))
                sets.append(found if fresh else found[:0])
                held += len(sets[-1])
                if held >= message_tokens or len(rows) >= MESSAGE_ROWS:
                    yield flush()
                    number, rows, sets, held = number + 1, [], [], 0
        if rows:
            yield flush()

    return run


def shared_in_block(blocks: int) -> Callable[[pa.Table], pa.Table]:
    """A block's shingles that occur twice or more, to the messages they came from; ``order`` is the size of their count."""

    def run(whole: pa.Table) -> pa.Table:
        block = whole.column("block")[0].as_py()
        if block >= blocks:
            return whole
        token = np.concatenate([unpack(x) for x in whole.column("token").to_pylist()])
        sizes = [len(x) // 2 for x in whole.column("owner").to_pylist()]
        order = np.argsort(token, kind="stable")
        first = np.flatnonzero(np.r_[True, token[order][1:] != token[order][:-1]])
        many = np.diff(np.r_[first, len(token)])
        rank = np.empty(len(token), np.uint8)
        rank[order] = np.repeat(np.minimum(np.frexp(many)[1], FREQUENT - 1) * (many > 1), many)
        out: list[list] = [[] for _ in range(4)]
        start = 0
        for message, size, owner in zip(whole.column("message").to_pylist(), sizes, whole.column("owner").to_pylist(), strict=True):
            at = np.flatnonzero(rank[start : start + size])
            if len(at):
                for x, y in zip(out, (message, pack(token[start + at]), np.frombuffer(owner, np.uint16)[at].tobytes(), rank[start + at].tobytes()), strict=True):
                    x.append(y)
            start += size
        none = pa.nulls(len(out[0]), pa.list_(pa.int64()))
        return pa.table([pa.array([block] * len(out[0]), pa.int32()), pa.array(out[0], pa.int64()), none, none, none, *(pa.array(x, pa.binary()) for x in out[1:])], names=["block", "message", "doc_id", "class", "n", "token", "owner", "order"])

    return run


def reduced_sets(blocks: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """A message's documents: id, class, n and, where enough shingles are shared for any link, those, rare ones first."""

    def run(whole: pa.Table) -> pa.Table:
        columns = {c: whole.column(c).to_pylist() for c in whole.column_names}
        head = columns["doc_id"].index(next(x for x in columns["doc_id"] if x is not None))
        ids, classes, n = (columns[c][head] for c in ("doc_id", "class", "n"))
        token, owner, order = [], [], []
        for i, block in enumerate(columns["block"]):
            low = unpack(columns["token"][i])
            owner.append(np.frombuffer(columns["owner"][i], np.uint16))
            if i == head:
                token.append((np.frombuffer(columns["order"][i], np.uint16).astype(np.uint64) << LOW) | low)
                order.append(np.full(len(low), FREQUENT, np.uint8))
            else:
                token.append((np.uint64(block) << LOW) | low)
                order.append(np.frombuffer(columns["order"][i], np.uint8))
        token, owner, order = np.concatenate(token), np.concatenate(owner), np.concatenate(order)
        size = np.array(n, np.int64)
        shared = np.bincount(owner, minlength=len(size))
        keep = (shared > 0) & (100 * shared >= percent * size)
        token, owner, order = token[keep[owner]], owner[keep[owner]], order[keep[owner]]
        token = token[np.lexsort((token, order, owner))].view(np.int64)
        offset = np.r_[0, np.cumsum(np.where(keep, shared, 0))]
        lists = [token[offset[i] : offset[i + 1]] if keep[i] else None for i in range(len(size))]
        return pa.table([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "class", "n", "tokens"])

    return run


def pick_pivots(sets: DataFrame, percent: int, pivots: int, pivot_shingles: int) -> list[tuple[int, int, np.ndarray]]:
    """Class, n and tokens of up to ``pivots`` open documents in order of a hash, each over 2r from those before it."""
    held: list[tuple[int, int, np.ndarray]] = []
    if 3 * percent <= 200 or not pivots:  # windows would hold everything
        return held
    holders: dict[int, list[int]] = {}
    left = pivot_shingles
    for r in sets.where(F.col("n") <= pivot_shingles // 100).orderBy(F.xxhash64(F.lit("pivot"), "class"), "class").limit(pivots).toLocalIterator():
        shared: dict[int, int] = {}
        for t in r["tokens"]:
            for p in holders.get(t, ()):
                shared[p] = shared.get(p, 0) + 1
        if len(r["tokens"]) > left or any(100 * s >= (2 * percent - 100) * (r["n"] + held[p][1] - s) for p, s in shared.items()):
            continue
        for t in r["tokens"]:
            holders.setdefault(t, []).append(len(held))
        left -= len(r["tokens"])
        held.append((r["class"], r["n"], np.array(r["tokens"], np.int64)))
    return held


class Pivots:
    """Sorted tokens of all pivots with their owners, and regions of documents."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]], percent: int):
        self.r, self.percent = 1 - percent / 100, percent
        self.names, self.sizes = [c for c, _, _ in held], np.array([n for _, n, _ in held], np.int64)
        token = np.concatenate([*(t for _, _, t in held), np.zeros(0, np.int64)])
        order = np.argsort(token, kind="stable")
        self.owner = np.repeat(np.arange(len(held)), [len(t) for _, _, t in held])[order]
        self.token, self.first, self.many = np.unique(token[order], return_index=True, return_counts=True)

    def place(self, n: int, tokens: np.ndarray) -> tuple[int, bool, list[int], list[float]]:
        """The own region, whether its pivot is within r, and pivots in reach with their distances."""
        none = OUTER, False, [], []
        if not len(self.token):
            return none
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        at = at[self.token[at] == tokens]
        many = self.many[at]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        shared = np.bincount(self.owner[np.repeat(self.first[at], many) + inside], minlength=len(self.sizes))
        pivot = np.flatnonzero(shared)
        if not len(pivot):
            return none
        union = n + self.sizes[pivot] - shared[pivot]
        distance = 1 - shared[pivot] / union
        first = int(distance.argmin())
        linked = bool(100 * shared[pivot[first]] >= self.percent * union[first])
        inside_region = 100 * shared[pivot[first]] >= (2 * self.percent - 100) * union[first]
        reach = (distance <= 3 * self.r + SLACK) & (distance <= distance[first] + 2 * self.r + SLACK)
        return int(pivot[first]) if inside_region else OUTER, linked, pivot[reach].tolist(), distance[reach].tolist()


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Shared shingles that sets of these sizes need to link."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def may_link(a: str, b: str, percent: int) -> Column:
    """Length bound, and positional bound of one shared shingle, for rows with n and pos."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = least_overlap(na, nb, percent)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (na - F.col(f"{a}.pos") >= need) & (nb - F.col(f"{b}.pos") >= need)


def verify(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links among a part's pairs; pairs that links of the part already connect add nothing and are skipped."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("class").to_pylist()
        found = {c: np.sort(t.values.to_numpy()) for c, t in zip(names, left.column("tokens"), strict=True)}
        full = dict(zip(names, left.column("n").to_pylist(), strict=True))
        number = {c: i for i, c in enumerate(found)}
        known, out = Union(len(found)), ([], [])
        for x, y in sorted(zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True)):
            i, j = number[x], number[y]
            if known.find(i) != known.find(j):
                both = np.sort(np.concatenate((found[x], found[y])), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (full[x] + full[y] - shared):
                    known.join(i, j)
                    out[0].append(x)
                    out[1].append(y)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def compare(pairs: DataFrame, sets: DataFrame, percent: int, part_tokens: int) -> DataFrame:
    """Links among ``pairs`` (a, b, n_a, n_b).  A document's pairs meet where its least partner's do, large groups being cut by hash on either side."""
    home = pairs.groupBy("b").agg(F.min("a").alias("_p"))
    met = pairs.join(home, "b")
    cuts = lambda c: met.select("_p", c, f"n_{c}").distinct().groupBy("_p").agg(F.ceil(F.sum(f"n_{c}") / part_tokens).alias(f"_c{c}"))
    piece = lambda c: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.col(f"_c{c}")))
    volume = pairs.agg(F.sum("n_b")).first()[0] or 0
    parts = max(48, -(-volume // part_tokens))
    part = F.pmod(F.xxhash64("_p", piece("a"), piece("b")), F.lit(parts))
    placed = materialize(met.join(cuts("a"), "_p").join(cuts("b"), "_p").select(part.alias("part"), "a", "b"), "jaccard-parts")
    needed = placed.select(F.col("part").alias("here"), F.col("a").alias("class")).union(placed.select("part", "b")).distinct()
    here = needed.join(sets, "class").select("here", "class", "n", "tokens").groupBy("here")
    out = materialize(here.cogroup(placed.groupBy("part")).applyInArrow(verify(percent), "a long, b long"), "jaccard-links")
    release(placed)
    return out


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, pivots: int = 1000, pivot_shingles: int = 1_000_000, sample_rows: int = 2_000, frequent: int = 200_000, block_tokens: int = 1_000_000, part_tokens: int = 250_000, centres: Sequence[int] = (2, 8)) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets), component_id (least doc_id that links reach).

    ``centres`` gives for each level between the regions and the last how many central documents of a list it has reached.
    The sample of ``sample_rows`` documents only decides which shingles count as frequent, at most ``frequent`` of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    # a block is bounded as long as the deal has under 2^16 of them, which hold 130 G shingles
    blocks = min(1 << 16, max(24, -(-(size or 0) // (6 * block_tokens))))
    known = spark.sparkContext.broadcast(frequent_shingles(rows, min(1.0, sample_rows / max(1, total)), width, 4, frequent))
    kind = "block int, message long, doc_id array<long>, class array<long>, n array<long>, token binary, owner binary, order binary"
    dealt = rows.mapInArrow(send(width, blocks, lambda: known.value, block_tokens), kind).groupBy("block").applyInArrow(shared_in_block(blocks), kind)
    sets = materialize(dealt.groupBy("message").applyInArrow(reduced_sets(blocks, percent), "doc_id long, class long, n long, tokens array<long>"), "jaccard-sets")
    opened = materialize(sets.where("tokens is not null").select("class", "n", "tokens").dropDuplicates(["class"]), "jaccard-open")

    # level 1: regions of the pivots
    chosen = spark.sparkContext.broadcast(pick_pivots(opened, percent, pivots, pivot_shingles))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Pivots(chosen.value, percent)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for n, tokens in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = tokens.values.to_numpy()
                own, linked, pivots, distances = index.place(n, tokens)
                alone = n - len(tokens)  # shingles that no other document has come first in the order
                need = -(-percent * n // 100)
                for x, y in zip(out, (alone, own, index.names[own] if linked else None, pivots, distances, tokens[: max(0, n - need + 1 - alone)]), strict=True):
                    x.append(y)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["class", "n", "alone", "own", "pivot", "near", "distance", "tokens"])

    placed = materialize(opened.mapInArrow(regions, "class long, n long, alone long, own int, pivot long, near array<int>, distance array<double>, tokens array<long>"), "jaccard-placed")
    links = placed.where("pivot is not null").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    # a region's radius; one row per pivot
    radius = {r[0]: r[1] for r in placed.where(F.col("own") >= 0).groupBy("own").agg(F.max(F.array_min("distance"))).collect()}
    reach = F.array(*[F.lit(float(radius.get(p, 0.0)) + 1 - percent / 100 + SLACK) for p in range(len(chosen.value))]) if radius else F.array().cast("array<double>")
    within = lambda e: (e["near"] == F.col("own")) | (e["distance"] <= F.get(reach, e["near"]))
    # a pair meets in the lesser of its two own regions, where either is; so greater regions than its own hold no copy of a document
    windows = F.transform(F.filter(F.arrays_zip("near", "distance"), lambda e: within(e) & (e["near"] <= F.col("own"))), lambda e: e["near"])
    outer = F.when(F.col("pivot").isNull(), F.array(F.lit(OUTER))).otherwise(F.array().cast("array<int>"))
    level = materialize(placed.select("class", "n", "alone", "pivot", F.col("own").alias("home"), F.explode(F.concat(windows, outer)).alias("region"), "tokens"), "jaccard-regions")

    def labelled(labels: DataFrame | None) -> DataFrame:
        """Equal labels are one component.  Written, as the lists are read several times."""
        if labels is None:
            return level.withColumn("label", F.coalesce("pivot", "class"))
        met = level.join(labels, level["class"] == labels["node"], "left")
        return materialize(met.select(*level.columns, F.coalesce("root", "class").alias("label")), "jaccard-labelled")

    def lists(labelled: DataFrame) -> DataFrame:
        """A row per region, necessary shingle and document."""
        each = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.get("tokens", i - 1).alias("before")))
        wide = labelled.select("class", "n", "alone", "label", "home", "region", F.posexplode(each).alias("at", "t"))
        return wide.select("region", "t.token", "t.before", "class", "n", "label", "home", (F.col("alone") / F.col("n")).alias("own"), (F.col("alone") + F.col("at")).alias("pos"))

    side = lambda a, b: [F.least(f"{a}.class", f"{b}.class").alias("a"), F.greatest(f"{a}.class", f"{b}.class").alias("b"), F.when(F.col(f"{a}.class") < F.col(f"{b}.class"), F.col(f"{a}.n")).otherwise(F.col(f"{b}.n")).alias("n_a"), F.when(F.col(f"{a}.class") < F.col(f"{b}.class"), F.col(f"{b}.n")).otherwise(F.col(f"{a}.n")).alias("n_b")]
    same = (F.col("x.region") == F.col("y.region")) & (F.col("x.token") == F.col("y.token"))
    # documents that share the shingle before this one too have met in its list
    first = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True)) & (F.col("x.region") == F.least("x.home", "y.home"))
    differ = (F.col("x.label") != F.col("y.label")) & may_link("x", "y", percent) & first
    compared, labels, low = [], None, 0
    for high in (*centres, None):
        named = labelled(labels)
        held = lists(named)
        if high is not None:  # the low-th to high-th most central documents of a list, those with fewest shingles of their own
            rank = F.row_number().over(W.partitionBy("region", "token").orderBy("own", "class"))
            some = held.withColumn("_rank", rank).where(F.col("_rank") <= high).where(F.col("_rank") > low)
            low = high
        else:  # those that differ from the list's most central one, with all
            major = held.groupBy("region", "token").agg(F.min(F.struct("own", "class", "label"))["label"].alias("_label"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
            some = held.join(major.select("region", "token", "_label"), ["region", "token"]).where("label <> _label")
        found = held.alias("x").join(some.alias("y"), same & differ).select(*side("x", "y")).distinct()
        for c in compared:
            found = found.join(c.select("a", "b"), ["a", "b"], "left_anti")
        found = materialize(found, "jaccard-pairs")
        release(named)
        compared.append(found)
        fresh = bool(found.take(1))
        if fresh:
            links = links.union(compare(found, opened, percent, part_tokens))
        if fresh or labels is None:
            stars = components(links)
            if labels is not None:
                release(labels)
            labels = materialize(stars, "jaccard-labels")
            # the next level's links join stars, not all links again
            links = labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
        tidy(spark)

    heads = sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("head"))
    named = heads.join(labels, heads["class"] == labels["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "head")
    least = named.groupBy("root").agg(F.min("head").alias("component"))
    classes = materialize(named.join(least, "root").select(F.col("class").alias("_class"), "component"), "jaccard-classes")
    for t in (*compared, labels, level, placed, opened):
        release(t)
    out = sets.select("doc_id", "n", "class").join(classes, (F.col("class") == F.col("_class")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_ids: int = 500_000, **how: object) -> DataFrame:
    """The row with the least id of each component, with all its columns.

    Rows with a null id stay.  Rows that share an id are kept or dropped together; equal ones among them stay once.
    """
    found = materialize(link(docs, key, text, **how).select("doc_id", "component_id"), "jaccard-found")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most"), F.count(F.lit(1)).alias("n"))
    odd = materialize(ids.where("least < doc_id and most < doc_id or n > 1").select(F.col("doc_id").alias("_spanloom_id"), ((F.col("most") >= F.col("doc_id")) & (F.col("n") > 1)).alias("_spanloom_again")), "jaccard-dropped")
    near = F.broadcast(odd) if odd.count() <= broadcast_ids else odd
    marked = docs.join(near, docs[key] == near["_spanloom_id"], "left")
    single = marked.where("_spanloom_id is null").select(*docs.columns)
    again = odd.where("_spanloom_again")
    if not again.take(1):
        return single
    return single.unionByName(marked.where("_spanloom_again").select(*docs.columns).dropDuplicates([key, text]))
