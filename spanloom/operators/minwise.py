"""Similar sequences of large groups by minwise hashes, in time near linear in the rows; every link is confirmed on whole sets.

* Bands.  A sequence has one minwise hash of its k-mers under each of many hash functions; ``r`` of them make a band.  Two
  sequences of Jaccard similarity s agree in a band with probability s^r, and there are so many bands that a pair at the
  threshold agrees in none with a probability under ``MISSED``.  Sequences that agree in a band stand in one node.
* Stars.  Each node compares its members with its least one first; what links becomes one component.
* Rest.  Then the pairs of a node that are of different components are compared, so large families make few pairs.

Before sequences are fetched a sketch, four bits of 128 minwise hashes, lets pairs go that differ by six standard deviations
more than those at the threshold.  Sequences shorter than a k-mer link with none but their equals and take no part.

Where all pairs are the result (``near_pairs``), rows of a group meet in blocks by 256 minwise hashes of 16 bits, without their
sequences, and sequences are fetched for pairs that have enough of them in common.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import release, written

#: Chance of a pair at the threshold to be in no common node.
MISSED = 1e-9
SKETCHED = 128
SKETCH = tuple(f"s{i}" for i in range(SKETCHED // 16))
LOWEST = 0x1111111111111111
#: Letters hashed at once inside a Python worker.
PIECE = 1 << 18


def banding(least: float) -> tuple[int, int]:
    """Hashes in a band, and bands, for a threshold."""
    r = 3 if least >= 0.6 else 2 if least >= 0.2 else 1
    return r, max(-(-SKETCHED // r), math.ceil(math.log(MISSED) / math.log1p(-(min(least, 0.99) ** r))))


def minwise(seqs: list[str], k: int, hashes: int) -> np.ndarray:
    """The least value of each hash function over the k-mers of each sequence, none of which is shorter than ``k``."""
    rng = np.random.default_rng(5)
    salts, factors = rng.integers(0, 1 << 32, hashes, np.uint32), rng.integers(0, 1 << 32, hashes, np.uint32) | np.uint32(1)
    cells = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(s) for s in seqs])
    code = np.zeros(len(cells) - k + 1, np.uint64)
    for o in range(k):
        code *= np.uint64(0x100000001B3)
        code += cells[o : o + len(code)]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0x94D049BB133111EB)
    x = np.append((code >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    bounds = np.stack([ends - [len(s) for s in seqs], ends - k + 1], 1).ravel()
    out, mixed = np.empty((len(seqs), hashes), np.uint32), np.empty_like(x)
    for i in range(hashes):
        np.bitwise_xor(x, salts[i], out=mixed)
        np.multiply(mixed, factors[i], out=mixed)
        out[:, i] = np.minimum.reduceat(mixed, bounds)[::2]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def signed(rows: DataFrame, k: int, least: float) -> DataFrame:
    """g, id, n (letters), bands and sketch of ``rows``: g, id, seq."""
    r, bands = banding(least)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("g", "id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(batch.schema.get_field_index("seq")).to_pylist()
            ends = np.cumsum([len(s) for s in seqs])
            for part in np.split(np.arange(len(seqs)), np.flatnonzero(np.diff(ends // PIECE)) + 1):
                if not len(part):
                    continue
                own = seqs[part[0] : part[-1] + 1]
                found = minwise(own, k, r * bands).astype(np.uint64)
                value = np.zeros((len(own), bands), np.uint64)
                for o in range(r):
                    value = _mixed(value + found[:, o::r])
                four = _mixed(found[:, :SKETCHED]) >> np.uint64(60)
                four = (four.reshape(len(own), -1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, value.size + 1, bands, dtype=np.int32)), pa.array(value.view(np.int64).ravel()))
                given = batch.slice(part[0], len(part))
                held = [given.column(given.schema.get_field_index(c)) for c in ("g", "id")]
                sketch = [pa.array(np.ascontiguousarray(c)) for c in four.view(np.int64).T]
                yield pa.RecordBatch.from_arrays([*held, pa.array([len(s) for s in own], pa.int64()), listed, *sketch], names=["g", "id", "n", "bands", *SKETCH])

    kind = f"g {kinds['g']}, id {kinds['id']}, n long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return rows.where(F.length("seq") >= k).select("g", "id", "seq").mapInArrow(run, kind)


def _alike(least: float) -> Column:
    share = (1 - least) * 15 / 16
    most = int(SKETCHED * (share + 6 * (share * (1 - share) / SKETCHED) ** 0.5)) + 1

    def differ(s: str) -> Column:
        z = F.col(f"ca.{s}").bitwiseXOR(F.col(f"cb.{s}"))
        some = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        return F.bit_count(some.bitwiseAND(F.lit(LOWEST)))

    return functools.reduce(operator.add, map(differ, SKETCH)) <= most


def _plausible(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """a, b, n_b of the pairs that the sketch lets through."""
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("id").alias(side), F.struct("n", *SKETCH).alias(f"c{side}")), side)
    return pairs.where(_alike(least)).select("a", "b", F.col("cb.n").alias("n_b"))


def confirmed(pairs: DataFrame, rows: DataFrame, k: int, least: float, bound: int) -> DataFrame:
    """The links among ``pairs`` (a, b, n_b), as a, b, jaccard; a part holds about ``bound`` letters of b's, each sequence once."""
    from .similarity import _codes

    pairs = written(pairs, "minwise-pairs")
    volume = pairs.agg(F.sum("n_b")).first()[0] or 0
    parts = max(64, -(-volume // bound))
    home = pairs.groupBy("b").agg(F.min("a").alias("home"), F.max("n_b").alias("n"))
    cuts = home.groupBy(F.col("home").alias("_home")).agg(F.ceil(F.sum("n") / bound).alias("_cuts"))
    where = home.join(cuts, F.col("home") == F.col("_home")).select(F.col("b").alias("_b"), F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("b"), F.greatest("_cuts", F.lit(1)))), F.lit(parts)).alias("part"))
    placed = written(pairs.join(where, pairs["b"] == F.col("_b")).select("part", "a", "b"), "minwise-parts")
    needed = placed.select("part", F.col("a").alias("id")).union(placed.select("part", "b")).distinct()
    here = needed.join(rows.select("id", "seq"), "id").select(F.col("part").alias("here"), "id", "seq")
    kind = rows.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return right.select(["a", "b"]).slice(0, 0).append_column("jaccard", pa.array([], pa.float64()))
        at, codes = _codes(left["seq"].to_pylist(), k)
        _, codes = np.unique(codes, return_inverse=True)
        order = np.argsort(at, kind="stable")
        codes, size = codes[order], np.bincount(at, minlength=left.num_rows)
        start = np.concatenate([[0], np.cumsum(size)])
        place = {x: i for i, x in enumerate(left["id"].to_pylist())}
        right = right.sort_by("a")
        mark, last, value = np.zeros(int(codes.max(initial=0)) + 1, bool), None, []
        for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True):
            x, y = place[a], place[b]
            if x != last:
                mark[:] = False
                mark[codes[start[x] : start[x + 1]]] = True
                last = x
            shared = np.count_nonzero(mark[codes[start[y] : start[y + 1]]])
            value.append(shared / (size[x] + size[y] - shared))
        return right.select(["a", "b"]).append_column("jaccard", pa.array(value, pa.float64())).filter(pa.array([v >= least for v in value], pa.bool_()))

    out = written(here.groupBy("here").cogroup(placed.groupBy("part")).applyInArrow(run, f"a {kind}, b {kind}, jaccard double"), "minwise-links")
    release(placed)
    release(pairs)
    return out


def similar(rows: DataFrame, heads: DataFrame, k: int, least: float, bound: int) -> DataFrame:
    """a, b: links of ``least`` or more that connect what all such links connect, among the ids of ``heads``.

    ``rows``: g, id, seq; ``heads``: id of one row of each sequence of a group.  Of the sequences, those in a node are shuffled.
    """
    held = written(signed(rows, k, least).join(heads, "id", "left_semi").dropDuplicates(["id"]), "minwise")
    spread = held.select("g", "id", F.posexplode("bands").alias("at", "value")).select(F.xxhash64("g", "at", "value").alias("node"), "id")
    nodes = spread.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("centre")).where("_n > 1").select("node", "centre")
    together = written(spread.join(nodes, "node"), "minwise-nodes")
    stars = together.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    bodies = written(rows.join(together.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", "seq"), "minwise-rows")
    first = confirmed(_plausible(stars, held, least), bodies, k, least, bound)
    labels = connected(first)
    named = together.join(labels, together["id"] == labels["node"], "left").select(together["node"], "id", "centre", F.coalesce("root", "id").alias("label"))
    open_ = named.groupBy("node").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("node")
    # a node's centre has met all its members
    left = written(named.where("id <> centre").join(open_, "node").select("node", "id", "label"), "minwise-open")
    other = left.select(F.col("node").alias("_node"), F.col("id").alias("b"), F.col("label").alias("_label"))
    pairs = left.join(other, (F.col("node") == F.col("_node")) & (F.col("id") < F.col("b")) & (F.col("label") != F.col("_label")))
    second = confirmed(_plausible(pairs.select(F.col("id").alias("a"), "b").distinct(), held, least), bodies, k, least, bound)
    for t in (held, together, left, bodies):
        release(t)
    return first.union(second).select("a", "b")


def signature(least: float) -> tuple[int, int]:
    """Minwise hashes of a sequence, and how many of them a pair has in common at least to be looked at.

    Of pairs at the threshold ``least`` a share under ``MISSED`` / 1000 has fewer.
    """
    missed = MISSED / 1000
    hashes = max(256, math.ceil(math.log(missed) / math.log1p(-min(least, 0.99))))
    log = lambda x: math.log(x) if x > 0 else -math.inf
    chance = lambda m: math.exp(math.lgamma(hashes + 1) - math.lgamma(m + 1) - math.lgamma(hashes - m + 1) + (m and m * log(least)) + (hashes - m and (hashes - m) * log(1 - least)))
    tail, most = 0.0, 0
    while most < hashes and (tail := tail + chance(most)) <= missed:
        most += 1
    return hashes, max(1, most)


def digested(rows: DataFrame, k: int, least: float) -> DataFrame:
    """g, id, n (letters), h (MD5 of the sequence) and marks (minwise hashes of 16 bits; null under ``k`` letters) of ``rows``: g, id, seq, none null."""
    hashes, _ = signature(least)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("g", "id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(batch.schema.get_field_index("seq")).to_pylist()
            whole = [i for i, s in enumerate(seqs) if len(s) >= k]
            marks: list[bytes | None] = [None] * len(seqs)
            ends = np.cumsum([len(seqs[i]) for i in whole])
            for part in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(ends // PIECE)) + 1):
                if len(part):
                    found = minwise([seqs[whole[p]] for p in part], k, hashes)
                    folded = ((found * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
                    for p, row in zip(part, folded, strict=True):
                        marks[whole[p]] = row.tobytes()
            held = [batch.column(batch.schema.get_field_index(c)) for c in ("g", "id")]
            digests = [hashlib.md5(s.encode("utf-8", "surrogatepass")).digest() for s in seqs]
            yield pa.RecordBatch.from_arrays([*held, pa.array([len(s) for s in seqs], pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())], names=["g", "id", "n", "h", "marks"])

    return rows.select("g", "id", "seq").mapInArrow(run, f"g {kinds['g']}, id {kinds['id']}, n long, h binary, marks binary")


def meeting(a: np.ndarray, b: np.ndarray, most: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` with ``most`` equal columns or more, from sorted columns; about ``cells`` pairs are counted at once."""
    order = np.argsort(b, axis=0, kind="stable")
    columns = [np.ascontiguousarray(b[order[:, t], t]) for t in range(b.shape[1])]
    step = max(1, cells // max(1, len(b)))
    for low in range(0, len(a), step):
        some = a[low : low + step]
        total, waiting, held = np.zeros(len(some) * len(b), np.int32), [], 0
        for t, column in enumerate(columns):
            first = np.searchsorted(column, some[:, t])
            n = np.searchsorted(column, some[:, t], "right") - first
            places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            waiting.append(np.repeat(np.arange(len(some)) * len(b), n) + order[places, t])
            held += len(places)
            if held > cells or t == len(columns) - 1:
                total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.int32)
                waiting, held = [], 0
        found = np.flatnonzero(total >= most)
        yield low + found // len(b), found % len(b)


def near_pairs(heads: DataFrame, least: float, chunk: int = 1 << 13) -> DataFrame:
    """a, b, n_b: pairs of a group whose marks let a Jaccard of ``least`` be, a < b.  ``heads``: g, id, n, marks, ids distinct.

    All pairs of a group are looked at, in blocks of two chunks of about ``chunk`` rows, by marks alone.
    """
    hashes, most = signature(least)
    sizes = written(heads.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_n")), "pair-chunks")
    blocks = sizes.agg(F.sum(F.col("_n").cast("long") * (F.col("_n") + 1) / 2)).first()[0] or 0
    placed = heads.join(sizes, heads["g"] == sizes["_g"]).withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    dealt = placed.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("g", F.least("_c", "_x").alias("i"), F.greatest("_c", "_x").alias("j"), (F.col("_c") > F.col("_x")).alias("side"), "id", "n", "marks")
    kind = heads.schema["id"].dataType.simpleString()

    def run(block: pa.Table) -> pa.Table:
        marks = np.frombuffer(b"".join(block["marks"].to_pylist()), np.uint16).reshape(-1, hashes)
        side, same = block["side"].to_numpy(), block["i"][0] == block["j"][0]
        left = np.arange(len(marks)) if same else np.flatnonzero(~side)
        right = left if same else np.flatnonzero(side)
        parts = [(left[x], right[y]) for x, y in meeting(marks[left], marks[right], most)] if len(left) and len(right) else []
        x, y = (np.concatenate([np.empty(0, np.int64), *p]) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
        ids, n = block["id"].combine_chunks(), block["n"].to_numpy()
        a, b = ids.take(pa.array(x)), ids.take(pa.array(y))
        # either order may come from two chunks; in one chunk each pair comes twice and with itself
        turned = pc.greater(a, b)
        met = pa.table({"a": pc.if_else(turned, b, a), "b": pc.if_else(turned, a, b), "n_b": pa.array(np.where(turned.to_numpy(zero_copy_only=False), n[x], n[y]))})
        return met.filter(pa.array(x < y) if same else pa.array(np.ones(len(x), bool)))

    return dealt.repartition(int(max(64, min(blocks, 20_000))), "g", "i", "j").groupBy("g", "i", "j").applyInArrow(run, f"a {kind}, b {kind}, n_b long")
