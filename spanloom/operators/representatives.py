"""Clusters with representatives at an identity and a coverage, in time linear in the rows.

* Candidates.  Each distinct sequence lists its ``words`` words of the smallest hashes.  The longest holder of a word in its
  group is the word's centre, and the other holders meet the centre only, so a word that all rows share gives one pair a row.
  A pair needs two such words within ``BAND`` diagonals.
* Alignment.  A pair is compared letter by letter on its diagonal, and where that falls short of the highest identity asked
  for, by the banded alignment with gaps, unless scores alone show that none covers enough; the better one that covers enough counts.
* Greedy cover.  Longest first, ties by the smaller id: a sequence that no representative covers becomes one.  This runs in
  rounds over all groups at once: a sequence is decided when no longer linked one is undecided.  The result is that of the
  sequential loop over the same links.

Pairs without two common words are not found; at 15 letters these are the pairs well below 0.8, at 7 those below 0.6 or so.

Cases: null sequences take no part; one shorter than a word is in a cluster with its equals.  Equal sequences of a group
share a cluster.  Keys are unique but for repeated rows.  A null group is a group.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import BAND, HALF, extend, may_cover
from .minwise import PIECE
from .scratch import release, written


def least_words(seqs: list[str], word: int, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``words`` smallest hashes of each sequence's words and their first places; none is shorter than ``word``."""
    cells = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(len(cells) - word + 1, np.uint64)
    for o in range(word):
        code *= np.uint64(0x100000001B3)
        code += cells[o : o + len(code)]
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    out, start = [], 0
    for seq in seqs:
        own = code[start : start + len(seq) - word + 1]
        start += len(seq)
        at = np.arange(len(own))
        if len(own) > 4 * words:
            at = np.flatnonzero(own <= np.partition(own, 2 * words)[2 * words])
        found, first = np.unique(own[at], return_index=True)
        if len(found) < words and len(at) < len(own):  # the smallest hashes are of repeated words
            found, at = np.unique(own, return_index=True)
            first = np.arange(len(at))
        out.append((found[:words].view(np.int64), at[first[:words]]))
    return out


def listed(rows: DataFrame, word: int, words: int) -> DataFrame:
    """g, id, n (letters), h (MD5 of the sequence), w and at (words and their places; empty under ``word`` letters) of ``rows``: g, id, seq, none null."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("g", "id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(batch.schema.get_field_index("seq")).to_pylist()
            whole = [i for i, s in enumerate(seqs) if len(s) >= word]
            w, at = [[] for _ in seqs], [[] for _ in seqs]
            ends = np.cumsum([len(seqs[i]) for i in whole])
            for part in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(ends // PIECE)) + 1):
                if len(part):
                    for p, found in zip(part, least_words([seqs[whole[p]] for p in part], word, words), strict=True):
                        w[whole[p]], at[whole[p]] = found
            held = [batch.column(batch.schema.get_field_index(c)) for c in ("g", "id")]
            digests = pa.array([hashlib.md5(s.encode("utf-8", "surrogatepass")).digest() for s in seqs], pa.binary())
            yield pa.RecordBatch.from_arrays([*held, pa.array([len(s) for s in seqs], pa.int32()), digests, pa.array(w, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], names=["g", "id", "n", "h", "w", "at"])

    return rows.select("g", "id", "seq").mapInArrow(run, f"g {kinds['g']}, id {kinds['id']}, n int, h binary, w array<long>, at array<int>")


def candidates(rows: DataFrame, word: int = 15, words: int = 40, salt: int = 8) -> DataFrame:
    """rep, member, n (the member's letters), lead (place in the member less place in the representative) of ``rows``: g, id, seq, all distinct.

    A pair with several bands of two words or more keeps the one with the most.
    """
    return met_at_centres(listed(rows, word, words), salt)


def met_at_centres(rows: DataFrame, salt: int = 8) -> DataFrame:
    """The candidates among rows that list their words already."""
    held = rows.select("g", "id", "n", F.explode(F.arrays_zip("w", "at")).alias("x")).select("g", "id", "n", "x.w", "x.at")
    centre = F.min_by(F.struct("id", "at"), F.struct(-F.col("n"), "id"))
    centres = held.groupBy("g", "w").agg(centre.alias("c"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    centres = centres.select(F.col("g").alias("_g"), F.col("w").alias("_w"), "c", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"))
    met = held.join(centres, F.col("g").eqNullSafe(F.col("_g")) & (F.col("w") == F.col("_w")) & (F.pmod(F.xxhash64("id"), F.lit(salt)) == F.col("_salt"))).where(F.col("id") != F.col("c.id"))
    hits = met.select(F.col("c.id").alias("rep"), F.col("id").alias("member"), "n", (F.col("at") - F.col("c.at")).cast("int").alias("lead"))
    # bands overlap by half, so words to either side of a limit meet in one of them
    band = F.explode(F.array(F.floor(F.col("lead") / BAND) * 2, F.floor((F.col("lead") + BAND // 2) / BAND) * 2 + 1))
    bands = hits.select("rep", "member", "n", "lead", band.alias("band")).groupBy("rep", "member", "n", "band").agg(F.count(F.lit(1)).alias("hits"), F.mode("lead", True).alias("lead"))
    return bands.where("hits > 1").groupBy("rep", "member", "n").agg(F.min_by("lead", F.struct(-F.col("hits"), "lead")).alias("lead"))


def _straight(member: str, rep: str, lead: int) -> tuple[int, int]:
    """Equal letters and letters compared on a diagonal."""
    a, b = max(0, lead), max(0, -lead)
    n = min(len(member) - a, len(rep) - b)
    x, y = (np.frombuffer(t.encode("ascii", "replace"), np.uint8) for t in (member[a : a + n], rep[b : b + n]))
    return int((x == y).sum()), n


def _batches(items: list, size: Callable[[int], int], most: int = 1024, cells: int = 1 << 25) -> Iterator[list]:
    """Items in order of growing size, up to ``most`` and about ``cells`` letters with padding at a time: rows cost little more for many pairs than for one."""
    some: list = []
    for item in items:
        if some and (len(some) == most or (len(some) + 1) * size(item) > cells):
            yield some
            some = []
        some.append(item)
    if some:
        yield some


def measured(pairs: DataFrame, rows: DataFrame, sure: float, coverage: float, of_member_only: bool = False, bound: int = 1 << 22) -> DataFrame:
    """rep, member, pid: identity of the pairs (rep, member, n, lead) that cover ``coverage`` of both, or of the member only.

    Gaps are tried where the diagonal covers too little or its identity is below ``sure``, unless the band around it cannot
    hold the coverage.  Of the diagonal and the alignment, the better one that covers enough counts.  Sequences meet their
    pairs in parts of about ``bound`` letters of members.
    """
    pairs = written(pairs, "representative-pairs")
    volume = pairs.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    parts = int(max(8, min(-(-volume // bound), 20_000)))
    cuts = pairs.groupBy(F.col("rep").alias("_rep")).agg(F.ceil(F.sum(F.col("n").cast("long")) / bound).alias("_cuts"))
    part = F.pmod(F.xxhash64("rep", F.pmod(F.xxhash64("member"), F.greatest("_cuts", F.lit(1)))), F.lit(parts))
    placed = written(pairs.join(cuts, F.col("rep") == F.col("_rep")).select(part.alias("part"), "rep", "member", "lead"), "representative-parts")
    needed = placed.select("part", F.col("rep").alias("id")).union(placed.select("part", "member")).distinct()
    here = needed.join(rows.select("id", "seq").dropDuplicates(["id"]), "id").select(F.col("part").alias("here"), "id", "seq")
    kind = rows.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        text = dict(zip(left["id"].to_pylist(), left["seq"].to_pylist(), strict=True))
        rep, member, lead = (right[c].to_pylist() for c in ("rep", "member", "lead"))
        pid, open_ = np.full(len(rep), -1.0), []
        for k, (a, b, d) in enumerate(zip(rep, member, lead, strict=True)):
            r, m = text[a], text[b]
            same, n = _straight(m, r, d)
            if n >= coverage * len(m) and (of_member_only or n >= coverage * len(r)):
                pid[k] = same / n
            if pid[k] < sure and n + HALF >= coverage * len(m) and (of_member_only or n + 2 * HALF >= coverage * len(r)):
                open_.append(k)
        open_.sort(key=lambda k: len(text[member[k]]))
        both = lambda some: ([text[member[i]] for i in some], [text[rep[i]] for i in some], [lead[i] for i in some])
        size = lambda k: len(text[member[k]])
        left_open = [i for some in _batches(open_, size) for i, may in zip(some, may_cover(*both(some), coverage), strict=True) if may]
        for some in _batches(left_open, size):
            best = extend(*both(some), HALF)
            for i, (score, qs, qe, ss, se, matches, columns, _) in zip(some, best.tolist(), strict=True):
                if score and qe - qs >= coverage * len(text[member[i]]) and (of_member_only or se - ss >= coverage * len(text[rep[i]])):
                    pid[i] = max(pid[i], matches / columns)
        return right.select(["rep", "member"]).append_column("pid", pa.array(pid, pa.float64())).filter(pa.array(pid >= 0, pa.bool_()))

    out = written(here.repartition(parts, "here").groupBy("here").cogroup(placed.repartition(parts, "part").groupBy("part")).applyInArrow(run, f"rep {kind}, member {kind}, pid double"), "representative-links")
    release(pairs)
    release(placed)
    return out


def cover(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, representative.  ``nodes``: id, n (length); ``links``: a, b, in any order and number; those of unknown ids are dropped.

    Greedy by falling n, then id; a member belongs to the first representative that it is linked with.
    """
    size = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    both = links.select("a", "b").where("a <> b").join(size("a"), "a").join(size("b"), "b")
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    turned = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lo"), F.greatest("n_a", "n_b").alias("n_hi"))
    edges = written(turned.distinct(), "cover-links")
    # only linked nodes take part in the rounds; null: undecided
    linked = edges.select(F.col("hi").alias("id")).union(edges.select("lo")).distinct()
    state = written(linked.select("id", F.lit(None).cast("boolean").alias("rep")), "cover")
    while state.where("rep is null").take(1):
        above = edges.join(state, F.col("hi") == F.col("id")).groupBy("lo").agg(F.coalesce(F.bool_or("rep"), F.lit(False)).alias("_covered"), F.bool_or(F.col("rep").isNull()).alias("_open"))
        decided = F.when(F.col("rep").isNotNull(), F.col("rep")).when(F.col("_covered"), False).when(~F.coalesce("_open", F.lit(False)), True)
        new = written(state.join(above, F.col("id") == F.col("lo"), "left").select("id", decided.alias("rep")), "cover")
        release(state)
        state = new
    owner = edges.join(state.where("rep").select(F.col("id").alias("_r")), F.col("hi") == F.col("_r")).groupBy("lo").agg(F.min_by("hi", F.struct(-F.col("n_hi"), "hi")).alias("_owner"))
    own = nodes.select("id").join(owner, F.col("id") == F.col("lo"), "left").join(state.where("rep").select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left")
    out = written(own.select("id", F.when(F.col("_id").isNotNull(), F.col("id")).otherwise(F.coalesce("_owner", "id")).alias("representative")), "covered")
    release(edges)
    release(state)
    return out


def ladder(rows: DataFrame, group: str, key: str, seq: str, rungs: Sequence[float], coverage: float, of_member_only: bool = False, word: int = 15) -> DataFrame:
    """group, key, rung, representative at each identity of ``rungs``; pairs are aligned once for all of them.

    The share ``coverage`` has to be covered of both sequences, or with ``of_member_only`` of the shorter one alone.
    """
    own = rows.where(F.col(seq).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(seq).alias("seq"))
    every = written(listed(own, word, 40), "representative-words")
    first = every.groupBy("g", "h").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("at").alias("at"))
    distinct = written(first, "representatives")
    close = measured(met_at_centres(distinct), own, max(rungs), coverage, of_member_only).where(F.col("pid") >= min(rungs))
    # one loop over all rungs: a node is a sequence at a rung
    steps = F.array(*map(F.lit, sorted({float(r) for r in rungs})))
    at = lambda c, rung="rung": F.struct(F.col(rung), F.col(c).alias("id"))
    nodes = distinct.select("id", "n", F.explode(steps).alias("rung")).select(at("id").alias("id"), "n")
    links = close.select("rep", "member", F.explode(F.filter(steps, lambda r: r <= F.col("pid"))).alias("rung")).select(at("rep").alias("a"), at("member").alias("b"))
    out = cover(nodes, links).select("id.id", "id.rung", F.col("representative.id").alias("representative"))
    heads = distinct.select(F.col("g").alias("_g"), F.col("h").alias("_h"), "id").join(out, "id").select("_g", "_h", "rung", "representative")
    return every.join(heads, F.col("g").eqNullSafe(F.col("_g")) & (F.col("h") == F.col("_h"))).select(F.col("g").alias(group), F.col("id").alias(key), "rung", "representative")
