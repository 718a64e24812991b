"""Operator 11, near-duplicates by a chosen-path join of documents as sets of word n-grams.

Documents with equal sets are one *class*.  A class has minwise tokens: under each of many hash functions, the token of its
set with the least hash.  Two classes agree in one with a probability equal to their Jaccard similarity.

* Trees.  Each of ``trees`` independent trees starts with all classes at its root and branches them by the minwise token of
  the tree's own hash function: classes that agree stand in one node.  A pair at the threshold of 0.8 stays together in a
  tree's first level with probability 0.8, so 10 trees miss it with 0.2^10, one pair in ten million.
* Every node compares its classes with its *centre*, the one whose minwise tokens most other classes have; what links becomes
  one component.  A node whose classes are all of one component is finished, which settles groups of copies without pairs.
* Small nodes, of at most ``small`` classes, are compared exhaustively, but for pairs inside one component.
* Larger ones branch further: a node chooses 1.25 hash functions of its level's own on average, one over the threshold, by
  its name, and its classes go on to the children of each.  So classes less similar than the threshold thin out from level to
  level, and a pair at the threshold lives on in half of the trees after five levels.  What is left after ``levels`` levels
  is compared whole.

Before texts are fetched, pairs pass a length bound and a sketch: four bits of 128 minwise hashes, of which pairs at the
threshold differ in 19 %; those that differ in over 32 % (four standard deviations) are let go.  What remains is confirmed
on full sets, exactly.  Nodes and sketches are DataFrame joins and aggregations; Python makes the minwise tokens and confirms.

Cases: a null or empty text, or one without words, has an empty set, is linked with nothing and its own component.  A text of
fewer words than ``width`` is one shingle.  A very long text is one set like others.  Repeated rows fall into one class and
get equal results.  Ties between centres cannot occur, as classes are distinct.  An empty table gives an empty result; other
columns are ignored.  Rows with a null id take part like others and are never the smallest id of a component with one.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_of, materialize, pieces, release, tidy
from .components import components
from .op9_jaccard import Shingler, class_of, verify

#: Minwise hashes for the trees' roots, for each further level, and in the sketch.
ROOTS, PER_LEVEL, SKETCHED = 16, 8, 128
#: The columns that hold the sketch, 16 hashes of 4 bits each.
SKETCH = tuple(f"s{i}" for i in range(SKETCHED // 16))
LOWEST = 0x1111111111111111


def minwise(found: list[np.ndarray], n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Per non-empty set: ``n_keys`` least hashes, and four bits each of ``SKETCHED``, as longs."""
    factors = np.random.default_rng(11).integers(0, 1 << 63, max(n_keys, SKETCHED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    every = np.concatenate(found)
    first = np.cumsum([0, *(len(s) for s in found[:-1])])
    keys, sketch = np.empty((len(found), n_keys), np.int64), np.zeros((len(found), len(SKETCH)), np.uint64)
    with np.errstate(over="ignore"):
        for i, f in enumerate(factors):
            mixed = every * f
            mixed ^= mixed >> np.uint64(32)
            mixed *= f
            least = np.minimum.reduceat(mixed, first)
            if i < n_keys:
                keys[:, i] = least.view(np.int64)
            if i < SKETCHED:
                # the least hash is a small number; it is mixed again before bits of it are taken
                again = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                sketch[:, i // 16] |= (again >> np.uint64(60)) << np.uint64(4 * (i % 16))
    return keys, sketch.view(np.int64)


def sign(width: int, n_keys: int):
    """Texts to doc_id, class, n, keys and sketch; rows without words have a null class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch, texts in pieces(batches):
            found = shingler.sets(texts)
            some = [i for i, s in enumerate(found) if len(s)]
            keys: list = [None] * len(found)
            sketch = np.zeros((len(found), len(SKETCH)), np.int64)
            if some:
                own, sketch[some] = minwise([found[i] for i in some], n_keys)
                for i, k in zip(some, own, strict=True):
                    keys[i] = k
            classes = pa.array([class_of(s) if len(s) else None for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids_of(batch), classes, pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, sketch.T)], names=["doc_id", "class", "n", "keys", *SKETCH])

    return run


def texts_of(width: int):
    """Texts by class, each class once a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for _, texts in pieces(batches):
            found = {class_of(s): t for s, t in zip(shingler.sets(texts), texts, strict=True) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["class", "text"])

    return run


def alike(x: str, y: str, percent: int) -> Column:
    """Length bound, and the sketch's: hashes that differ, four standard deviations beyond those of a pair at the threshold."""
    share = (1 - percent / 100) * 15 / 16
    most = int(SKETCHED * (share + 4 * (share * (1 - share) / SKETCHED) ** 0.5))

    def differ(s: str) -> Column:
        z = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        some = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        return F.bit_count(some.bitwiseAND(F.lit(LOWEST)))

    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (functools.reduce(operator.add, map(differ, SKETCH)) <= most)


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``label``: the component of a class as far as it is known."""
    if labels is None:
        return rows.withColumn("label", F.col("class"))
    known = labels.select(F.col("node").alias("class"), "root")
    return rows.join(known, "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")


def crowded(rows: DataFrame) -> DataFrame:
    """Nodes whose classes are not all of one component: node, size, centre and its label."""
    centre = F.max(F.struct("weight", "class", "label")).alias("_c")
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), centre, F.min("label").alias("_low"), F.max("label").alias("_high"))
    return nodes.where("_low < _high").select("node", "size", F.col("_c.class").alias("centre"), F.col("_c.label").alias("_own"))


def with_centres(rows: DataFrame, nodes: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs of a node's centre and its other classes, of other components, that may link."""
    pairs = rows.join(nodes, "node").where("label <> _own").select(F.least("centre", "class").alias("a"), F.greatest("centre", "class").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("class").alias(side), F.struct("n", *SKETCH).alias(f"c{side}")), side)
    return pairs.where(alike("ca", "cb", percent)).select("a", "b", F.col("ca.n").alias("n_a"), F.col("cb.n").alias("n_b"))


def within(rows: DataFrame, nodes: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes' classes, of different components, that may link."""
    full = rows.select("node", "class", "label").join(nodes.select("node"), "node").join(held.select("class", "n", *SKETCH), "class")
    full = full.select("node", "class", "label", "n", *SKETCH)
    same = (F.col("x.node") == F.col("y.node")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.label") != F.col("y.label"))
    pairs = full.alias("x").join(full.alias("y"), same & alike("x", "y", percent))
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()


def children(rows: DataFrame, nodes: DataFrame, branching: DataFrame, level: int) -> DataFrame:
    """Rows of the next level: each node goes on by one of the level's hash functions, every fourth one by two, by its name."""
    base = ROOTS + PER_LEVEL * (level - 1)
    first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(PER_LEVEL)).cast("int")
    step = 1 + F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(PER_LEVEL - 1)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(4)) == 0
    chosen = F.explode(F.when(second, F.array(first, (first + step) % PER_LEVEL)).otherwise(F.array(first)))
    wide = rows.select("node", "class").join(nodes.select("node"), "node").join(branching, "class")
    wide = wide.select("class", "weight", "node", "keys", chosen.alias("at"))
    return wide.select(F.xxhash64("node", "at", F.get("keys", F.col("at") + base)).alias("node"), "class", "weight")


def links_among(width: int, percent: int):
    """A part's pairs, confirmed on the sets of its texts."""
    check = verify(percent)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Shingler(width).sets(left.column("text").to_pylist())
        sets = pa.table([left.column("class"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["class", "n", "tokens"])
        return check(sets, right)

    return run


def confirm(pairs: DataFrame, bodies: DataFrame, width: int, percent: int, part_tokens: int) -> DataFrame:
    """Links among ``pairs`` (a, b, n_a, n_b), as a, b.

    A class's pairs meet where those of its least partner do; the group of one such is cut by hash on either side into
    pieces of about ``part_tokens`` shingles, so that a part holds few texts and each of them once.
    """
    home = pairs.groupBy("b").agg(F.min("a").alias("home"))
    met = pairs.join(home, "b")
    for side in ("a", "b"):
        cuts = met.select("home", side, f"n_{side}").distinct().groupBy("home").agg(F.ceil(F.sum(f"n_{side}") / part_tokens).alias(f"cuts_{side}"))
        met = met.join(cuts, "home")
    piece = [F.pmod(F.xxhash64(side), F.greatest(F.lit(1), F.col(f"cuts_{side}"))) for side in ("a", "b")]
    volume = pairs.agg(F.sum("n_b")).first()[0] or 0
    parts = max(48, -(-volume // part_tokens))
    placed = materialize(met.select(F.pmod(F.xxhash64("home", *piece), F.lit(parts)).alias("part"), "a", "b"), "chosen-parts")
    needed = placed.select(F.col("part").alias("here"), F.col("a").alias("class")).union(placed.select("part", "b")).distinct()
    here = needed.join(bodies, "class").select("here", "class", "text")
    out = materialize(here.groupBy("here").cogroup(placed.groupBy("part")).applyInArrow(links_among(width, percent), "a long, b long"), "chosen-links")
    release(placed)
    return out


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, root) after more links: only components are joined, by links between what is known of them."""
    if labels is None:
        return materialize(components(links), "chosen-labels")
    between = links
    for side in ("a", "b"):
        between = between.join(labels.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    merged = materialize(components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "chosen-merged")
    onward = labels.join(merged.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left")
    out = materialize(onward.select("node", F.coalesce("higher", "root").alias("root")).union(merged.join(labels, "node", "left_anti").select("node", "root")), "chosen-labels")
    release(labels)
    release(merged)
    return out


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80, trees: int = 10, small: int = 128, levels: int = 6, part_tokens: int = 250_000) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets; null for the empty one), component_id (least doc_id that links reach)."""
    if not 0 < trees <= ROOTS:
        raise ValueError(f"trees must be from 1 to {ROOTS}")
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, class long, n long, keys array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    signed = materialize(docs.mapInArrow(sign(width, ROOTS + PER_LEVEL * (levels - 1)), kind), "chosen-signed")
    some = signed.where("class is not null")
    held = materialize(some.select("class", "n", "keys", *SKETCH).dropDuplicates(["class"]), "chosen-classes")

    # the first level of all trees; classes that stand alone in all their nodes go no further
    roots = held.select("class", F.posexplode(F.slice("keys", 1, trees)).alias("tree", "key")).select(F.xxhash64("tree", "key").alias("node"), "class")
    shared = roots.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    together = materialize(roots.join(shared, "node"), "chosen-roots")
    weights = together.groupBy("class").agg(F.sum("size").alias("weight"))
    rows = materialize(together.select("node", "class").join(weights, "class").select("node", "class", "weight"), "chosen-nodes")
    release(together)
    tidy(spark)
    opened = rows.select("class").distinct()
    bodies = materialize(docs.mapInArrow(texts_of(width), "class long, text string").join(opened, "class", "left_semi").dropDuplicates(["class"]), "chosen-texts")
    tidy(spark)

    made = [signed, held, rows, bodies]
    labels, waiting, branching = None, None, None

    def confirmed(pairs: DataFrame) -> None:
        """Adds the links among pairs, and brings the labels up to date."""
        nonlocal labels
        found = materialize(pairs.distinct(), "chosen-pairs")
        made.append(found)
        if labels is None or found.take(1):
            labels = relabelled(labels, confirm(found, bodies, width, percent, part_tokens))
            tidy(spark)

    for level in range(1, levels + 1):
        named = labelled(rows, labels)
        pairs = with_centres(named, crowded(named), held, percent)
        confirmed(pairs if waiting is None else pairs.union(waiting))
        named = labelled(rows, labels)
        nodes = materialize(crowded(named), "chosen-crowded")
        made.append(nodes)
        last = level == levels
        waiting = within(named, nodes if last else nodes.where(F.col("size") <= small), held, percent)
        large = nodes.where(F.col("size") > small)
        if last or not large.take(1):
            break
        if branching is None:
            which = named.join(large.select("node"), "node").groupBy("class").agg(F.max("weight").alias("weight"))
            branching = materialize(which.join(held.select("class", "keys"), "class"), "chosen-branching")
            made.append(branching)
        rows = materialize(children(named, large, branching, level), "chosen-nodes")
        made.append(rows)
    confirmed(waiting)

    heads = some.groupBy("class").agg(F.min("doc_id").alias("head"))
    named = heads.join(labels, heads["class"] == labels["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "head")
    least = named.groupBy("root").agg(F.min("head").alias("component"))
    classes = materialize(named.join(least, "root").select(F.col("class").alias("_class"), "component"), "chosen-components")
    found = signed.select("doc_id", "n", "class").join(classes, F.col("class") == F.col("_class"), "left")
    out = materialize(found.select("doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("component", "doc_id").alias("component_id")), "chosen-result")
    for t in (*made, labels, classes):
        release(t)
    return out
