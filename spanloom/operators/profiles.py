"""Profile search: position weight matrices from aligned seeds, local alignment with gaps, cutoffs of each model.

A model scores a letter in a column by its log odds in bits; a gap of n letters on either side costs n times ``GAP``.  A
sequence's score is that of its best local alignment to the model's columns.  The library of models goes to every task: it
is refused beyond ``MOST_CELLS`` cells.  Sequences are read where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The letters of proteins.  Others, X too, score nothing in any column.
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
GAP = 4.0
MOST_CELLS = 20_000_000
#: Cells of the tables of one step: sequences aligned at once, times models, times columns.
STEP_CELLS = 2_000_000


def build(seeds: DataFrame, model: str, seq: str, pseudo: float = 1.0) -> DataFrame:
    """model, place, letter, bits: log odds against the letters of all seeds, whose sequences are aligned from the left.

    Seeds of a model may differ in length: a column is made of those that reach it.  ``pseudo`` letters a column, shared out
    as in the background, are added to the counts.
    """
    cut = seeds.select(F.col(model).alias("model"), F.posexplode(F.split(F.upper(seq), "")).alias("place", "letter")).where(F.col("letter").isin(*LETTERS))
    counts = cut.groupBy("model", "place", "letter").agg(F.count(F.lit(1)).alias("n"))
    letters = seeds.sparkSession.createDataFrame([(x,) for x in LETTERS], "letter string")
    total = counts.groupBy("letter").agg(F.sum("n").alias("n"))
    share = (F.coalesce("n", F.lit(0)) + 1) / (F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy()) + len(LETTERS))
    background = letters.join(total, "letter", "left").select("letter", share.alias("q"))
    columns = counts.groupBy("model", "place").agg(F.sum("n").alias("of"))
    every = columns.withColumn("letter", F.explode(F.array(*map(F.lit, LETTERS)))).join(background, "letter")
    full = every.join(counts, ["model", "place", "letter"], "left")
    odds = (F.coalesce("n", F.lit(0)) + pseudo * F.col("q")) / (F.col("of") + pseudo) / F.col("q")
    return full.select("model", F.col("place").cast("int").alias("place"), "letter", F.log2(odds).alias("bits"))


def library(matrices: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names of the models in order, and bits by (model, letter, column); a column that a model lacks cannot be matched."""
    places = matrices.agg(F.count(F.lit(1)), F.countDistinct("model"), F.max("place")).first()
    if max(places[0], (places[1] or 0) * (len(LETTERS) + 1) * ((places[2] or 0) + 1)) > MOST_CELLS:
        raise ValueError(f"the models have more than {MOST_CELLS} cells")
    cells = matrices.toPandas()
    names = sorted(cells["model"].unique())
    table = np.full((len(names), len(LETTERS) + 1, int(cells["place"].max()) + 1 if len(cells) else 0), -1e9)
    at = {x: i for i, x in enumerate(names)}
    table[cells["model"].map(at).to_numpy(int), cells["letter"].map(LETTERS.index).to_numpy(int), cells["place"].to_numpy(int)] = cells["bits"].to_numpy(float)
    for i in range(len(names)):
        table[i, -1, table[i, 0] > -1e9] = 0.0
    return names, table


_AT = np.full(256, len(LETTERS), np.int64)
_AT[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))


def best_scores(texts: list[str], table: np.ndarray, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """By (text, model): the score of the best local alignment, and the letter after its (first) end.

    All texts go forward a letter at a time, with all columns of all models at once.  A gap in the text is a running
    maximum along the columns, as the cost grows evenly.
    """
    models, _, width = table.shape
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    codes = [_AT[np.frombuffer(texts[i].upper().encode("ascii", "replace"), np.uint8)] for i in order]
    sizes = np.array([len(c) for c in codes])
    score, end = np.zeros((len(texts), models)), np.zeros((len(texts), models), np.int64)
    by_letter, slope = np.ascontiguousarray(table.transpose(1, 0, 2)), gap * np.arange(width)
    state = np.zeros((len(texts), models, width))
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, "left"))  # longest first: those that have a letter here
        own, now = state[:live], by_letter[np.array([c[step] for c in codes[:live]])]
        now[:, :, 1:] += own[:, :, :-1]
        now = np.maximum(np.maximum(now, own - gap), 0.0)
        state[:live] = now = np.maximum.accumulate(now + slope, axis=2) - slope
        top = now.max(axis=2)
        better = top > score[:live] + 1e-9
        end[:live][better] = step + 1
        score[:live][better] = top[better]
    back = np.argsort(order)
    return score[back], end[back]


def search(rows: DataFrame, key: str, seq: str, matrices: DataFrame, cutoffs: DataFrame, gap: float = GAP) -> DataFrame:
    """key, model, score, end: sequences that reach a model's cutoff (model, cutoff); models without one find nothing.

    Null and empty sequences have no hits; repeated rows have theirs each.
    """
    names, table = library(matrices)
    bounds = {r["model"]: r["cutoff"] for r in cutoffs.where(F.col("model").isin(names)).collect()} if names else {}
    least = np.array([bounds[x] if bounds.get(x) is not None else np.inf for x in names])
    at_once = max(1, STEP_CELLS // max(1, table.shape[0] * table.shape[2]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.iloc[np.argsort([len(x) for x in batch["seq"]], kind="stable")]
            for start in range(0, len(batch), at_once):
                part = batch.iloc[start : start + at_once]
                score, end = best_scores(part["seq"].tolist(), table, gap)
                i, j = np.nonzero((score >= least) & (score > 0))
                yield pd.DataFrame({key: part[key].to_numpy()[i], "model": [names[x] for x in j], "score": score[i, j], "end": end[i, j]})

    kind = rows.schema[key].dataType.simpleString()
    wanted = rows.select(key, F.col(seq).alias("seq")).where("length(seq) > 0")
    if not names:
        wanted = wanted.limit(0)
    return wanted.mapInPandas(run, f"`{key}` {kind}, model string, score double, end long")


def seed_cutoffs(seeds: DataFrame, model: str, seq: str, matrices: DataFrame) -> DataFrame:
    """model, cutoff: the lowest score that a seed of a model has against it."""
    own = seeds.select(F.col(model).alias("own"), seq)
    any_score = matrices.select("model", F.lit(0.0).alias("cutoff")).distinct()
    return search(own, "own", seq, matrices, any_score).where("own = model").groupBy("model").agg(F.min("score").alias("cutoff"))


def resolve(hits: DataFrame, key: str, families: DataFrame) -> DataFrame:
    """key, family, model, score, end, models: one anchor of each sequence, by its family's priority first, its score second.

    ``families`` has model, family, priority.  Ties go to the first family, then model, by name; ``models`` are all that hit.
    """
    known = hits.join(families.select("model", "family", "priority"), "model")
    w = W.partitionBy(key).orderBy(F.desc("priority"), F.desc("score"), "family", "model", "end")
    ranked = known.withColumn("_rn", F.row_number().over(w)).withColumn("models", F.array_sort(F.collect_set("model").over(W.partitionBy(key))))
    return ranked.where("_rn = 1").select(key, "family", "model", "score", "end", "models")
