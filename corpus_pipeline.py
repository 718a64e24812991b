"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination and mixing, each over what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back before the next one.

Cases, by stage.  Quality rules: null and empty texts fail them.  Toxicity: learns from the labels whose documents are still
there; without any nothing is rejected, as every score is then 0.5.  Near-duplicates: the least id of a group stays; rows
with a null id stay, rows that share an id go together.  Decontamination: without benchmark items all stays.  Mixing: rows
that no word is taken of are left out; a null source is a source of its own.  Empty tables give empty tables, repeated rows
are judged alike, very long texts are taken whole, and columns beyond those of documents are carried along, whatever their
names; only mixing adds its own figures, in the place of columns with the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import op2_repetition, op3_decontaminate, op4_toxicity, op8_mix, op9_jaccard
from spanloom.llm.common import is_remainder, made, materialize, release, release_since, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_repetition.keep(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 3, 1))
    return op4_toxicity.keep(docs, op4_toxicity.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: the rows that are taken, all their columns, and size, source_size, target and taken words."""
    return op8_mix.mixed_corpus(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Learned scores and suffix arrays are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, mark = docs, made()
        docs = materialize(stage(spark, before, sf_dir), name.replace(" ", "-"))
        release(before)
        release_since(mark, docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
