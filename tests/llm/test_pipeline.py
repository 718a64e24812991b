"""The corpus pipeline against what its stages should do by brute force, and the SQL of the operators."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import duckdb
import pytest
from tests_llm_helpers import contaminated, groups

import corpus_pipeline
from spanloom.llm import op2_repetition, op3_decontaminate, op4_toxicity, queries
from spanloom.llm.oracles import SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    names = sorted(df.columns)
    cursor = con.execute(SQL[name])
    at = [[x[0] for x in cursor.description].index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(row[i] for i in at)) for row in cursor.fetchall())


def clean(spark, texts: dict) -> set:
    """Ids that the toxicity stage keeps, by a model trained here on the rows it may learn from, in its order."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("toxic is not null")
    rows = labels.select("doc_id", "toxic", F.xxhash64(F.lit("toxicity sample"), F.col("doc_id").cast("long")).alias("h")).collect()
    hasher = op4_toxicity.Hasher(24)
    learn = sorted((r["h"], r["doc_id"], r["toxic"]) for r in rows if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1)
    model = op4_toxicity.train([(op4_toxicity.slots_of(hasher, texts[i]), y) for _, i, y in learn])
    order = sorted(texts)
    return {i for i, s in zip(order, op4_toxicity.Scorer(model, 24).score([texts[i] for i in order]), strict=True) if s < 0.7}


def test_run_end_to_end(spark):
    """Every decision of every stage, then the mixed texts."""
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    texts = {i: r["text"] for i, r in rows.items()}
    order = sorted(texts)
    kept = op2_repetition.verdicts(op2_repetition.measure([texts[i] for i in order], 8), 0.4, 200, 50)[1]
    left = {i for i, k in zip(order, kept, strict=True) if k}
    left = clean(spark, {i: texts[i] for i in left})
    left = groups({i: texts[i] for i in left})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left -= contaminated({i: texts[i] for i in left}, items, op3_decontaminate.words_of)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} <= left and len(got) == len({r["doc_id"] for r in got})
    taken, size = defaultdict(int), defaultdict(int)
    for i in left:
        size[rows[i]["source"]] += len((texts[i] or "").encode().split())
    for r in got:
        assert (r["text"], r["lang"], r["source"], r["n_chars"]) == tuple(rows[r["doc_id"]][c] for c in ("text", "lang", "source", "n_chars"))
        assert r["size"] == len(r["text"].encode().split()) and 0 < r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in got}
    assert {s: math.floor(t) for s, t in targets.items()} == dict(taken)


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, a column with a clashing name, and empty tables, stage by stage."""
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    kind = base.schema.simpleString()[7:-1].replace(":", " ") + ", taken string, label int"
    row = base.where("length(text) between 500 and 3000").orderBy("doc_id").first()
    rows = [(None, None, None, None, None, "x", 1), (90_001, "", "en", "a", 0, "x", 1), (90_002, None, "en", None, None, "x", 1), (None, "some words", "en", "a", 10, "x", 1)]
    rows += [(row["doc_id"], row["text"], row["lang"], None, row["n_chars"], "x", 1)] * 2 + [(row["doc_id"] + 1, row["text"], row["lang"], "b", row["n_chars"], "x", 1)]
    docs = spark.createDataFrame(rows, kind)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    counts = {"quality rules": 3, "toxicity": 7, "n-gram Jaccard join": 5, "benchmark decontamination": 4 if contaminated({0: row["text"]}, items, op3_decontaminate.words_of) else 7}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == counts[name], name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "size", "source_size", "target", "taken"]
    assert all(0 < r["taken"] <= 3 * r["size"] for r in mixed.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
