"""Views of the test tables as the engine's data model: sequences, timelines of anchors, and intervals.

``sequences``: id, family, clade, seq over ACGT.  ``timeline``: one row per event at an integer position of its user's
axis.  ``intervals``: half-open day ranges of order lines, member = order, grp = supplier.  The SQL twins are common table
expressions for DuckDB.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[: len(LETTERS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TO_BASES = bytes.maketrans((LETTERS + LETTERS.upper()).encode(), (BASES * 2).encode())
_NO_LETTERS = bytes(c for c in range(256) if chr(c) not in LETTERS + LETTERS.upper())


@F.pandas_udf(StringType())  # a type by name needs a running session, and queries are listed without one
def bases(texts: pd.Series) -> pd.Series:
    """The letters A-Z of a text in either case, as ACGT in turn; all else is left out."""
    return texts.map(lambda t: t.encode().translate(_TO_BASES, _NO_LETTERS).decode(), na_action="ignore")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = bases("text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("family"), F.col("source").alias("clade"), seq.alias("seq"))


SEQS = f"seqs as (select doc_id as id, lang as family, source as clade, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') as seq from documents)"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("contig"), F.unix_timestamp("ts").alias("pos"), F.col("event_type").alias("family"), "value", "props")


TL = "tl as (select event_id, user_id as contig, cast(floor(epoch(ts)) as bigint) as pos, event_type as family, value, props from events)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", days("l_shipdate").alias("b"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", days("o_orderdate").alias("a"))
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return both.select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("member"), F.col("l_linenumber").alias("piece"), F.least("a", "b").alias("s"), F.greatest("a", "b").alias("e")).where("s < e")


_DAY = "date_diff('day', date '1970-01-01', cast({0} as date))"
IV = f"iv as (select l_suppkey as grp, l_orderkey as member, l_linenumber as piece, least({_DAY.format('o_orderdate')}, {_DAY.format('l_shipdate')}) as s, greatest({_DAY.format('o_orderdate')}, {_DAY.format('l_shipdate')}) as e from lineitem join orders on l_orderkey = o_orderkey where cast(o_orderdate as date) <> cast(l_shipdate as date))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two axes: length and words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("len"), F.size(F.split("text", " ")).cast("double").alias("words"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", "lang", "source", "len", "words")


SC = "sc as (select l.doc_id, quality, toxic, lang, source, n_chars::double as len, len(string_split(text, ' '))::double as words from labels l join documents d using (doc_id))"
