"""Operator 8, mixing sources to target weights.

Every row gets a hash-random key, the MD5 of seed and id.  Each source is range-partitioned by key into ranges of about
``range_rows`` rows, the key being uniform; the words of a range are summed, a running sum over a source's ranges gives
each range its start, and a running sum inside the range gives each row its own.  A source whose target is T and size S
is taken T // S times whole; the rest is cut at the exact budget along the key order, so a source's taken words differ
from its target by less than one word.  Targets share all words by weight but never exceed ``max_epochs`` times a source's
size; the excess is reshared by weight until none is above, which is solved in closed form from the sources' sorted
ratios of cap to weight.  One row per source is all that is ever brought together.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in order.  Rows
with equal keys are ordered by size, and equal rows stand for each other.  A text of any length is one row of the sort.  A source of size 0 gets target 0.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``sizes``: source, source_size, source_rows, one row each.  Adds target and where a source stands."""
    one = W.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", cycle.cast("long")).withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
    ratio = one.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumn("_left", F.sum("source_size").over(one) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_ws", F.sum("_w").over(after))
    # a source is capped if, with all of smaller ratio capped, its share would reach the cap
    rows = rows.withColumn("_free", F.col("_left") * F.col("_w") < F.col("_cap") * F.col("_ws"))
    first = one.orderBy(F.col("_free").desc(), (F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    level = F.first(F.struct("_left", "_ws")).over(first)
    rows = rows.withColumn("_level", level)
    shared = F.col("_level._left").cast("double") * F.col("_w") / F.col("_level._ws")
    return rows.withColumn("target", F.when(F.col("_free"), shared).otherwise(F.col("_cap").cast("double"))).select("source", "source_size", "source_rows", "target")


FIGURES = ("size", "source_size", "target", "taken")


def mixed_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how: object) -> DataFrame:
    """The mix with its texts: the rows that it takes words of, all columns, and ``FIGURES``, which replace columns so named.

    A row stands for taken // size whole copies and the first taken % size words of one more.
    """
    own = [c for c in docs.columns if c not in FIGURES]
    return mix(docs, key, text, source, carry=own, **how).where("taken > 0").select("_row.*", *FIGURES)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", range_rows: int = 4_000, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; the columns ``carry`` of the row, if any, in a struct ``_row``."""
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = materialize(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("_key"), *([F.struct(*carry).alias("_row")] if carry else [])), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    # written, so that Spark knows its size and broadcasts it only if that is under its threshold
    aims = materialize(targets(sizes, weights, max_epochs).withColumn("_ranges", F.ceil(F.col("source_rows") / range_rows)), "mix-targets")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = aims.withColumnRenamed("source", "_source")
    unit = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranged = rows.join(named, same("source", "_source")).withColumn("_range", F.floor(unit * F.col("_ranges")))
    sums = ranged.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    before = W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_source", "_range").orderBy("_key", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumn("_upto", F.sum("size").over(inside))
    joined = summed.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_start") + F.col("_upto") - F.col("size"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *(["_row"] if carry else []))
