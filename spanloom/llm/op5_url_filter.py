"""Operator 5, URL filtering with host-suffix and path-prefix expressions.

Every distinct URL is expanded into its host suffixes (whole labels) combined with the path prefixes whose lengths occur
among the rules.  Expressions meet the rules in an equi-join on a short prefix of their SHA-256; the full digests then
confirm a match, and among confirmed rules the longest expression wins, ties going to the longer path, then to ``block``.
Only DataFrame functions are used.  URLs are made distinct first, so a URL that a third of the rows share is expanded
once; Spark broadcasts the rules only when its own size estimate is under ``spark.sql.autoBroadcastJoinThreshold``.

URLs of any length are judged whole.

Cases: a null URL, or one without ``://``, has an empty host and path and no rule.  A path not starting with the rule's
(such as an empty one) does not fit.  URLs without a matching rule get ``default``.  Repeated rows are judged one by one;
an empty table or rule list works.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rules_table(pages: DataFrame, rules: Sequence[Rule], digits: int) -> DataFrame:
    spark = pages.sparkSession
    rows = spark.createDataFrame([(v, h.lower(), p, h.lower() + p) for v, h, p in rules], "verdict string, rule_host string, rule_path string, rule string")
    return rows.withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)).withColumn("short", F.substring("digest", 1, digits))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow", digits: int = 8) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    listed = rules_table(pages, rules, digits)
    lengths = sorted({len(p) for _, _, p in rules})
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url"))
    distinct = rows.where("_url is not null").select("_url").distinct().withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    labels = F.split("host", "\\.")
    # no suffix with more labels than the longest host of a rule can match one
    longest = max([h.count(".") + 1 for _, h, _ in rules], default=1)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (longest - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda x: x.isNotNull()))
    wide = distinct.where("host <> ''").select("_url", F.explode(hosts).alias("_host"), paths.alias("_paths")).select("_url", F.explode("_paths").alias("_path"), "_host")
    wide = wide.withColumn("_digest", F.sha2(F.concat_ws("\n", "_host", "_path"), 256)).select("_url", "_digest", F.substring("_digest", 1, digits).alias("short"))
    matched = wide.join(listed, "short").where(F.col("_digest") == F.col("digest"))
    rank = F.struct(F.length("rule"), F.length("rule_path"), F.col("verdict"))
    best = matched.groupBy("_url").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    # null URLs have no partner and would all meet in one task of the join
    met = rows.where("_url is not null").join(best, "_url", "left").select("page_id", "_url", "best")
    met = met.unionByName(rows.where("_url is null").select("page_id", "_url", F.lit(None).cast(best.schema["best"].dataType).alias("best")))
    joined = met.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
