"""Statistics on the adapters: STA operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as T
from ..sources.adapters import SC, scored
from .registry import query

_MR = "rank() over (partition by {g} order by {v}) + (count(*) over (partition by {g}, {v}) - 1) / 2"


def _auc(source: str, group: str, value: str) -> str:
    return f"r as (select {group}, quality, {_MR.format(g=group, v=value)} as mr from {source}), a as (select {group}, sum(case when quality = 1 then mr else 0 end) as s, sum(quality)::bigint as p, count(*) - sum(quality)::bigint as n from r group by {group})"


@query("STA-01", f"with {SC}, {_auc('sc', 'lang', 'len')} select lang, p as n_pos, n as n_neg, case when p > 0 and n > 0 then round((s - p * (p + 1) / 2) / (p * n), 6) end as auc from a")
def _(spark, d):
    return T.auc(scored(spark, d), ["lang"], "len", F.col("quality") == 1).withColumn("auc", F.round("auc", 6))


@query("STA-02")
def _(spark, d):
    return T.permutation_p(scored(spark, d), "doc_id", "len", "quality", 20000, 11)


@query("STA-03", f"with {SC}, r as (select lang, {_MR.format(g='lang', v='len')} as a, {_MR.format(g='lang', v='words')} as b from sc) select lang, case when count(distinct a) > 1 and count(distinct b) > 1 then round(corr(a, b), 6) end as rho from r group by lang")
def _(spark, d):
    return T.spearman(scored(spark, d), ["lang"], "len", "words").withColumn("rho", F.round("rho", 6))


@query("STA-04", f"with {SC} select source, median(len) as m from sc group by source")
def _(spark, d):
    return scored(spark, d).groupBy("source").agg(F.median("len").alias("m"))


_CELLS = f"cells as (select 'len' as axis, least_len, case when len < least_len then null else len end as v, quality from sc, (values (0), (500), (1000)) t(least_len) union all select 'words', least_len, case when len < least_len then null else words end, quality from sc, (values (0), (500), (1000)) t(least_len))"


@query("STA-05", f"with {SC}, {_CELLS}, k as (select axis || ':' || least_len::varchar as cell, v, quality from cells where v is not null), {_auc('k', 'cell', 'v')} select cell, round((s - p * (p + 1) / 2) / (p * n), 6) as auc from a where p > 0 and n > 0")
def _(spark, d):
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v"), F.lit(m).alias("least")) for a in ("len", "words") for m in (0, 500, 1000)])
    cells = scored(spark, d).select("quality", "len", F.explode(axes).alias("c")).where("len >= c.least").select(F.concat("c.axis", F.lit(":"), F.col("c.least").cast("string")).alias("cell"), "c.v", "quality")
    return T.auc(cells, ["cell"], "v", F.col("quality") == 1).where("auc is not null").select("cell", F.round("auc", 6).alias("auc"))


@query("STA-06", f"with {SC}, k as (select lang || ':' || axis as cell, v, quality from (select lang, 'len' as axis, len as v, quality from sc union all select lang, 'words', words, quality from sc)), {_auc('k', 'cell', 'v')}, b as (select cell, case when p > 0 and n > 0 then round((s - p * (p + 1) / 2) / (p * n), 6) end as auc from a) select split_part(cell, ':', 1) as lang, max(case when cell like '%:len' then auc end) as len, max(case when cell like '%:words' then auc end) as words from b group by 1")
def _(spark, d):
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("len", "words")])
    cells = scored(spark, d).select("lang", "quality", F.explode(axes).alias("c")).select("lang", "c.axis", "c.v", "quality")
    return T.auc(cells, ["lang", "axis"], "v", F.col("quality") == 1).groupBy("lang").pivot("axis", ["len", "words"]).agg(F.round(F.first("auc"), 6))


@query("STA-07", f"with {SC}, k as (select 'all' as bench, row_number() over (partition by toxic order by len, doc_id) + row_number() over (partition by toxic order by words, doc_id) as v, quality from sc where words >= 5), {_auc('k', 'bench', 'v')} select bench, p as n_pos, n as n_neg, round((s - p * (p + 1) / 2) / (p * n), 6) as auc from a")
def _(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("toxic")
    rank = lambda c: F.row_number().over(w.orderBy(c, "doc_id"))
    k = scored(spark, d).where("words >= 5").select(F.lit("all").alias("bench"), (rank("len") + rank("words")).alias("v"), "quality")
    return T.auc(k, ["bench"], "v", F.col("quality") == 1).select("bench", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("STA-08", f"with {SC}, r as (select doc_id, lang, len, words, (row_number() over (partition by lang order by len, doc_id) + row_number() over (partition by lang order by words, doc_id)) / (2 * count(*) over (partition by lang)) as score from sc where words >= 5) select doc_id, lang, round(score, 6) as score, case when len < 300 then 'one' when len < 1800 then 'two' else 'many' end as band from r")
def _(spark, d):
    from pyspark.sql import Window as W

    from ..functions.verdicts import band

    w = W.partitionBy("lang")
    rank = lambda c: F.row_number().over(w.orderBy(c, "doc_id"))
    r = scored(spark, d).where("words >= 5").withColumn("score", (rank("len") + rank("words")) / (2 * F.count(F.lit(1)).over(w)))
    return r.select("doc_id", "lang", F.round("score", 6).alias("score"), band(F.col("len"), (300, 1800), ("one", "two", "many")).alias("band"))
