"""Windows, samples and orders on the adapters: WIN, SMP and SRT operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sampling as P
from ..operators import sweep
from ..sources.adapters import IV, SC, SEQS, TL, intervals, scored, sequences, table, timeline
from .registry import query

_COV = "m as (select grp, member, min(s) as s, max(e) as e from iv group by grp, member), ev as (select grp, s as x, 1 as d from m union all select grp, e, -1 from m), c as (select grp, x, sum(d) as d from ev group by grp, x), cov as (select grp, x, sum(d) over (partition by grp order by x) as depth, lead(x) over (partition by grp order by x) as nx from c)"


@query("WIN-01", f"with {IV}, {_COV}, k as (select *, depth >= 5 as ok from cov), t as (select *, case when ok <> coalesce(lag(ok) over (partition by grp order by x), false) then 1 else 0 end as turn from k), r as (select *, sum(turn) over (partition by grp order by x rows unbounded preceding) as run from t) select grp, min(x)::bigint as s, max(nx)::bigint as e from r where ok and nx is not null group by grp, run")
def _(spark, d):
    return sweep.runs(sweep.coverage(intervals(spark, d), "grp", "member"), "grp", 5)


@query("WIN-02", f"with {IV}, w as (select grp, s, e, max(e) over (partition by grp order by s, e rows between unbounded preceding and 1 preceding) as reach from iv), i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by grp order by s, e rows unbounded preceding) as k from w) select grp, min(s)::bigint as s, max(e)::bigint as e from i group by grp, k")
def _(spark, d):
    return sweep.merge(intervals(spark, d), "grp")


@query("WIN-03", f"with {TL}, r as (select *, row_number() over (partition by contig, family order by value desc, event_id) as rn from tl) select contig, family, event_id, value from r where rn = 1")
def _(spark, d):
    return J.best_of(timeline(spark, d), ["contig", "family"], F.desc("value"), "event_id").select("contig", "family", "event_id", "value")


@query("WIN-04", "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::bigint as rank from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("rank"))


@query("WIN-05", f"with {SC} select doc_id, round((row_number() over (partition by lang order by len, doc_id) + row_number() over (partition by lang order by words, doc_id)) / count(*) over (partition by lang), 6) as rank_sum from sc")
def _(spark, d):
    g = W.partitionBy("lang")
    rank = lambda c: F.row_number().over(g.orderBy(c, "doc_id"))
    return scored(spark, d).select("doc_id", F.round((rank("len") + rank("words")) / F.count(F.lit(1)).over(g), 6).alias("rank_sum"))


@query("WIN-06", f"with {SC} select doc_id, rank() over (partition by lang order by words) + (count(*) over (partition by lang, words) - 1) / 2 as midrank from sc")
def _(spark, d):
    from ..operators.statistics import midranks

    return midranks(scored(spark, d), ["lang"], "words").select("doc_id", "midrank")


@query("WIN-07", "select c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_nationkey desc, c_custkey)::bigint as rank from customer")
def _(spark, d):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), F.desc("c_nationkey"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("rank"))


@query("WIN-08", "select o_orderkey from orders order by case when o_totalprice >= 450000 then 0 else 1 end, o_orderpriority, o_orderstatus, o_totalprice desc, o_orderdate, o_orderkey limit 10")
def _(spark, d):
    band = F.when(F.col("o_totalprice") >= 450000, 0).otherwise(1)
    return table(spark, d, "orders").orderBy(band, "o_orderpriority", "o_orderstatus", F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(10).select("o_orderkey")


@query("WIN-09", "with f as (select p_type, p_brand, min(p_partkey) as first_seen from part group by p_type, p_brand) select p_type, p_brand, dense_rank() over (partition by p_type order by first_seen)::bigint as ordinal from f")
def _(spark, d):
    f = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("first_seen"))
    return f.select("p_type", "p_brand", F.dense_rank().over(W.partitionBy("p_type").orderBy("first_seen")).cast("long").alias("ordinal"))


@query("WIN-10", f"with {TL}, w as (select contig, avg(value) over (partition by contig order by pos, event_id rows between 9 preceding and current row) as a, row_number() over (partition by contig order by pos, event_id) as rn, count(*) over (partition by contig) as n from tl) select contig, round(max(a), 6) as best from w where rn >= least(10, n) group by contig")
def _(spark, d):
    o = W.partitionBy("contig").orderBy("pos", "event_id")
    w = timeline(spark, d).select("contig", F.avg("value").over(o.rowsBetween(-9, 0)).alias("a"), F.row_number().over(o).alias("rn"), F.count(F.lit(1)).over(W.partitionBy("contig")).alias("n"))
    return w.where("rn >= least(10, n)").groupBy("contig").agg(F.round(F.max("a"), 6).alias("best"))


@query("WIN-11")
def _(spark, d):
    from ..operators.blocks import helices

    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("locus"), (F.col("l_partkey") % 60).alias("i"), (F.col("l_partkey") % 60 + 8 + F.col("l_suppkey") % 40).alias("j"))
    return helices(t, "locus")


@query("WIN-12", f"with {SC}, r as (select doc_id, row_number() over (partition by lang order by len, doc_id) as rn, count(*) over (partition by lang) as n from sc) select doc_id, least((rn - 1) // greatest(1, n // 4), 3)::bigint as stratum from r")
def _(spark, d):
    r = scored(spark, d).select("doc_id", F.row_number().over(W.partitionBy("lang").orderBy("len", "doc_id")).alias("rn"), F.count(F.lit(1)).over(W.partitionBy("lang")).alias("n"))
    return r.select("doc_id", F.least(F.floor((F.col("rn") - 1) / F.greatest(F.lit(1), F.floor(F.col("n") / 4))), F.lit(3)).cast("long").alias("stratum"))


@query("SMP-01", f"with {SEQS}, r as (select *, row_number() over (partition by clade order by sha1('3:' || id::varchar), id) as rn from seqs) select clade, id from r where rn <= 7")
def _(spark, d):
    return P.hash_sample(sequences(spark, d), ["clade"], "id", 7, 3).select("clade", "id")


def _rows(spark, d):
    return sequences(spark, d).withColumn("pref", F.length("seq"))


@query("SMP-02")
def _(spark, d):
    return P.sample_groups(_rows(spark, d), "clade", "id", "seq", "pref", 6, 1, "diverse")


_K5 = "case when length(seq) >= 5 then list_distinct([seq[i:i+4] for i in range(1, length(seq) - 3)]) else [seq] end"


@query("SMP-03", f"with {SEQS}, k as (select clade, id, {_K5} as k, row_number() over (partition by clade order by sha1('1:' || id::varchar), id) as rn from seqs), j as (select a.clade, a.id, b.id as seed, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) as j, sha1(sha1('1:' || a.id::varchar) || '|' || b.id::varchar) as tie from k a join k b on a.clade = b.clade and b.rn <= 4), r as (select *, row_number() over (partition by clade, id order by j desc, tie desc) as turn from j) select clade, id, seed from r where turn = 1")
def _(spark, d):
    from ..operators.similarity import nearest_seed

    rows = _rows(spark, d)
    return nearest_seed(rows, P.hash_sample(rows, ["clade"], "id", 4, 1), "clade", "id", "seq", 1)


@query("SMP-04")
def _(spark, d):
    return P.sample_groups(_rows(spark, d), "clade", "id", "seq", "pref", 8, 1)


@query("SMP-05")
def _(spark, d):
    return P.sample_groups(_rows(spark, d), "family", "id", "seq", "pref", 3, 1, "representatives")


@query("SMP-06")
def _(spark, d):
    return P.pick_references(_rows(spark, d), "clade", "id", "seq", "pref", 3)


@query("SMP-07", f"with {SEQS}, r as (select *, row_number() over (partition by clade order by sha1('5:' || id::varchar), id) as rn from seqs) select clade, id, rn <= 12 as selected, case when rn <= 12 then 'kept' else 'capped' end as reason from r")
def _(spark, d):
    r = P.hash_rank(sequences(spark, d), ["clade"], "id", 5)
    return r.select("clade", "id", (F.col("rank") <= 12).alias("selected"), F.when(F.col("rank") <= 12, "kept").otherwise("capped").alias("reason"))


@query("SMP-08", "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as rn, count(*) over (partition by o_custkey) as n from orders) select o_custkey, o_orderkey from r where rn % greatest(1, n // 3) = 0 and rn // greatest(1, n // 3) < 3")
def _(spark, d):
    return P.stride(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SMP-09", "with r as (select lang, doc_id, row_number() over (partition by lang order by sha1('9:' || doc_id::varchar), doc_id) as rn from documents) select lang, doc_id from r where rn <= 25")
def _(spark, d):
    return P.hash_sample(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 25, 9)


@query("SMP-10", "with g as (select s_suppkey, case when s_nationkey % 2 = 0 then 'sib' else 'solo' end as kind, s_acctbal from supplier), r as (select *, row_number() over (partition by kind order by s_acctbal desc, s_suppkey) as rn from g) select s_suppkey, row_number() over (order by rn, case when kind = 'sib' then 0 else 1 end)::bigint as turn from r")
def _(spark, d):
    g = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "sib").otherwise("solo").alias("kind"), "s_acctbal")
    return P.interleave(g, "kind", "sib", F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", F.col("turn").cast("long").alias("turn"))


@query("SMP-11", "with r as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) as rn from lineitem) select l_suppkey, l_orderkey, l_linenumber from r where rn <= 20")
def _(spark, d):
    return P.first_n(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate"), "l_suppkey", 20, "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")


@query("SMP-12", "select l_orderkey % 16 as shard, count(*)::bigint as n from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SMP-13", f"with {SEQS}, r as (select clade, id, row_number() over (partition by clade order by length(seq), id) - 1 as rn, count(*) over (partition by clade) as n from seqs) select clade, id from r where rn = n // 2")
def _(spark, d):
    rows = sequences(spark, d).withColumn("n_bases", F.length("seq"))
    return P.median_length(rows, "clade", "n_bases", "id").select("clade", "id")


@query("SRT-01", "select o_orderkey, o_orderkey % 4 = 0 as decoy, o_totalprice from orders order by decoy, o_totalprice desc, o_orderkey")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4 == 0).alias("decoy"), "o_totalprice").orderBy("decoy", F.desc("o_totalprice"), "o_orderkey")


@query("SRT-02", "select p_partkey, p_brand = 'Brand#1' as benchmark_only, p_retailprice from part order by benchmark_only, p_retailprice desc, p_partkey")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_brand") == "Brand#1").alias("benchmark_only"), "p_retailprice").orderBy("benchmark_only", F.desc("p_retailprice"), "p_partkey")
