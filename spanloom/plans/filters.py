"""Filters and verdicts: FLT operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as U
from ..functions import verdicts as V
from ..sources.adapters import IV, SC, SEQS, TL, intervals, scored, sequences, table, timeline
from .registry import query


@query("FLT-01", "select doc_id, octet_length(encode(text))::bigint as bytes from documents where octet_length(encode(text)) >= 1000")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes >= 1000")


@query("FLT-02", "select doc_id, case when octet_length(encode(text)) < 1024 then 'stub' else 'real' end as state from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.octet_length("text") < 1024, "stub").otherwise("real").alias("state"))


@query("FLT-03", "select l_orderkey, l_linenumber, p_brand from lineitem join part on l_partkey = p_partkey where l_quantity >= 10 and l_discount <= 0.05 and p_size >= 10")
def _(spark, d):
    hits = table(spark, d, "lineitem").where("l_quantity >= 10 and l_discount <= 0.05").select("l_orderkey", "l_linenumber", "l_partkey")
    models = table(spark, d, "part").where("p_size >= 10").select("p_partkey", "p_brand")
    return hits.join(models, hits["l_partkey"] == models["p_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query("FLT-04", "with a as (select l_orderkey, p_type, l_quantity, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rn from lineitem join part on l_partkey = p_partkey) select l_orderkey, p_type from a where rn = 1 and l_quantity >= case p_type when 'ECONOMY' then 20 else 10 end")
def _(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_type")
    best = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    assigned = lines.join(part, lines["l_partkey"] == part["p_partkey"]).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return assigned.where(U.length_floor(F.col("l_quantity"), F.col("p_type"), {"ECONOMY": 20}, 10)).select("l_orderkey", "p_type")


@query("FLT-05", "select l_orderkey, l_linenumber from lineitem where 10 * l_discount >= 0.3 and l_quantity / 50 >= 0.7 and l_tax <= 0.05")
def _(spark, d):
    t = table(spark, d, "lineitem")
    return t.where(U.homologous(10 * F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax"), most_evalue=0.05)).select("l_orderkey", "l_linenumber")


@query("FLT-06", f"""with {SC}, g as (select source, count(distinct doc_id)::bigint as n, avg(quality) as frac, median(len) as med from sc group by source),
r as (select *, concat_ws('; ', case when n < 18 then 'few members' end, case when frac < 0.9 then 'low fraction' end, case when med < 1000 then 'short' end) as reason from g)
select source, reason, reason = '' as selected from r""")
def _(spark, d):
    g = scored(spark, d).groupBy("source").agg(F.countDistinct("doc_id").alias("n"), F.avg("quality").alias("frac"), F.median("len").alias("med"))
    rules = (("few members", F.col("n") < 18), ("low fraction", F.col("frac") < 0.9), ("short", F.col("med") < 1000))
    return g.select("source", V.reasons(rules).alias("reason")).withColumn("selected", F.col("reason") == "")


@query("FLT-07", """with x as (select *, row_number() over (partition by md5(text) order by doc_id) as rn from documents),
y as (select case when rn > 1 then 'duplicate' when lang not in ('en', 'de', 'fr') then 'unknown model' when length(text) = 0 then 'no sequence' when length(text) < 100 then 'too short' else 'kept' end as drop_reason from x)
select drop_reason, count(*)::bigint as n from y group by drop_reason""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.md5("text").alias("h"))
    docs = docs.withColumn("rn", F.row_number().over(W.partitionBy("h").orderBy("doc_id")))
    rules = (("duplicate", F.col("rn") > 1), ("unknown model", ~F.col("lang").isin("en", "de", "fr")), ("no sequence", F.col("n") == 0), ("too short", F.col("n") < 100))
    return docs.select(F.coalesce(V.first_reason(rules), F.lit("kept")).alias("drop_reason")).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query("FLT-08", f"with {IV}, g as (select grp, count(distinct member)::bigint as members, count(*)::bigint as total from iv group by grp) select grp, members, greatest(5, round_even(0.5 * members, 0))::bigint as need from g where members >= greatest(5, round_even(0.5 * total, 0))")
def _(spark, d):
    g = intervals(spark, d).groupBy("grp").agg(F.countDistinct("member").alias("members"), F.count(F.lit(1)).alias("total"))
    need = F.greatest(F.lit(5), F.bround(0.5 * F.col("members"))).cast("long")
    return g.where(F.col("members") >= F.greatest(F.lit(5), F.bround(0.5 * F.col("total")))).select("grp", "members", need.alias("need"))


@query("FLT-09", "select o_orderkey, o_totalprice / 500000 >= 0.9 as high_confidence from orders where o_totalprice / 500000 >= 0.8")
def _(spark, d):
    high = U.confidence(F.col("o_totalprice") / 500000)
    return table(spark, d, "orders").select("o_orderkey", high.alias("high_confidence")).where("high_confidence is not null")


@query("FLT-10", f"with {SC} select case when words - 1 = 0 and len / 500 < 1 then 'no_signal' when len / 500 >= 3 and words - 1 >= 3 and len / 4000 >= 0.8 then 'supported' when len / 500 < 3 then 'underpowered' when words - 1 >= 1 then 'borderline' else 'failed' end as verdict, count(*)::bigint as n from sc group by 1")
def _(spark, d):
    from ..functions.verdicts import covariation_verdict

    v = covariation_verdict(F.col("len") / 500, F.col("words") - 1, F.col("len") / 4000)
    return scored(spark, d).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("FLT-11", "select l_orderkey, l_linenumber from lineitem where l_tax = 0 and 100 - 100 * l_discount >= 95 and l_linenumber <= 3 and 3 * l_quantity >= 118")
def _(spark, d):
    hit = U.full_length_ungapped(F.col("l_tax"), 100 - 100 * F.col("l_discount"), F.col("l_linenumber"), 3 * F.col("l_quantity"))
    return table(spark, d, "lineitem").where(hit).select("l_orderkey", "l_linenumber")


@query("FLT-12", "with h as (select l_orderkey, max(l_quantity) as q, max(l_linenumber) as n from lineitem where l_returnflag = 'R' group by l_orderkey) select o_orderkey, case when q is null then 'unknown_no_sites' when 2 * q >= 80 and n >= 2.5 then 'in_insertion' else 'host_flank' end as origin from orders left join h on o_orderkey = l_orderkey")
def _(spark, d):
    hits = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_linenumber").alias("n"))
    orders = table(spark, d, "orders").select("o_orderkey")
    met = orders.join(hits, orders["o_orderkey"] == hits["l_orderkey"], "left")
    return met.select("o_orderkey", U.insertion_origin(2 * F.col("q"), F.col("n"), F.lit(5)).alias("origin"))


@query("FLT-13", "with p as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id) select d.doc_id, case when q is null then 'untested' when q = 1 and 1 - t >= 0.5 then 'host_present_in_empty' else 'element_borne' end as presence from documents d left join p on d.doc_id = p.doc_id")
def _(spark, d):
    tested = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    presence = U.empty_allele_presence(100.0 * F.col("q"), 1.0 - F.col("t"))
    return table(spark, d, "documents").select("doc_id").join(tested, "doc_id", "left").select("doc_id", presence.alias("presence"))


@query("FLT-14", "with b as (select *, l_suppkey % 50 + 20 as block from lineitem), k as (select l_orderkey, l_linenumber, 2 * l_quantity >= 70 and 10 * l_linenumber >= 0.5 * block as self_palindrome, 1000 * l_discount >= 70 and l_partkey % 60 >= 0.5 * least(block, l_orderkey % 90 + 10) as cross_strand from b) select *, self_palindrome or cross_strand as explained from k")
def _(spark, d):
    """Best hits to the own reverse complement, and to that of the block on the other side."""
    from ..operators.records import palindromic

    block = F.col("l_suppkey") % 50 + 20
    own = palindromic(2 * F.col("l_quantity"), 10 * F.col("l_linenumber"), block)
    cross = palindromic(1000 * F.col("l_discount"), F.col("l_partkey") % 60, F.least(block, F.col("l_orderkey") % 90 + 10))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", own.alias("self_palindrome"), cross.alias("cross_strand"), (own | cross).alias("explained"))


@query("FLT-15", f"with {TL}, g as (select contig, family, pos - lag(pos) over (partition by contig order by pos, event_id) as gap, value from tl) select contig, family, gap from g where value / 100 >= 0.5 and 100 - value <= 40 and family <> 'error' and abs(gap) <= 36000")
def _(spark, d):
    order = W.partitionBy("contig").orderBy("pos", "event_id")
    g = timeline(spark, d).withColumn("gap", F.col("pos") - F.lag("pos").over(order)).withColumn("spread", F.lit(100) - F.col("value"))
    return g.where(U.abutting(F.col("value") / 100, F.col("family"), F.col("gap"), F.col("spread"), 0.5, ("error",), 36000, 40)).select("contig", "family", "gap")


@query("FLT-16", "select * from region")
def _(spark, d):
    from ..operators.audit import require_complete

    shards = table(spark, d, "nation").select(F.col("n_name").alias("shard"), F.lit(True).alias("complete"))
    return require_complete(table(spark, d, "region"), shards)


@query("FLT-17", "select * from region")
def _(spark, d):
    from ..operators.audit import require_columns

    return require_columns(table(spark, d, "region"), ("r_regionkey", "r_name"))


@query("FLT-18", "select * from nation")
def _(spark, d):
    from ..operators.audit import require_rows

    return require_rows(table(spark, d, "nation"), "no rows to diagnose")
