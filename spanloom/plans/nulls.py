"""Null models on the adapters: NUL operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nulls as N
from ..sources.adapters import SEQS, sequences, table
from .registry import query

_PERM = f"""{SEQS}, z as (select family, clade, count(*) as size from seqs group by 1, 2), f as (select family, count(*) as clades, sum(size) as total from z group by 1),
t as (select z.family, z.clade, size as need, ceil(size / (clades - 1)) as quota, unnest([1, 2]) as replicate from z join f using (family) where size >= 8 and clades > 1 and total - size >= size),
p as (select s.family, s.clade as source, s.id, z.size, row_number() over (partition by s.family, s.clade order by sha1('4:' || s.id::varchar), s.id) as own from seqs s join z on s.family = z.family and s.clade = z.clade),
m as (select t.family, t.clade, t.need, t.quota, t.replicate, p.source, p.id, p.size, row_number() over (partition by t.family, t.clade, t.replicate, p.source order by sha1('4:' || t.replicate::varchar || ':' || t.clade || ':' || p.id::varchar), p.id) as rk from t join p on t.family = p.family and p.source <> t.clade and p.own <= t.need),
k as (select *, row_number() over (partition by family, clade, replicate order by (rk > quota)::int, rk, size desc, source) as turn from m),
dec as (select family, clade, replicate, source, id from k where turn <= need)"""


def _decoys(spark, d):
    return N.permutation_decoys(sequences(spark, d).select("family", "clade", "id"), "family", "clade", "id", 2, 4)


@query("NUL-01", f"with {_PERM} select family, clade, replicate::bigint as replicate, source, id, count(*) over (partition by family, clade, replicate, source)::bigint as taken_from from dec")
def _(spark, d):
    return _decoys(spark, d).withColumn("replicate", F.col("replicate").cast("long"))


@query("NUL-02", f"with {_PERM}, a as (select family, clade, replicate, source, count(*) as n from dec group by 1, 2, 3, 4), q as (select family, clade, replicate, count(*) < 4 or max(n) / sum(n) > 0.5 as degenerate from a group by 1, 2, 3), s as (select family, avg(degenerate::int) as share from q group by 1) select f.family, case when share is null then 'none' when share > 0.5 then 'degenerate' else 'strong' end as strength from (select distinct family from seqs) f left join s on f.family = s.family")
def _(spark, d):
    return N.family_strength(sequences(spark, d).select("family").distinct(), N.decoy_quality(_decoys(spark, d), "family", "clade"), "family")


def _windows(spark, d):
    return sequences(spark, d).where(F.length("seq") >= 600).select("id", "clade", F.length("seq").cast("long").alias("n"), (F.col("id") % 300).alias("off"), F.lit(60).cast("long").alias("alen"))


_U = "('0x' || left(sha1({0}), 8))::bigint"
_W = f"{SEQS}, w as (select id, clade, length(seq)::bigint as n, id % 300 as off, 60 as alen from seqs where length(seq) >= 600)"


@query("NUL-03", f"with {_W}, r as (select *, greatest(0, off - 2000 - alen + 1) as rl, off + alen + 2000 as rf, greatest(0, n - alen - (off + alen + 2000) + 1) as rr from w), a as (select *, {_U.format(chr(39) + '6:' + chr(39) + ' || id::varchar')} % greatest(rl + rr, 1) as u from r) select id, case when rl + rr > 0 then case when u < rl then u else rf + u - rl end end::bigint as place from a")
def _(spark, d):
    got = N.shuffled_anchors(_windows(spark, d), "id", "off", "alen", "n", 2000, 6)
    back = F.when(F.col("pseudo_strand") < 0, F.col("n") - F.col("pseudo_offset") - F.col("alen")).otherwise(F.col("pseudo_offset"))
    return got.select("id", back.cast("long").alias("place"))


@query("NUL-04", f"with {_W}, c as (select clade, max(n) as contig_len from w group by clade), k as (select id, clade, 500 as len from w) select id, ({_U.format(chr(39) + '8:1:' + chr(39) + ' || id::varchar')} % (contig_len - 500 + 1))::bigint as start, ({_U.format(chr(39) + '8:1:' + chr(39) + ' || id::varchar')} % (contig_len - 500 + 1) + 500)::bigint as \"end\" from k join c using (clade) where contig_len >= 500")
def _(spark, d):
    w = _windows(spark, d)
    contigs = w.groupBy("clade").agg(F.max("n").alias("contig_len"))
    return N.background(w.select("id", "clade", F.lit(500).cast("long").alias("len")), contigs, "clade", "id", "len", 8).select("id", "start", "end")


@query("NUL-05", f"with {_PERM} select clade || '__rep' || replicate::varchar || '__' || dec.id::varchar as decoy_id, length(seq)::bigint as n from dec join (select id, seq from seqs) s on dec.id = s.id")
def _(spark, d):
    made = _decoys(spark, d).withColumn("decoy_id", F.concat("clade", F.lit("__rep"), F.col("replicate").cast("string"), F.lit("__"), F.col("id").cast("string")))
    proteins = sequences(spark, d).select("id", F.length("seq").cast("long").alias("n"))
    return N.renamed(proteins, made, "id", ["decoy_id", "n"])


@query("NUL-06", f"with {_PERM}, a as (select family, clade, count(*) as made from dec where replicate = 1 group by 1, 2) select z.family, z.clade, case when made is null or made = 0 then 'none' when made >= 0.9 * size then 'matched' else 'short' end as state from z left join a on z.family = a.family and z.clade = a.clade")
def _(spark, d):
    made = _decoys(spark, d).where("replicate = 1").groupBy("family", "clade").agg(F.count(F.lit(1)).alias("made"))
    sizes = sequences(spark, d).groupBy("family", "clade").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(made, ["family", "clade"], "left").select("family", "clade", N.manifest(F.col("made"), F.col("size")).alias("state"))


@query("NUL-07", f"""with {_PERM}, g as (select family, clade, id, length(seq) // 400 as cluster from seqs),
best as (select family, clade, max(n) / any_value(sites) as best from (select family, clade, cluster, count(distinct id) as n, sum(count(distinct id)) over (partition by family, clade) as sites from g group by 1, 2, 3) group by 1, 2),
dr as (select dec.family, dec.clade, dec.replicate, dec.id, g.cluster from dec join g on dec.family = g.family and dec.id = g.id),
nu as (select family, clade, replicate, max(n) / any_value(sites) as v from (select family, clade, replicate, cluster, count(distinct id) as n, sum(count(distinct id)) over (partition by family, clade, replicate) as sites from dr group by 1, 2, 3, 4) group by 1, 2, 3)
select b.family, b.clade, round(best, 6) as best, round(avg(v), 6) as null_mean, round(max(v), 6) as null_max, case when count(v) > 0 then (count(*) filter (where v >= best) + 1) / (count(v) + 1) end as p from best b left join nu on b.family = nu.family and b.clade = nu.clade group by b.family, b.clade, best""")
def _(spark, d):
    """Sites are documents, a site's region is in the cluster of its length; decoys draw sites of the family's other bags."""
    from ..operators.records import region_null

    regions = sequences(spark, d).select("family", "clade", "id", F.floor(F.length("seq") / 400).alias("cluster"))
    out = region_null(regions, _decoys(spark, d), "family", "clade", "id", "cluster")
    return out.select("family", "clade", *[F.round(c, 6).alias(c) for c in ("best", "null_mean", "null_max")], "p")


@query("NUL-08", "with p as (select s_nationkey, s_suppkey as bag, sum((l_returnflag = 'R')::int)::bigint as r, count(*)::bigint as n from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2), o as (select a.bag, a.r, a.n, b.r as orr, b.n as onn, row_number() over (partition by a.bag order by b.bag) as rn from p a left join p b on a.s_nationkey = b.s_nationkey and a.bag <> b.bag), k as (select bag, any_value(r) as r, any_value(n) as n, sum(orr) as orr, sum(onn) as onn from o where rn <= 3 group by bag) select bag, round(r / n / nullif(orr / nullif(onn, 0), 0), 6) as enrichment from k")
def _(spark, d):
    from ..operators.aggregate import off_bag_enrichment

    lines, s = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    p = lines.join(s, lines["l_suppkey"] == s["s_suppkey"]).groupBy("s_nationkey", F.col("s_suppkey").alias("bag")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("r"), F.count(F.lit(1)).alias("n"))
    return off_bag_enrichment(p, "s_nationkey", "bag", "r", "n").withColumn("enrichment", F.round("enrichment", 6))