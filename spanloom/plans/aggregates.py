"""Aggregations on the adapters: AGG operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..sources.adapters import IV, SC, SEQS, TL, intervals, scored, sequences, table, timeline
from .registry import query

COUNT = F.count


@query("AGG-01", f"""with {TL} select family, count(*)::bigint as n_rows, count(distinct contig)::bigint as n_genomes, count(distinct contig::varchar || '|' || (pos // 86400)::varchar)::bigint as n_contigs,
round(avg((value > 50)::int), 6) as frac_strong, round(count(*) / count(distinct contig), 6) as per_genome from tl group by family""")
def _(spark, d):
    key = F.concat(F.col("contig").cast("string"), F.lit("|"), F.floor(F.col("pos") / 86400).cast("string"))
    out = A.census(timeline(spark, d), "family", {"genomes": F.col("contig"), "contigs": key}, {"strong": (F.col("value") > 50).cast("int")}, "genomes")
    return out.withColumn("frac_strong", F.round("frac_strong", 6)).withColumn("per_genome", F.round("per_genome", 6))


@query("AGG-02", "select lang, count(*)::bigint as indexed, sum((n_chars >= 1000)::int)::bigint as real, round(100.0 * sum((n_chars >= 1000)::int) / count(*), 4) as pct from documents group by lang")
def _(spark, d):
    real = F.sum((F.col("n_chars") >= 1000).cast("long"))
    return table(spark, d, "documents").groupBy("lang").agg(COUNT(F.lit(1)).alias("indexed"), real.alias("real"), F.round(100.0 * real / COUNT(F.lit(1)), 4).alias("pct"))


@query("AGG-03", f"with {SEQS} select clade, count(*)::bigint as members, count(distinct seq)::bigint as distinct_seqs, count(distinct family)::bigint as species, median(length(seq))::double as median_len, round(avg((length(seq) >= 500)::int), 6) as frac_complete, round(1 - count(distinct seq) / count(*), 6) as duplicate_frac from seqs group by clade")
def _(spark, d):
    n, u = COUNT(F.lit(1)), F.countDistinct("seq")
    return sequences(spark, d).groupBy("clade").agg(n.alias("members"), u.alias("distinct_seqs"), F.countDistinct("family").alias("species"), F.median(F.length("seq")).alias("median_len"), F.round(F.avg((F.length("seq") >= 500).cast("int")), 6).alias("frac_complete"), F.round(1 - u / n, 6).alias("duplicate_frac"))


@query("AGG-04", f"with {SEQS} select clade, sum((family = 'en')::int)::bigint as n_first, case when avg((family = 'en')::int) > 0.5 then 'dominant' else 'mixed' end as call from seqs group by clade")
def _(spark, d):
    return A.dominance(sequences(spark, d), "clade", F.col("family") == "en")


@query("AGG-05", f"with {TL}, n as (select contig, family, max((value > 90)::int) as near from tl group by contig, family) select family, round(avg(near), 6) as support, case when avg(near) >= 0.5 then 'supported' when avg(near) >= 0.1 then 'weak' else 'absent' end as band from n group by family")
def _(spark, d):
    out = A.neighbour_support(timeline(spark, d), "contig", "family", F.col("value") > 90)
    return out.withColumn("support", F.round("support", 6))


@query("AGG-06", "with g as (select p_type, p_brand, count(*)::bigint as n, median(p_retailprice) as m from part group by p_type, p_brand), r as (select *, row_number() over (partition by p_type order by n desc, coalesce(nullif(m, 0.0), 1.0), p_brand) as rn from g) select p_type, p_brand, n from r where rn = 1")
def _(spark, d):
    g = table(spark, d, "part").groupBy("p_type", "p_brand").agg(COUNT(F.lit(1)).alias("n"), F.median("p_retailprice").alias("m"))
    return A.ladder_choice(g, "p_type", "p_brand", "n", "m")


@query("AGG-07", "select coalesce(lang, 'TOTAL') as lang, coalesce(source, 'ALL') as source, count(*)::bigint as n, sum(n_chars)::bigint as chars from documents group by rollup (lang, source)")
def _(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(COUNT(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("TOTAL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n", "chars")


_EV = "m as (select grp, member, min(s) as s, max(e) as e from iv group by grp, member), ev as (select grp, s as x, 1 as d from m union all select grp, e, -1 from m), c as (select grp, x, sum(d) as d from ev group by grp, x), cov as (select grp, x, sum(d) over (partition by grp order by x) as depth from c)"


@query("AGG-08", f"with {IV}, {_EV} select grp, max(depth)::bigint as max_depth, count(*)::bigint as breaks from cov group by grp")
def _(spark, d):
    from ..operators.sweep import coverage

    return coverage(intervals(spark, d), "grp", "member").groupBy("grp").agg(F.max("depth").alias("max_depth"), COUNT(F.lit(1)).alias("breaks"))


@query("AGG-09", f"""with {IV}, t as (select count(distinct member) as n from iv), g as (select grp, count(distinct member)::double as members, median(s) as ms, median(e - s) as ml, avg((s % 2)::double) as odd from iv group by grp),
dev as (select iv.grp, median(abs(s - ms)) as mads, median(abs((e - s) - ml)) as madl from iv join g on iv.grp = g.grp group by iv.grp)
select g.grp, round(members / t.n * (1 / (1 + mads / 50)) * greatest(odd, 1 - odd) * greatest(0, 1 - madl / ml), 6) as composite from g join dev on g.grp = dev.grp, t""")
def _(spark, d):
    from ..operators.blocks import composite_score

    iv = intervals(spark, d)
    total = iv.select("member").distinct().count()
    return composite_score(iv.withColumn("strand", F.when(F.col("s") % 2 == 0, "+").otherwise("-")), "grp", "member", total).select("grp", F.round("composite", 6).alias("composite"))


@query("AGG-10", f"with {IV}, g as (select grp, median(s) as m, count(*) as n from iv group by grp) select g.grp, m::double as median, case when max(n) < 2 then 0.0 else median(abs(s - m)) end as mad from iv join g on iv.grp = g.grp group by g.grp, m")
def _(spark, d):
    return A.mad(intervals(spark, d), "grp", "s")


@query("AGG-11", "with c as (select source, lang, count(*)::bigint as n from documents group by source, lang), r as (select *, row_number() over (partition by source order by n desc, lang) as rn from c) select source, lang, n from r where rn = 1")
def _(spark, d):
    return A.modal(table(spark, d, "documents"), ["source"], "lang")


@query("AGG-12", f"with {SC}, g as (select source, list_sort(list(len)) as v from sc group by source) select source, v[len(v) // 2 + 1] as upper_median, v[floor(0.9 * len(v))::int + 1] as p90, v[len(v)] as most from g")
def _(spark, d):
    return A.at_fractions(scored(spark, d), ["source"], "len", {"upper_median": 0.5, "p90": 0.9}, clamp=False)


_DEC = "x as (select o_orderkey, o_orderpriority as fam, o_totalprice as score, o_orderkey % 4 = 0 as decoy from orders)"


@query("AGG-13", f"with {_DEC}, w as (select *, sum(decoy::int) over (partition by fam order by score desc) as nd, sum((not decoy)::int) over (partition by fam order by score desc) as nr from x) select o_orderkey, nd / 2 / nr as fdr from w where not decoy")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("fam"), F.col("o_totalprice").alias("score"))
    return A.fdr_at_own_score(x, "fam", "score", F.col("o_orderkey") % 4 == 0, 2).select("o_orderkey", "fdr")


@query("AGG-14", f"with {_DEC} select fam, sum((score >= 400000 and not decoy)::int)::bigint as real_080, sum((score >= 450000 and not decoy)::int)::bigint as real_090, case when sum(decoy::int) >= 50 then sum((score >= 400000 and decoy)::int)::bigint end as decoy_080 from x group by fam")
def _(spark, d):
    decoy, score = F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")
    n = lambda c: F.sum(c.cast("long"))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("fam")).agg(n((score >= 400000) & ~decoy).alias("real_080"), n((score >= 450000) & ~decoy).alias("real_090"), F.when(n(decoy) >= 50, n((score >= 400000) & decoy)).alias("decoy_080"))


@query("AGG-15", "with x as (select o_orderstatus as mode, list_sort(list(o_totalprice)) as v from orders where o_orderstatus <> 'O' group by o_orderstatus) select mode, v[len(v)] as most, v[least(len(v) - 1, floor(0.99 * len(v)))::int + 1] as p99, v[least(len(v) - 1, floor(0.9 * len(v)))::int + 1] as p90, v[least(len(v) - 1, floor(0.5 * len(v)))::int + 1] as median from x")
def _(spark, d):
    x = table(spark, d, "orders").where("o_orderstatus <> 'O'").withColumnRenamed("o_orderstatus", "mode")
    return A.at_fractions(x, ["mode"], "o_totalprice", {"p99": 0.99, "p90": 0.9, "median": 0.5})


_GRID = "k as (select distinct c_custkey as bag from customer), g as (select bag, unnest(['F', 'O', 'P']) as mode from k), h as (select o_custkey as bag, o_orderstatus as mode, count(*)::bigint as n, sum((o_totalprice >= 450000)::int)::bigint as strong from orders group by 1, 2)"


@query("AGG-16", f"with {_GRID} select g.bag, g.mode, n, case when h.n is null then 'none' when strong = 0 then 'clean' when strong < n / 2 then 'weak' else 'strong' end as strength from g left join h on g.bag = h.bag and g.mode = h.mode")
def _(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("bag")).distinct()
    held = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("bag"), F.col("o_orderstatus").alias("mode")).agg(COUNT(F.lit(1)).alias("n"), F.sum((F.col("o_totalprice") >= 450000).cast("long")).alias("strong"))
    strength = F.when(F.col("n").isNull(), "none").when(F.col("strong") == 0, "clean").when(F.col("strong") < F.col("n") / 2, "weak").otherwise("strong")
    return A.grid(keys, ("F", "O", "P")).join(held, ["bag", "mode"], "left").select("bag", "mode", "n", strength.alias("strength"))


@query("AGG-17", f"with {_GRID} select g.bag, bool_and(coalesce(strong, 0) = 0) as strict_clean, count(h.n)::bigint as modes_run from g left join h on g.bag = h.bag and g.mode = h.mode group by g.bag")
def _(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("bag")).distinct()
    held = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("bag"), F.col("o_orderstatus").alias("mode")).agg(COUNT(F.lit(1)).alias("n"), F.sum((F.col("o_totalprice") >= 450000).cast("long")).alias("strong"))
    return A.grid(keys, ("F", "O", "P")).join(held, ["bag", "mode"], "left").groupBy("bag").agg(F.bool_and(F.coalesce("strong", F.lit(0)) == 0).alias("strict_clean"), COUNT("n").alias("modes_run"))


@query("AGG-19", f"with {SEQS}, k as (select *, row_number() over (partition by clade order by sha1('1:' || id::varchar), id) <= 20 as kept from seqs) select clade, count(*)::bigint as pre, sum(kept::int)::bigint as post, count(distinct seq)::bigint as pre_distinct, count(distinct case when kept then seq end)::bigint as post_distinct, case when count(distinct case when kept then seq end) < 20 then 'low' else '' end as flag from k group by clade")
def _(spark, d):
    from ..operators.sampling import hash_rank

    k = hash_rank(sequences(spark, d), ["clade"], "id", 1).withColumn("kept", F.col("rank") <= 20)
    post = F.countDistinct(F.when(F.col("kept"), F.col("seq")))
    return k.groupBy("clade").agg(COUNT(F.lit(1)).alias("pre"), F.sum(F.col("kept").cast("long")).alias("post"), F.countDistinct("seq").alias("pre_distinct"), post.alias("post_distinct"), F.when(post < 20, "low").otherwise("").alias("flag"))


@query("AGG-20", """with t as (select distinct source as bag, doc_id as rep, unnest(string_split(lower(text), ' ')) as dom from documents), v as (select * from t where dom in ('the', 'of', 'der', 'die', 'les', 'que', 'de', 'los')),
n as (select bag, count(distinct rep)::bigint as any_hit from v group by bag), c as (select bag, dom, count(*)::bigint as reps from v group by bag, dom), r as (select *, row_number() over (partition by bag order by reps desc, dom) as rn from c)
select bag, dom as top_domain, reps, any_hit from r join n using (bag) where rn = 1""")
def _(spark, d):
    words = ["the", "of", "der", "die", "les", "que", "de", "los"]
    docs = table(spark, d, "documents").select(F.col("source").alias("bag"), F.col("doc_id").alias("rep"), F.array_intersect(F.array_distinct(F.split(F.lower("text"), " ")), F.array(*map(F.lit, words))).alias("doms"))
    hit = docs.where(F.size("doms") > 0).groupBy("bag").agg(F.countDistinct("rep").alias("any_hit"))
    top = A.modal(docs.select("bag", "rep", F.explode("doms").alias("dom")), ["bag"], "dom")
    return top.join(hit, "bag").select("bag", F.col("dom").alias("top_domain"), F.col("n").alias("reps"), "any_hit")


@query("AGG-21", "with m as (select l_suppkey as bag, l_returnflag as dom, min(l_discount) as e from lineitem group by 1, 2), b as (select bag, min(e) as e, min(case when dom = 'R' then e end) as curated from m group by bag) select bag, case when curated <= 0.0 then 'curated' when e <= 0.01 then 'sub_threshold_lead' else 'orphan' end as status from b")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "bag")
    return A.sensitive_status(lines, "bag", "l_returnflag", "l_discount", F.col("l_returnflag") == "R", 0.0, 0.01)


@query("AGG-22", "with p as (select l_suppkey as target, l_returnflag as source, count(distinct l_partkey)::bigint as n from lineitem group by 1, 2) select target, count(*)::bigint as sources, sum(n)::bigint as distinct_sum, round(max(n) / sum(n), 6) as max_source_fraction, case when max(n) / sum(n) <= 0.4 then 'strong' else 'weak' end as pool from p group by target")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "target")
    return A.pool_summary(lines, "target", "l_returnflag", "l_partkey").withColumn("max_source_fraction", F.round("max_source_fraction", 6))


@query("AGG-23", f"with {SC} select source, round(avg(len), 4) as mean, max(len) as most, median(len) as median from sc where words >= 20 group by source")
def _(spark, d):
    return scored(spark, d).where("words >= 20").groupBy("source").agg(F.round(F.avg("len"), 4).alias("mean"), F.max("len").alias("most"), F.median("len").alias("median"))


@query("AGG-24", "select conv_id, median(length(text))::double as inserted, median(case when role = 'user' then length(text) end)::double as noncoding, median(length(text))::double - coalesce(median(case when role = 'user' then length(text) end)::double, 0) as coding from conversations group by conv_id")
def _(spark, d):
    n = F.length("text")
    return A.element_records(table(spark, d, "conversations"), "conv_id", n, F.when(F.col("role") == "user", n))


@query("AGG-25", f"with {TL}, c as (select contig, family, count(*)::bigint as n from tl group by contig, family), r as (select *, row_number() over (partition by contig order by n desc, family) as rn, sum(n) over (partition by contig) as t from c) select contig, family as side, round(n / t, 6) as frac from r where rn = 1")
def _(spark, d):
    total = timeline(spark, d).groupBy("contig").agg(COUNT(F.lit(1)).alias("t"))
    return A.modal(timeline(spark, d), ["contig"], "family").join(total, "contig").select("contig", F.col("family").alias("side"), F.round(F.col("n") / F.col("t"), 6).alias("frac"))


@query("AGG-26", f"with {TL}, g as (select contig, avg((family = 'view')::int) as up, avg((family = 'click')::int) as down, median(value) as mv from tl group by contig) select contig, up >= 0.15 as accept_up, down >= 0.15 as accept_down, round(greatest(0, mv - 20) + 5, 6) as extent from g")
def _(spark, d):
    out = A.element_geometry(timeline(spark, d), "contig", F.col("family") == "view", F.col("family") == "click", F.col("value"), F.lit(20.0), 5)
    return out.withColumn("extent", F.round("extent", 6))


@query("AGG-27", f"with {IV} select grp, min(s)::bigint as first_s, max(e)::bigint as last_e, sum(e - s)::bigint as total, case when bool_or(piece = 1) and bool_or(piece = 2) then 'both' when bool_or(piece = 1) then 'first' when bool_or(piece = 2) then 'second' else 'other' end as architecture, min(piece)::bigint as best from iv group by grp")
def _(spark, d):
    sides = {"first": F.col("piece") == 1, "second": F.col("piece") == 2}
    return A.locus_rollup(intervals(spark, d).withColumn("verdict", F.col("piece").cast("long")), "grp", "s", "e", sides, "verdict")


@query("AGG-28", f"with {SC}, g as (select lang, list_sort(list(len)) as v from sc group by lang) select lang, v[least(len(v) - 1, floor(0.25 * len(v)))::int + 1] as q1, v[least(len(v) - 1, floor(0.75 * len(v)))::int + 1] as q3 from g")
def _(spark, d):
    return A.at_fractions(scored(spark, d), ["lang"], "len", {"q1": 0.25, "q3": 0.75}).drop("most")


_PAIRED = "p as (select a.clade, a.rn as x, b.rn as y, greatest(length(a.seq), length(b.seq)) as n, a.seq as sa, b.seq as sb from k a join k b on a.clade = b.clade and a.rn < b.rn), c as (select clade, x, y, n, unnest(string_split(sa, '')) as u, unnest(string_split(sb, '')) as v from p), i as (select clade, x, y, count(*) filter (where u = v) / any_value(n) as identity from c group by clade, x, y)"
_RANKED = "r as (select clade, seq, row_number() over (partition by clade order by id) as rn, count(*) over (partition by clade) as n from seqs where length(seq) > 0)"


@query("AGG-29", f"with {SEQS}, {_RANKED}, k as (select * from r where rn <= 60), {_PAIRED} select clade, round(avg(identity), 6) as mean_identity from i group by clade")
def _(spark, d):
    """Over the first 60 whole sequences of a clade; where one is shorter the rest counts as a gap."""
    from ..operators.similarity import mean_pairwise_identity

    rows = sequences(spark, d).where(F.length("seq") > 0).select("clade", "id", "seq")
    return mean_pairwise_identity(rows, "clade", "id", "seq", 60).select("clade", F.round("mean_identity", 6).alias("mean_identity"))


@query("AGG-30", f"with {SEQS}, {_RANKED}, k as (select * from r where (rn - 1) % greatest(1, n // 60) = 0 and (rn - 1) // greatest(1, n // 60) < 60), {_PAIRED} select clade, count(*)::bigint as pairs, round(max(identity), 6) as most from i group by clade")
def _(spark, d):
    from ..operators.sampling import stride
    from ..operators.similarity import pairwise_identity

    rows = sequences(spark, d).where(F.length("seq") > 0).select("clade", "id", "seq")
    return pairwise_identity(stride(rows, "clade", "id", 60), "clade", "id", "seq").groupBy("clade").agg(COUNT(F.lit(1)).alias("pairs"), F.round(F.max("identity"), 6).alias("most"))


@query("AGG-32", f"with {TL} select family as neighbor_group, count(distinct contig)::bigint as n_anchors, min(pos % 10000)::bigint as nearest from tl group by family")
def _(spark, d):
    t = timeline(spark, d).withColumnRenamed("family", "neighbor_group")
    return A.marker_summary(t, "neighbor_group", "contig", F.col("pos") % 10000)


@query("AGG-33", "select o_orderstatus as label, count(*)::bigint as n from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(COUNT(F.lit(1)).alias("n"))
