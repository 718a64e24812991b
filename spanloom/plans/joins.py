"""Joins and set operations on the adapters: JON and SET operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import joins as J
from ..operators.sweep import merge
from ..sources.adapters import IV, SEQS, TL, intervals, sequences, table, timeline
from .registry import query


@query("JON-01", "select l_orderkey, l_linenumber, p_brand as family from lineitem join part on l_partkey = p_partkey where p_type = 'ECONOMY'")
def _(spark, d):
    hits, models = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part").where("p_type = 'ECONOMY'")
    return hits.join(models, hits["l_partkey"] == models["p_partkey"]).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("family"))


@query("JON-02", "with r as (select l_suppkey::varchar as contig, l_partkey as s, l_partkey + 91 as e, case when l_linenumber % 2 = 0 then '-' else '+' end as strand, l_linestatus || l_quantity::bigint::varchar as aa, l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag <> 'R'), k as (select *, row_number() over (partition by contig, s, strand order by l_orderkey, l_linenumber, l_partkey, aa) as rn from r) select contig, s, e, strand, aa from k where rn = 1")
def _(spark, d):
    """Coordinates from one file and proteins from another, in the same order of genes."""
    from ..operators.records import zip_records
    from ..sources import readers as R
    from .scans import gff_lines

    at = F.split(F.col("attributes")["ID"], "_")
    coords = R.gff(gff_lines(spark, d)).select("contig", "s", "e", "strand", at[0].cast("long").alias("o1"), at[1].cast("int").alias("o2"), F.col("s").alias("o3"), F.col("attributes")["aa"].alias("o4"))
    lines = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    aa = F.concat("l_linestatus", F.col("l_quantity").cast("long").cast("string"))
    proteins = lines.select(F.col("l_suppkey").cast("string").alias("contig"), aa.alias("aa"), F.col("l_orderkey").alias("p1"), F.col("l_linenumber").alias("p2"), F.col("l_partkey").alias("p3"), aa.alias("p4"))
    return zip_records(coords, proteins, "contig", ["o1", "o2", "o3", "o4"], ["p1", "p2", "p3", "p4"], ["s", "e", "strand"])


@query("JON-03", "select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def _(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey")


@query("JON-04", f"with {SEQS} select l.doc_id, length(seq)::bigint as n, substr(seq, 11, 20) as window_seq from labels l join seqs on l.doc_id = seqs.id where length(seq) >= 100")
def _(spark, d):
    contigs = sequences(spark, d).where(F.length("seq") >= 100)
    labels = table(spark, d, "labels").select("doc_id")
    return labels.join(contigs, labels["doc_id"] == contigs["id"]).select("doc_id", F.length("seq").cast("long").alias("n"), F.substring("seq", 11, 20).alias("window_seq"))


@query("JON-05", f"with {TL} select a.event_id, b.event_id as o_event_id, b.family as o_family, b.pos - a.pos as distance from tl a join tl b on a.contig = b.contig and abs(a.pos - b.pos) <= 21600 where a.family = 'purchase' and b.family <> 'purchase'")
def _(spark, d):
    t = timeline(spark, d).select("event_id", "contig", "pos", "family")
    met = J.near(t.where("family = 'purchase'"), t.where("family <> 'purchase'"), "contig", "pos", 21600)
    return met.select("event_id", "o_event_id", "o_family", (F.col("o_pos") - F.col("pos")).alias("distance"))


@query("JON-06", "with r as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rn from lineitem), b as (select l_orderkey, l_suppkey from r where rn = 1) select l.l_orderkey, l.l_linenumber, l.l_suppkey from lineitem l join b on l.l_orderkey = b.l_orderkey and l.l_suppkey = b.l_suppkey")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    best = J.best_of(lines, ["l_orderkey"], F.desc("l_extendedprice"), "l_linenumber").select("l_orderkey", "l_suppkey")
    return lines.join(best, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("JON-07", f"""with {IV}, k as (select *, s % 97 as c, e - s as n from iv), p as (select grp, member, piece, unnest([{{'s': 0, 'e': least(c, n)}}, {{'s': least(c + 10, n), 'e': n}}]) as x from k) select grp, member, piece, x.s as s, x.e as e from p where x.s < x.e""")
def _(spark, d):
    k = intervals(spark, d).withColumn("n", F.col("e") - F.col("s")).withColumn("c", F.col("s") % 97)
    mask = F.array(F.struct(F.col("c").alias("s"), (F.col("c") + 10).alias("e")))
    rows = k.select("grp", "member", "piece", F.explode(I.subtract(F.lit(0).cast("long"), F.col("n"), mask)).alias("x"))
    return rows.select("grp", "member", "piece", "x.s", "x.e")


@query("JON-08", f"with {IV}, b as (select grp, member, s, e from iv where piece = 1), o as (select grp, member, s, e from iv where piece <> 1), m as (select b.grp, b.member, o.member as r_member, least(b.e, o.e) - greatest(b.s, o.s) as overlap, row_number() over (partition by b.grp, b.member order by least(b.e, o.e) - greatest(b.s, o.s) desc, o.member) as rn from b join o on b.grp = o.grp and b.s < o.e and o.s < b.e) select grp, member, r_member, overlap from m where rn = 1")
def _(spark, d):
    iv = intervals(spark, d)
    met = J.overlapping(iv.where("piece = 1").select("grp", "member", "s", "e"), iv.where("piece <> 1").select("grp", "member", "s", "e"), "grp", 1024)
    return J.greatest_of(met, ["grp", "member"], "overlap", "r_member").select("grp", "member", "r_member", "overlap")


@query("JON-09", f"with {IV} select b.grp, b.member, count(*)::bigint as hits, max(least(b.e, o.e + 100) - greatest(b.s, o.s - 100))::bigint as most from iv b join iv o on b.grp = o.grp and b.s < o.e + 100 and o.s - 100 < b.e where b.piece = 1 and o.piece <> 1 group by 1, 2")
def _(spark, d):
    iv = intervals(spark, d)
    met = J.overlapping(iv.where("piece = 1").select("grp", "member", "s", "e"), iv.where("piece <> 1").select("grp", "member", "s", "e"), "grp", 128, slack=100)
    return met.groupBy("grp", "member").agg(F.count(F.lit(1)).alias("hits"), F.max("overlap").alias("most"))


@query("JON-10", "with n as (select l_orderkey, count(*)::bigint as n, max(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1) select o_orderkey, c_mktsegment, coalesce(n, 0) as n, q from orders left join customer on o_custkey = c_custkey left join n on o_orderkey = l_orderkey")
def _(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    orders, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    both = orders.join(c, orders["o_custkey"] == c["c_custkey"], "left")
    return both.join(n, both["o_orderkey"] == n["l_orderkey"], "left").select("o_orderkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), "q")


_MERGED = "w as (select grp, s, e, max(e) over (partition by grp, member order by s, e rows between unbounded preceding and 1 preceding) as reach, member from iv), i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by grp, member order by s, e rows unbounded preceding) as k from w), mg as (select grp, member, min(s) as s, max(e) as e from i group by grp, member, k)"


@query("JON-11", f"with {IV} select a.grp, a.member, a.piece, x.member as r_member, x.piece as r_piece, greatest(0, greatest(a.s, x.s) - least(a.e, x.e))::bigint as gap from iv a join iv x on a.grp = x.grp and a.member <> x.member and a.s < x.e + 500 and x.s - 500 < a.e where a.member % 50 = 0")
def _(spark, d):
    """Those whose member is divisible by 50 against all of the group."""
    b = intervals(spark, d).select("grp", "member", "piece", "s", "e")
    met = J.overlapping(b.where("member % 50 = 0"), b, "grp", 512, slack=500).where("member <> r_member")
    return met.select("grp", "member", "piece", "r_member", "r_piece", F.greatest(F.lit(0), F.greatest("s", "r_s") - F.least("e", "r_e")).cast("long").alias("gap"))


_PAIRS = "a as (select distinct l_suppkey as x, l_partkey as y from lineitem where l_returnflag = 'A'), r as (select distinct l_suppkey as x, l_partkey as y from lineitem where l_returnflag = 'R')"


@query("JON-12", f"with {_PAIRS} select coalesce(a.x, r.x) as x, coalesce(a.y, r.y) as y, case when a.x is not null and r.x is not null then 'both' when a.x is not null then 'first_only' else 'second_only' end as source from a full join r on a.x = r.x and a.y = r.y")
def _(spark, d):
    pairs = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y")).distinct()
    return J.provenance(pairs("A"), pairs("R"), ["x", "y"], "first", "second")


@query("JON-13", "select doc_id, array_to_string(list_sort(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'and', 'der', 'les', 'los'])), ',') as shared, list_has_any(string_split(lower(text), ' '), ['the', 'of', 'and', 'der', 'les', 'los']) as overlaps from documents")
def _(spark, d):
    words, pool = F.split(F.lower("text"), " "), F.array(*map(F.lit, ["the", "of", "and", "der", "les", "los"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_intersect(F.array_distinct(words), pool)), ",").alias("shared"), F.arrays_overlap(words, pool).alias("overlaps"))


@query("JON-14", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice >= 400000)")
def _(spark, d):
    known = table(spark, d, "orders").where("o_totalprice >= 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(known, "c_custkey", "left_anti")


@query("JON-15", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '5-LOW')")
def _(spark, d):
    wanted = table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(wanted, "c_custkey", "left_semi")


@query("JON-16", "select distinct o_custkey as k from orders where o_orderstatus = 'F' intersect select c_custkey from customer where c_acctbal > 0")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().join(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("JON-17", "with b as (select distinct l_suppkey as bag, p_brand as family from lineitem join part on l_partkey = p_partkey where l_quantity >= 45) select bag, family, s_nationkey::bigint as nation from b join supplier on bag = s_suppkey")
def _(spark, d):
    lines, part = table(spark, d, "lineitem").where("l_quantity >= 45").select("l_suppkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    bridge = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_suppkey").alias("bag"), F.col("p_brand").alias("family")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bag"), F.col("s_nationkey").cast("long").alias("nation"))
    return bridge.join(s, "bag")


@query("JON-18", "select c_custkey, s_suppkey from customer join supplier on c_name = s_name")
def _(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, c["c_name"] == s["s_name"]).select("c_custkey", "s_suppkey")


@query("JON-19", f"with {IV}, {_MERGED} select iv.grp, iv.member, iv.piece, min(coalesce(mg.s, iv.s))::bigint as run_s from iv left join mg on iv.grp = mg.grp and iv.member = mg.member and mg.s <= iv.s and mg.e >= iv.e group by 1, 2, 3")
def _(spark, d):
    iv = intervals(spark, d)
    whole = merge(iv, "grp", "member", stretch=None).select(F.col("grp"), F.col("member"), F.col("s").alias("run_s"), F.col("e").alias("run_e"))
    held = iv.join(whole, ["grp", "member"]).where("run_s <= s and run_e >= e").groupBy("grp", "member", "piece").agg(F.min("run_s").alias("run_s"))
    return iv.select("grp", "member", "piece", "s").join(held, ["grp", "member", "piece"], "left").groupBy("grp", "member", "piece").agg(F.min(F.coalesce("run_s", "s")).alias("run_s"))


@query("JON-20", f"with {TL} select a.event_id, max(b.pos) filter (where b.pos <= a.pos)::bigint as before, min(b.pos) filter (where b.pos >= a.pos)::bigint as after from tl a left join tl b on a.contig = b.contig and b.family = 'signup' where a.family = 'purchase' group by a.event_id")
def _(spark, d):
    t = timeline(spark, d)
    return J.nearest_sides(t.where("family = 'purchase'"), t.where("family = 'signup'"), "contig", "pos", "event_id").select("event_id", "before", "after")


@query("JON-22", "select p.page_id, n.n_name, r.r_name from pages p left join nation n on p.page_id = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    p = table(spark, d, "pages").select("page_id")
    both = p.join(n, p["page_id"] == n["n_nationkey"], "left")
    return both.join(r, both["n_regionkey"] == r["r_regionkey"], "left").select("page_id", "n_name", "r_name")


@query("SET-01", "select l_partkey as k from lineitem where l_returnflag = 'A' and l_quantity > 48 union select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 48")
def _(spark, d):
    side = lambda f: table(spark, d, "lineitem").where((F.col("l_returnflag") == f) & (F.col("l_quantity") > 48)).select(F.col("l_partkey").alias("k"))
    return side("A").unionByName(side("R")).distinct()


@query("SET-02", "select o_custkey as k from orders where o_totalprice > 450000 union select c_custkey from customer where c_acctbal > 9000")
def _(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")).distinct()


@query("SET-03", "select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 300000")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SET-04", "select c_custkey as k from customer where c_acctbal > 5000 intersect select o_custkey from orders where o_totalprice > 300000")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SET-05", "with r as (select *, row_number() over (partition by md5(text) order by doc_id) as rn from documents) select doc_id from r where rn = 1")
def _(spark, d):
    return J.best_of(table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], "doc_id").select("doc_id")


@query("SET-06", "select n_nationkey::bigint as k, n_name as name from nation union all select r_regionkey::bigint, r_name from region")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")))


@query("SRC-20", "select doc_id as k, 'labels' as root from labels union all select doc_id, 'documents' from documents where doc_id not in (select doc_id from labels)")
def _(spark, d):
    roots = [table(spark, d, n).select(F.col("doc_id").alias("k"), F.lit(n).alias("root")) for n in ("labels", "documents")]
    return J.first_root(roots, "k")
