"""Interval algebra on the adapters: INT operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import rules as U
from ..sources.adapters import IV, SEQS, TL, intervals, sequences, table, timeline
from .registry import query

_ANCHOR = f"{SEQS}, an as (select id, seq, length(seq) as n, 1 + id % 400 as st, 1 + id % 400 + 60 as en, case when id % 2 = 0 then 1 else -1 end as strand from seqs)"


def _anchors(spark, d):
    s = sequences(spark, d).select("id", "seq", F.length("seq").cast("long").alias("n"), (F.col("id") % 400 + 1).alias("st"))
    return s.withColumn("en", F.col("st") + 60).withColumn("strand", F.when(F.col("id") % 2 == 0, 1).otherwise(-1))


@query("INT-01", f"with {_ANCHOR}, f as (select id, greatest(1, st - 200) as win_start, least(n, en + 200) as win_end, st, en, strand from an where n >= 461), g as (select *, case when strand < 0 then win_end - en else st - win_start end as lf, case when strand < 0 then st - win_start else win_end - en end as rf from f) select id, win_start::bigint as win_start, win_end::bigint as win_end, lf::bigint as anchor_offset, lf::bigint as left_flank, rf::bigint as right_flank, lf < 200 as truncated_left, rf < 200 as truncated_right from g")
def _(spark, d):
    return _anchors(spark, d).select("id", I.flank(F.col("st"), F.col("en"), F.col("strand"), F.col("n"), 200, 461).alias("w")).where("w is not null").select("id", "w.*")


@query("INT-02", f"with {_ANCHOR} select id, case when strand < 0 then reverse(translate(substr(seq, greatest(1, st - 50), least(n, en + 50) - greatest(1, st - 50) + 1), 'ACGT', 'TGCA')) else substr(seq, greatest(1, st - 50), least(n, en + 50) - greatest(1, st - 50) + 1) end as window_seq from an where n >= 461")
def _(spark, d):
    from ..functions.sequence import reverse_complement

    w = _anchors(spark, d).withColumn("w", I.flank(F.col("st"), F.col("en"), F.col("strand"), F.col("n"), 50, 461)).where("w is not null")
    cut = F.substr("seq", F.col("w.win_start").cast("int"), (F.col("w.win_end") - F.col("w.win_start") + 1).cast("int"))
    return w.select("id", F.when(F.col("strand") < 0, reverse_complement(cut)).otherwise(cut).alias("window_seq"))


_MEMBERS = "w as (select grp, member, s, e, max(e) over (partition by grp, member order by s, e rows between unbounded preceding and 1 preceding) as reach from iv), i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by grp, member order by s, e rows unbounded preceding) as k from w), mg as (select grp, member, min(s) as s, max(e) as e from i group by grp, member, k)"


@query("INT-03", f"with {IV}, {_MEMBERS} select grp, member, count(*)::bigint as pieces, min(s)::bigint as s, max(e)::bigint as e from mg group by grp, member")
def _(spark, d):
    whole = intervals(spark, d).groupBy("grp", "member").agg(I.merged(F.collect_list(F.struct("s", "e"))).alias("m"))
    return whole.select("grp", "member", F.size("m").cast("long").alias("pieces"), F.element_at("m", 1)["s"].alias("s"), F.element_at("m", -1)["e"].alias("e"))


@query("INT-04", f"with {IV}, c as (select grp, member, piece, s, e, e - s as n from iv), p as (select grp, member, piece, unnest([{{'s': 0::bigint, 'e': least(n, 5)::bigint}}, {{'s': least(n, 9)::bigint, 'e': least(n, 30)::bigint}}, {{'s': least(n, 40)::bigint, 'e': n::bigint}}]) as x from c) select grp, member, piece, x.s as s, x.e as e from p where x.s < x.e")
def _(spark, d):
    mask = F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in ((5, 9), (30, 40))])
    rows = intervals(spark, d).withColumn("n", F.col("e") - F.col("s"))
    return rows.select("grp", "member", "piece", F.explode(I.subtract(F.lit(0).cast("long"), F.col("n"), mask)).alias("x")).select("grp", "member", "piece", "x.s", "x.e")


@query("INT-05", f"with {IV} select grp, member, piece, round((greatest(0, least(e, s + 20) - greatest(s, s + 10)) + greatest(0, least(e, s + 60) - greatest(s, s + 40))) / (e - s), 6) as coding from iv")
def _(spark, d):
    s = F.col("s")
    mask = F.array(F.struct((s + 10).alias("s"), (s + 20).alias("e")), F.struct((s + 40).alias("s"), (s + 60).alias("e")))
    return intervals(spark, d).select("grp", "member", "piece", F.round(I.coding_fraction(s, F.col("e"), mask), 6).alias("coding"))


_SEG = "sg as (select grp, member, piece, s as rs, e as re, s + 7 as ms, s + 7 + (e - s) * 2 as me, case when piece % 2 = 0 then '-' else '+' end as strand, s + 3 as bs, s + 33 as be from iv)"


def _segments(spark, d):
    iv = intervals(spark, d)
    return iv.select("grp", "member", "piece", F.col("s").alias("rs"), F.col("e").alias("re"), (F.col("s") + 7).alias("ms"), (F.col("s") + 7 + (F.col("e") - F.col("s")) * 2).alias("me"), F.when(F.col("piece") % 2 == 0, "-").otherwise("+").alias("strand"), (F.col("s") + 3).alias("bs"), (F.col("s") + 33).alias("be"))


@query("INT-06", f"with {IV}, {_SEG}, o as (select *, greatest(bs, rs) as lo, least(be, re) as hi from sg), t as (select *, case when strand = '-' then me - 2 * (hi - rs) else ms + 2 * (lo - rs) end as a, case when strand = '-' then me - 2 * (lo - rs) else ms + 2 * (hi - rs) end as b from o where hi > lo) select grp, member, piece, greatest(a, ms)::bigint as s, least(b, me)::bigint as e from t where least(b, me) > greatest(a, ms)")
def _(spark, d):
    c = F.col
    t = I.trim_member(c("bs"), c("be"), c("rs"), c("re"), c("ms"), c("me"), c("strand"))
    return _segments(spark, d).select("grp", "member", "piece", t.alias("t")).where("t is not null").select("grp", "member", "piece", "t.s", "t.e")


@query("INT-07", f"with {IV}, {_SEG} select grp, member, piece, case when strand = '-' then me - 2 * (bs - rs) else ms + 2 * (bs - rs) end::bigint as q from sg")
def _(spark, d):
    c = F.col
    return _segments(spark, d).select("grp", "member", "piece", I.to_query(c("bs"), c("rs"), c("re"), c("ms"), c("me"), c("strand")).alias("q"))


@query("INT-08", f"with {IV}, {_SEG} select grp, member, piece, case when strand = '-' then re - (15 // 2) else rs + (15 // 2) end::bigint as r from sg")
def _(spark, d):
    back = U.trimmed_reference(F.col("rs"), F.col("re"), F.lit(15) / 2, F.col("strand"))
    return _segments(spark, d).select("grp", "member", "piece", back.alias("r"))


@query("INT-09", f"with {IV} select grp, member, piece, greatest(0, least(e, 10100) - greatest(s, 10000))::bigint as o from iv")
def _(spark, d):
    return intervals(spark, d).select("grp", "member", "piece", I.overlap(F.col("s"), F.col("e"), F.lit(10000), F.lit(10100)).cast("long").alias("o"))


@query("INT-10", f"with {IV}, {_MEMBERS}, wn as (select grp, min(s) as lo, max(e) as hi from iv group by grp), g as (select grp, member, coalesce(lag(e) over (partition by grp, member order by s), lo) as s, s as e from mg join wn using (grp) union all select grp, member, max(e), hi from mg join wn using (grp) group by grp, member, hi) select grp, member, s::bigint as s, e::bigint as e from g where s < e")
def _(spark, d):
    """What a member's intervals leave of its group's window."""
    iv = intervals(spark, d)
    windows = iv.groupBy("grp").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    whole = iv.groupBy("grp", "member").agg(I.merged(F.collect_list(F.struct("s", "e"))).alias("m")).join(windows, "grp")
    return whole.select("grp", "member", F.explode(I.subtract(F.col("lo"), F.col("hi"), F.col("m"))).alias("g")).select("grp", "member", "g.s", "g.e")


@query("INT-11", f"with {TL} select a.event_id, a.pos - max(b.pos) filter (where b.pos <= a.pos) as left_gap, min(b.pos) filter (where b.pos >= a.pos) - a.pos as right_gap from tl a left join tl b on a.contig = b.contig and b.family = 'click' where a.family = 'signup' group by a.event_id, a.pos")
def _(spark, d):
    from ..operators.joins import nearest_sides

    t = timeline(spark, d)
    n = nearest_sides(t.where("family = 'signup'"), t.where("family = 'click'"), "contig", "pos", "event_id")
    return n.select("event_id", (F.col("pos") - F.col("before")).alias("left_gap"), (F.col("after") - F.col("pos")).alias("right_gap"))


@query("INT-12", f"with {IV}, w as (select grp, min(s) as w0, max(e) - min(s) as n from iv group by grp) select grp, member, piece, greatest(0, s - w0 - 75)::bigint as s, least(n, e - w0 + 75)::bigint as e from iv join w using (grp)")
def _(spark, d):
    """A group's window reaches from its first start to its last end."""
    iv = intervals(spark, d)
    w = iv.groupBy("grp").agg(F.min("s").alias("w0"), (F.max("e") - F.min("s")).alias("n"))
    padded = iv.join(w, "grp").select("grp", "member", "piece", I.soft_pad(F.col("s") - F.col("w0"), F.col("e") - F.col("w0"), 75, F.col("n")).alias("p"))
    return padded.select("grp", "member", "piece", F.col("p.s").cast("long").alias("s"), F.col("p.e").cast("long").alias("e"))


@query("INT-13", f"with {SEQS} select id, upper(substr(seq, 1, 5)) || lower(substr(seq, 6, 10)) || upper(substr(seq, 16, 5)) || lower(substr(seq, 21, 4)) || upper(substr(seq, 25)) as cased from seqs where length(seq) >= 30")
def _(spark, d):
    mask = F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in ((5, 15), (20, 24))])
    return sequences(spark, d).where(F.length("seq") >= 30).select("id", I.soft_case(F.col("seq"), mask).alias("cased"))


@query("INT-14", f"with {IV}, x as (select grp, avg((e <= 10400)::int) as up, avg((s >= 10400)::int) as down from iv group by grp) select grp, case when up >= 0.6 then 'upstream' when down >= 0.6 then 'downstream' else 'mixed' end as side from x")
def _(spark, d):
    x = intervals(spark, d).groupBy("grp").agg(F.avg((F.col("e") <= 10400).cast("int")).alias("up"), F.avg((F.col("s") >= 10400).cast("int")).alias("down"))
    return x.select("grp", U.dominant_side(F.col("up"), F.col("down"), 0.6).alias("side"))


@query("INT-15", f"with {IV}, x as (select grp, case when e <= 10400 then 10400 - e else greatest(0, s - 10400) end as gap from iv), g as (select grp, list_sort(list(gap)) as v from x group by grp) select grp, v[len(v) // 2 + 1]::bigint as gap, (v[least(len(v) - 1, floor(0.75 * len(v)))::int + 1] - v[least(len(v) - 1, floor(0.25 * len(v)))::int + 1])::bigint as iqr from g")
def _(spark, d):
    from ..operators.aggregate import at_fractions

    gap = F.when(F.col("e") <= 10400, 10400 - F.col("e")).otherwise(F.greatest(F.lit(0), F.col("s") - 10400))
    x = intervals(spark, d).select("grp", gap.alias("gap"))
    at = at_fractions(x, ["grp"], "gap", {"q1": 0.25, "middle": 0.5, "q3": 0.75})
    return at.select("grp", F.col("middle").alias("gap"), (F.col("q3") - F.col("q1")).alias("iqr"))


@query("INT-16", f"with {IV} select grp, member, piece, case when e <= 10400 then e - 10400 when s >= 10460 then s - 10460 else 0 end::bigint as distance from iv")
def _(spark, d):
    return intervals(spark, d).select("grp", "member", "piece", I.signed_distance(F.lit(10400), F.lit(10460), F.col("s"), F.col("e")).cast("long").alias("distance"))


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query("INT-17", f"with {_ANCHOR}, g as (select id, case when strand < 0 then en + 500 - 40 + 1 else st + 10 end as a, case when strand < 0 then en + 500 - 10 else st + 40 - 1 end as b, strand, seq, substr(seq, st, en + 500 - st + 1) as w from an), c as (select id, a, b, case when strand < 0 then {_RC.format('substr(seq, a, b - a + 1)')} else substr(seq, a, b - a + 1) end as cut, substr(case when strand < 0 then {_RC.format('w')} else w end, 11, 30) as own from g) select id, a::bigint as start, b::bigint as \"end\", cut = own and length(cut) = 30 as proven from c")
def _(spark, d):
    """A window whose contig ends before it does has fewer letters than its coordinates say; on strand - the map is off then."""
    from ..functions.sequence import reverse_complement

    p0, p1, strand = F.lit(10), F.lit(40), F.col("strand")
    letters = F.substr("seq", F.col("st").cast("int"), (F.col("en") + 500 - F.col("st") + 1).cast("int"))
    rows = _anchors(spark, d).withColumn("window", F.when(strand < 0, reverse_complement(letters)).otherwise(letters))
    rows = rows.withColumn("g", I.to_genome(F.col("st"), F.col("en") + 500, p0, p1, strand))
    return rows.select("id", "g.start", "g.end", I.round_trip(F.col("seq"), F.col("window"), F.col("g"), p0, p1, strand).alias("proven"))


@query("INT-18", f"with {_ANCHOR} select id, substr(seq, 21, 200) as trimmed, (st - 21)::bigint as anchor_offset from an where n >= 461 and st >= 21 and st + 60 <= 221")
def _(spark, d):
    cut = U.trimmed_window(F.col("seq"), F.col("st") - 1, F.lit(60), 20, 200).alias("t")
    return _anchors(spark, d).where("n >= 461").select("id", cut).where("t is not null").select("id", F.col("t.seq").alias("trimmed"), F.col("t.offset").alias("anchor_offset"))


@query("INT-19", f"with {TL}, p as (select contig, min(pos) as p0 from tl where family = 'purchase' group by contig) select event_id, (pos - p0)::bigint as x from tl join p using (contig)")
def _(spark, d):
    t = timeline(spark, d)
    p = t.where("family = 'purchase'").groupBy("contig").agg(F.min("pos").alias("p0"))
    return t.join(p, "contig").select("event_id", U.in_anchor_frame(F.col("pos"), F.col("p0")).alias("x"))


@query("INT-20", f"with {IV} select grp, member, piece, case when e - 10400 <= 0 then 'upstream' when s - 10400 >= 60 then 'downstream' else 'overlaps' end as side from iv")
def _(spark, d):
    return intervals(spark, d).select("grp", "member", "piece", I.side_of(F.col("s") - 10400, F.col("e") - 10400, F.lit(60)).alias("side"))


@query("INT-21", f"with {IV}, {_SEG} select grp, member, piece, case when strand = '-' then re - 4 else rs + 4 end::bigint as point from sg where re - rs > 4")
def _(spark, d):
    point = U.insertion_point(F.col("rs"), F.col("re"), F.lit(4), F.col("strand"))
    return _segments(spark, d).where("re - rs > 4").select("grp", "member", "piece", point.alias("point"))


@query("INT-22", f"with {IV}, g as (select grp, median(s - 10400) as ms from iv group by grp) select grp, case when ms < 0 then trunc(ms) else greatest(0, trunc(ms - 60)) end::bigint as dist_to_anchor from g")
def _(spark, d):
    g = intervals(spark, d).groupBy("grp").agg(F.median(F.col("s") - 10400).alias("ms"))
    return g.select("grp", U.block_distance(F.col("ms"), F.lit(60)).alias("dist_to_anchor"))


@query("INT-23", "with t as (select doc_id, unnest(string_split(text, ' ')) as tok, generate_subscripts(string_split(text, ' '), 1) as i from documents) select doc_id, i::bigint as i, (sum(length(tok) + 1) over w - length(tok) - 1)::bigint as s, (sum(length(tok) + 1) over w - 1)::bigint as e from t window w as (partition by doc_id order by i rows unbounded preceding)")
def _(spark, d):
    """Tokens to places in the text, by a running sum of their lengths."""
    from pyspark.sql import Window as W

    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "tok"))
    upto = F.sum(F.length("tok") + 1).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return t.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), (upto - F.length("tok") - 1).alias("s"), (upto - 1).alias("e"))
