"""Similarity, clustering and model operators on the adapters: SIM, and the rows-only SCA, JON and AGG operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import similarity as S
from ..operators.alignment import align, covered, empty_alleles
from ..operators.components import connected
from ..operators.joins import best_of
from ..operators.proteins import open_frames, query_proteins
from ..operators.scratch import written
from ..sources.adapters import SEQS, sequences, table
from .registry import query


def _each(rows, f, kind, seq="seq"):
    """Adds ``x = f(seq)``, null for a null, by a scalar pandas UDF; Arrow batches, no per-row round trips."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) if isinstance(x, str) else None for x in s], dtype="Int64" if kind == "long" else "Float64")

    return rows.withColumn("x", run(F.col(seq)))


_CODONS = "[case when c in ('TAA', 'TAG', 'TGA') then 'S' else '.' end for c in regexp_extract_all(substr(t, f), '...')]"
_KMERS = "case when length(seq) >= {0} then list_distinct([seq[i:i+{1}] for i in range(1, length(seq) - {1} + 1)]) else [seq] end"
_JACCARD = "len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)))"


@query("SCA-06", f"with {SEQS}, s as (select id, unnest([seq, reverse(translate(seq, 'ACGT', 'TGCA'))]) as t from seqs), x as (select id, t, unnest([1, 2, 3]) as f from s) select id, max(3 * list_max([length(r) for r in string_split(array_to_string({_CODONS}, ''), 'S')]))::bigint as stop_free from x group by id")
def _(spark, d):
    return _each(sequences(spark, d), S.stop_free, "long").select("id", F.col("x").alias("stop_free"))


@query("SCA-07")
def _(spark, d):
    def z(seq: str, shuffles: int = 60) -> float:
        runs = S.shuffled_stop_free(seq, shuffles, len(seq))
        sd = float(np.std(runs))
        return (S.stop_free(seq) - float(np.mean(runs))) / sd if sd else 0.0

    return _each(sequences(spark, d), z, "double").select("id", F.round("x", 6).alias("orf_z"))


@query("SCA-08")
def _(spark, d):
    return _each(sequences(spark, d).withColumn("short", F.when(F.length("seq") <= 600, F.col("seq"))), S.longest_inverted_repeat, "long", "short").select("id", F.col("x").alias("ir_arm"), F.when(F.length("seq") > 0, F.col("x") / F.length("seq")).alias("ir_frac"))


_GC = "list_transform(range(1, greatest(1, length(w) - 100) + 1), lambda i: length(regexp_replace(substr(w, i, 101), '[^CG]', '', 'g')))"


@query("SCA-25", f"with {SEQS}, p as (select id, right(seq, 50) || seq || left(seq, 50) as w from seqs), c as (select id, {_GC} as gc from p) select id, len(gc)::bigint as windows, list_min(gc)::bigint as least, list_max(gc)::bigint as most, gc[1]::bigint as first_window from c")
def _(spark, d):
    """G and C in every window of 101 letters of a circular sequence, from one-hot rows and their running sums."""
    from ..operators.scorer import one_hot

    @F.pandas_udf("windows long, least long, most long, first_window long")
    def every(seqs: pd.Series) -> pd.DataFrame:
        out = []
        for seq in seqs:
            if not isinstance(seq, str):
                out.append((None,) * 4)
                continue
            sums = np.concatenate([[0], one_hot(seq[-50:] + seq + seq[:50])[:, 1:3].sum(1).cumsum()])
            width = min(101, len(sums) - 1)
            gc = sums[width:] - sums[: len(sums) - width]
            out.append((len(gc), int(gc.min()), int(gc.max()), int(gc[0])))
        return pd.DataFrame(out, columns=["windows", "least", "most", "first_window"], dtype="Int64")

    return sequences(spark, d).select("id", every("seq").alias("x")).select("id", "x.*")


@query("SIM-01")
def _(spark, d):
    return open_frames(sequences(spark, d), "id", "seq", 60)


@query("SIM-02")
def _(spark, d):
    from ..functions.intervals import ARRAY, merged

    frames = open_frames(sequences(spark, d), "id", "seq", 60).select("id", "s", "e")
    anchors = sequences(spark, d).select("id", F.lit(20).cast("long").alias("s"), F.lit(50).cast("long").alias("e"))
    return frames.unionByName(anchors).groupBy("id").agg(merged(F.collect_list(F.struct("s", "e"))).cast(ARRAY).alias("mask")).select("id", F.size("mask").alias("pieces"), F.element_at("mask", 1)["s"].alias("first_s"))


@query("SIM-03", "with h as (select l_orderkey, p_brand as model, case when p_type = 'ECONOMY' then 2 else 1 end as prio, l_extendedprice as score from lineitem join part on l_partkey = p_partkey), r as (select *, row_number() over (partition by l_orderkey order by prio desc, score desc, model) as rn from h) select l_orderkey, model, score from r where rn = 1")
def _(spark, d):
    lines, part = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("score")), table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model"), F.when(F.col("p_type") == "ECONOMY", 2).otherwise(1).alias("prio"))
    hits = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return best_of(hits, ["l_orderkey"], F.desc("prio"), F.desc("score"), "model").select("l_orderkey", "model", "score")


@query("SIM-03-search")
def _(spark, d):
    """Every protein against a profile of each family, made of the beginnings of twenty of its proteins; one anchor each."""
    from ..operators import profiles as R
    from ..operators.sampling import hash_sample

    rows = sequences(spark, d)
    name = F.concat_ws(":", "id", "s", "e", "strand").alias("orf")
    found = open_frames(rows, "id", "seq", 90).join(rows.where("family is not null").select("id", "family").distinct(), "id").select("family", name, "protein")
    seeds = hash_sample(found, ["family"], "orf", 20, 3).select("family", F.substring("protein", 1, 24).alias("seed"))
    matrices = written(R.build(seeds, "family", "seed"), "profiles")
    hits = R.search(found, "orf", "protein", matrices, R.seed_cutoffs(seeds, "family", "seed", matrices))
    families = matrices.select("model").distinct().select("model", F.col("model").alias("family"), F.when(F.col("model") == "en", 2).otherwise(1).alias("priority"))
    return R.resolve(hits, "orf", families).withColumn("score", F.round("score", 4))


@query("SIM-04", "with w(family, model) as (values ('first', 'Brand#1'), ('first', 'Brand#2'), ('second', 'Brand#3')), k as (select p_brand as model, count(*)::bigint as leng, max(p_retailprice) as ga from part group by 1) select family, model, leng, ga from w join k using (model)")
def _(spark, d):
    """The configured models out of a library of all; a missing one is an error."""
    from ..operators.records import fetch_models
    from ..sources.readers import check_config

    config = check_config({"families": {"first": ["Brand#1", "Brand#2"], "second": ["Brand#3"]}})
    wanted = spark.createDataFrame([(f, m) for f, models in config["families"].items() for m in models], "family string, model string")
    library = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.count(F.lit(1)).alias("leng"), F.max("p_retailprice").alias("ga"))
    return fetch_models(library, wanted, "model")


def _clusters(spark, d, least):
    return S.cluster(sequences(spark, d), "clade", "id", "seq", least)


@query("SIM-05")
def _(spark, d):
    return _clusters(spark, d, 0.7)


@query("SIM-06")
def _(spark, d):
    from ..functions.sequence import reverse_complement

    rows = sequences(spark, d)
    return S.cluster(rows.withColumn("seq", F.least("seq", reverse_complement(F.col("seq")))), "clade", "id", "seq", 0.5)


#: The rungs of the identity ladder.
RUNGS = (0.90, 0.70, 0.50, 0.35)


@query("SIM-05-ladder")
def _(spark, d):
    """Representatives at each rung, eight tenths of both sequences covered."""
    from ..operators.representatives import ladder

    return ladder(sequences(spark, d), "clade", "id", "seq", RUNGS, 0.8)


@query("SIM-06-regions")
def _(spark, d):
    """Representatives at 0.7 identity and 0.7 of the member covered, on the strand that sorts first."""
    from ..functions.sequence import COMPLEMENT, IUPAC
    from ..operators.representatives import ladder

    turn = str.maketrans(IUPAC, COMPLEMENT)

    @F.pandas_udf("string")
    def first_strand(seqs: pd.Series) -> pd.Series:
        return seqs.map(lambda s: min(s, s.translate(turn)[::-1]), na_action="ignore")

    rows = sequences(spark, d).withColumn("seq", first_strand("seq"))
    return ladder(rows, "clade", "id", "seq", (0.7,), 0.7, of_member_only=True)


@query("SIM-07", "with c as (select source, lang as cluster, count(distinct doc_id)::bigint as sites from documents group by 1, 2), t as (select source, count(distinct doc_id) as n from documents group by 1), r as (select source, cluster, sites, n, row_number() over (partition by source order by sites desc, cluster) as rn from c join t using (source)) select source, cluster, sites, round(sites / n, 6) as recurrence from r where rn = 1 and sites >= 5")
def _(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("lang").alias("cluster"), "doc_id")
    c = docs.groupBy("source", "cluster").agg(F.countDistinct("doc_id").alias("sites"))
    t = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("n"))
    best = best_of(c.join(t, "source"), ["source"], F.desc("sites"), "cluster").where("sites >= 5")
    return best.select("source", "cluster", "sites", F.round(F.col("sites") / F.col("n"), 6).alias("recurrence"))


def _asked(rows):
    """The rows that are looked up in all: those whose id is divisible by 50."""
    return rows.where("id % 50 = 0")


def _hits(hits):
    return hits.select("clade", "q", "s", "strand", "qs", "qe", "ss", "se", "score", "matches", "columns", "gaps", F.round("pid", 6).alias("pid"), F.round("bits", 6).alias("bits"))


@query("SIM-08")
def _(spark, d):
    r = sequences(spark, d)
    return _hits(align(_asked(r), r, "clade", evalue=1e-3))


@query("SIM-09")
def _(spark, d):
    """Forward strand only, words of seven; the best alignment of each pair."""
    r = sequences(spark, d)
    return best_of(_hits(align(_asked(r), r, "clade", word=7, evalue=1e-3, both_strands=False, hot=64)), ["q", "s"], F.desc("bits"), "qs", "ss", "qe", "se")


@query("SIM-10")
def _(spark, d):
    r = sequences(spark, d)
    known = _asked(r)
    pairs = covered(align(known, r, "clade", evalue=1e-5), known.select(F.col("id").alias("q"), F.length("seq").alias("qlen")), 70.0, 0.5)
    return pairs.select("q", "s", "hsps", "covered", F.round("pid", 6).alias("pid"), F.round("bits", 6).alias("bits"))


@query("JON-21", f"with {SEQS}, k as (select clade, id, {_KMERS.format(11, 10)} as k from seqs), p as (select a.clade, a.id as a, b.id as b, {_JACCARD} as jaccard from k a join k b on a.clade = b.clade and a.id < b.id) select * from p where jaccard >= 0.3")
def _(spark, d):
    return S.kmer_pairs(sequences(spark, d), "clade", "id", "seq", 11, 0.3)


@query("SIM-11", "with p as (select l_suppkey as block, l_discount as evalue, l_tax as power, l_returnflag <> 'R' as st from lineitem where l_orderkey % 9 <> 0), g as (select block, count(*) filter (where evalue < 0.05)::bigint as found, round(sum(power), 4) as expected, count(*) filter (where evalue < 0.05 and st)::bigint as tp, sum(power) as raw from p group by 1), k as (select *, case when found > 0 then tp / found else 0.0 end as ppv from g) select block, found, expected, tp, round(ppv, 6) as ppv, case when tp = 0 and raw < 1 then 'no_signal' when raw >= 3 and tp >= 3 and ppv >= 0.8 then 'supported' when raw < 3 then 'underpowered' when tp >= 1 then 'borderline' else 'failed' end as verdict from k")
def _(spark, d):
    """Alignment and folding stay outside; their table of tested pairs is parsed, summed up per block and judged."""
    from ..operators.records import covariation_summary
    from ..sources.readers import columns

    t = lambda c: F.col(c).cast("string")
    line = F.when(F.col("l_orderkey") % 9 == 0, F.lit("# comment")).otherwise(F.concat_ws(" ", t("l_suppkey"), t("l_linenumber"), t("l_partkey"), F.when(F.col("l_returnflag") == "R", "~").otherwise("*"), t("l_discount"), t("l_tax")))
    pairs = columns(table(spark, d, "lineitem").select(line.alias("value")), ("block", "i", "j", "mark", "evalue", "power"), ("long", "int", "int", "string", "double", "double"), range(6)).withColumn("in_structure", F.col("mark") == "*")
    out = covariation_summary(pairs, "block")
    return out.withColumn("expected", F.round("expected", 4)).withColumn("ppv", F.round("ppv", 6))


@query("SIM-12")
def _(spark, d):
    from ..operators.scorer import random_net, score_sequences

    out = score_sequences(sequences(spark, d), "id", "seq", random_net(3))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("mean", "max", "frac_gt50", "best50", "core_mean")], "core_n")


@query("SIM-13", "with t as (select user_id as bag, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, value as score from events), k as (select *, pos - row_number() over (partition by bag order by pos) as run from t where score >= 20), g as (select bag, min(pos)::bigint as s, (max(pos) + 1)::bigint as e, round(avg(score), 6) as mean_score, max(score) as max_score from k group by bag, run) select * from g where e - s >= 2")
def _(spark, d):
    """Model scoring stays outside; its table of scores per position is cut into regions."""
    from pyspark.sql import Window as W

    from ..operators.records import structure_regions

    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    scores = table(spark, d, "events").select(F.col("user_id").alias("bag"), pos.cast("long").alias("pos"), F.col("value").alias("score"))
    return structure_regions(scores, "bag", "pos", "score", 20.0, 2).withColumn("mean_score", F.round("mean_score", 6))


_EDGES = "ed as (select distinct n_nationkey::bigint as a, (n_nationkey * 7 % 23)::bigint as b from nation where n_nationkey % 3 <> 0)"


@query("SIM-14", f"with recursive {_EDGES}, sy as (select a, b from ed where a <> b union select b, a from ed where a <> b), r(node, root) as (select a, a from sy union select sy.b, r.root from r join sy on r.node = sy.a) select node, min(root) as root from r group by node")
def _(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 3 <> 0")
    return connected(n.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") * 7 % 23).cast("long").alias("b")).distinct())


@query("SIM-15")
def _(spark, d):
    """Sites: 60 letters before and after an element of 60, at the 100th letter of every sequence that is looked up."""
    r = sequences(spark, d)
    flanks = _asked(r).where("length(seq) >= 220").select("clade", "id", F.expr("substring(seq, 41, 60) || substring(seq, 161, 60)").alias("seq"), F.lit(60).alias("point"))
    return empty_alleles(flanks, r, "clade")[1]


@query("SIM-16")
def _(spark, d):
    """Three representatives of each bag's proteins of 60 letters or more."""
    return query_proteins(sequences(spark, d), "clade", "id", "seq", 60, 3, 2)


@query("AGG-18")
def _(spark, d):
    found = S.rungs(sequences(spark, d), "clade", "id", "seq", (1.0, 0.95, 0.9, 0.7))
    return found.groupBy("clade", "rung").agg(F.countDistinct("cluster").alias("clusters")).select("clade", "clusters", "rung", (F.col("clusters") >= 20).alias("feasible"))


@query("AGG-18-ladder")
def _(spark, d):
    """Clusters of each clade at each rung, and whether there are enough of them."""
    from ..operators.representatives import ladder

    found = ladder(sequences(spark, d), "clade", "id", "seq", RUNGS, 0.8)
    return found.groupBy("clade", "rung").agg(F.countDistinct("representative").alias("clusters")).withColumn("feasible", F.col("clusters") >= 20)


@query("AGG-31", f"with {SEQS}, d as (select clade, seq, min(id) as id from seqs group by clade, seq), r as (select *, row_number() over (partition by clade order by sha1('1:' || id::varchar), id) as rn from d), k as (select clade, id, {_KMERS.format(5, 4)} as k from r where rn <= 300) select a.clade, round(median({_JACCARD}), 6) as median_identity from k a join k b on a.clade = b.clade and a.id < b.id group by a.clade")
def _(spark, d):
    from ..functions.sequence import jaccard, kmers
    from ..operators.sampling import hash_sample

    distinct = sequences(spark, d).groupBy("clade", "seq").agg(F.min("id").alias("id"))
    kept = hash_sample(distinct, ["clade"], "id", 300, 1).select("clade", "id", kmers(F.col("seq")).alias("k"))
    other = kept.select(F.col("clade").alias("c2"), F.col("id").alias("id2"), F.col("k").alias("k2"))
    met = kept.join(other, (F.col("clade") == F.col("c2")) & (F.col("id") < F.col("id2")))
    return met.groupBy("clade").agg(F.round(F.median(jaccard(F.col("k"), F.col("k2"))), 6).alias("median_identity"))
