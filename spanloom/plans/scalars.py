"""Scalar functions on the adapters: SCA and PRJ operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as U
from ..functions import sequence as S
from ..functions import verdicts as V
from ..sources.adapters import SC, SEQS, TL, scored, sequences, table, timeline
from .registry import query

_K5 = "case when length(seq) >= 5 then list_distinct([seq[i:i+4] for i in range(1, length(seq) - 3)]) else [seq] end"


@query("SCA-01", f"with {SEQS} select id, reverse(translate(seq, '{S.IUPAC}', '{S.COMPLEMENT}')) as rc from seqs")
def _(spark, d):
    return sequences(spark, d).select("id", S.reverse_complement(F.col("seq")).alias("rc"))


@query("SCA-02", f"with {SEQS} select id, len({_K5})::bigint as n_kmers, list_sort({_K5})[1] as least from seqs")
def _(spark, d):
    k = S.kmers(F.col("seq"))
    return sequences(spark, d).select("id", F.size(k).cast("long").alias("n_kmers"), F.array_min(k).alias("least"))


@query("SCA-03", f"with {SEQS}, k as (select id, clade, {_K5} as k from seqs), p as (select id, clade, k, lead(k) over (partition by clade order by id) as k2, lead(id) over (partition by clade order by id) as id2 from k) select id, id2, round(len(list_intersect(k, k2)) / len(list_distinct(list_concat(k, k2))), 6) as jaccard from p where id2 is not null")
def _(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("clade").orderBy("id")
    p = sequences(spark, d).select("id", "clade", S.kmers(F.col("seq")).alias("k")).withColumn("k2", F.lead("k").over(w)).withColumn("id2", F.lead("id").over(w))
    return p.where("id2 is not null").select("id", "id2", F.round(S.jaccard(F.col("k"), F.col("k2")), 6).alias("jaccard"))


@query("SCA-04", f"with {SEQS} select id, sha1('7:' || id::varchar) as tie from seqs")
def _(spark, d):
    return sequences(spark, d).select("id", S.tie_key(7, F.col("id")).alias("tie"))


@query("SCA-05", f"""with {SEQS}, p as (select id, seq as a, lead(seq) over (partition by clade order by id) as b from seqs),
q as (select id, a, b, greatest(length(a), length(b)) as n from p where b is not null and greatest(length(a), length(b)) > 0),
c as (select id, n, unnest(string_split(a, '')) as x, unnest(string_split(b, '')) as y from q)
select id, round(count(*) filter (where x = y) / any_value(n), 6) as identity from c group by id""")
def _(spark, d):
    from pyspark.sql import Window as W

    p = sequences(spark, d).select("id", F.col("seq").alias("a"), F.lead("seq").over(W.partitionBy("clade").orderBy("id")).alias("b"))
    return p.where("b is not null and greatest(length(a), length(b)) > 0").select("id", F.round(S.identity(F.col("a"), F.col("b")), 6).alias("identity"))


@query("SCA-09", f"with {SEQS} select id, round((length(seq) - length(regexp_replace(seq, '[GCgc]', '', 'g'))) / length(seq), 6) as gc from seqs where length(seq) > 0")
def _(spark, d):
    return sequences(spark, d).where(F.length("seq") > 0).select("id", F.round(S.gc_fraction(F.col("seq")), 6).alias("gc"))


@query("SCA-11", f"with {SC} select doc_id, round(1 / (1 + (len / 10) / 50), 6) as tightness, round(greatest(0, 1 - abs(len - words * 6) / greatest(words * 6, 1)), 6) as consistency from sc")
def _(spark, d):
    return scored(spark, d).select("doc_id", F.round(V.tightness(F.col("len") / 10), 6).alias("tightness"), F.round(V.length_consistency(F.abs(F.col("len") - F.col("words") * 6), F.greatest(F.col("words") * 6, F.lit(1.0))), 6).alias("consistency"))


@query("SCA-10", "select l_orderkey, l_linenumber, round(l_quantity / 50 * (1 - l_discount) * (1 - l_tax), 8) as composite from lineitem")
def _(spark, d):
    score = U.composite(F.col("l_quantity") / 50, 1 - F.col("l_discount"), 1 - F.col("l_tax"), digits=8)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("composite"))


@query("SCA-12", f"with {SC} select doc_id, round(0.5 + 0.5 * least(1.0, log10(greatest(words, 1)) / log10(500)), 6) as breadth from sc")
def _(spark, d):
    return scored(spark, d).select("doc_id", F.round(V.breadth(F.col("words"), 500, 0.5), 6).alias("breadth"))


@query("SCA-13", f"with {SC} select doc_id, round(case when quality = 1 then 1.0 when toxic = 1 then 0.35 else 0 end * least(1.0, words / 6), 6) as strength from sc")
def _(spark, d):
    return scored(spark, d).select("doc_id", F.round(V.test_strength(F.col("quality") == 1, F.col("toxic") == 1, F.col("words")), 6).alias("strength"))


@query("SCA-14", f"with {SC} select doc_id, case when quality = 1 and toxic = 0 then case when len >= 1000 then 'A' else 'B' end when len >= 1000 then 'D' else 'C' end as tier from sc")
def _(spark, d):
    return scored(spark, d).select("doc_id", V.tier((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("len") >= 1000).alias("tier"))


@query("SCA-15", "select event_id, coalesce(try_cast(regexp_extract(props, '[0-9]+') as integer), -1)::bigint as k from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", V.safe_int(F.regexp_extract("props", "[0-9]+", 0), -1).cast("long").alias("k"))


@query("SCA-16", """with t as (select doc_id, list_distinct(string_split(lower(text), ' ')) as tags from documents)
select doc_id, case when list_has_any(tags, ['the', 'of']) then 'first' when list_has_any(tags, ['der', 'die']) then 'second' else 'unknown' end as lane,
array_to_string(list_sort(list_intersect(tags, ['the', 'of', 'der', 'die', 'und', 'les', 'que'])), '+') as labels from t""")
def _(spark, d):
    tags = table(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("tags"))
    lanes = (("first", ["the", "of"]), ("second", ["der", "die"]))
    return tags.select("doc_id", V.lane(F.col("tags"), lanes).alias("lane"), V.matched_labels(F.col("tags"), ["the", "of", "der", "die", "und", "les", "que"]).alias("labels"))


_FAM = "(values ('der', 'de'), ('die', 'de'), ('und', 'de'), ('the', 'en'), ('of', 'en'), ('les', 'fr'), ('des', 'fr'), ('los', 'es'), ('las', 'es')) as v(word, fam)"


@query("SCA-17", f"""with w as (select distinct doc_id, unnest(string_split(lower(text), ' ')) as word from documents)
select doc_id, min(fam) as family from w join {_FAM} using (word) group by doc_id having count(distinct fam) = 1""")
def _(spark, d):
    vocabulary = {"der": "de", "die": "de", "und": "de", "the": "en", "of": "en", "les": "fr", "des": "fr", "los": "es", "las": "es"}
    return V.single_family(table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")), "doc_id", "word", vocabulary)


@query("SCA-18", f"with {SC} select doc_id, case when len < 300 then 'one' when len < 1800 then 'two' else 'many' end as band from sc")
def _(spark, d):
    return scored(spark, d).select("doc_id", V.band(F.col("len"), (300, 1800), ("one", "two", "many")).alias("band"))


@query("SCA-19", "select o_orderkey, case when o_totalprice >= 400000 then 2 when o_totalprice >= 200000 then 1 else 0 end as ppv_band from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.band(F.col("o_totalprice"), (200000, 400000), (0, 1, 2)).alias("ppv_band"))


@query("SCA-20", "select doc_id, case when quality is null then 'unknown' when quality + toxic = 0 then 'none_no_variation' when quality + toxic < 1 then 'none' when quality + toxic < 2 then 'low' else 'adequate' end as power from labels")
def _(spark, d):
    x = F.col("quality") + F.col("toxic")
    return table(spark, d, "labels").select("doc_id", V.power_band(x, F.col("quality").isNull(), 1.0, 2.0).alias("power"))


@query("SCA-21", "select l_orderkey, l_linenumber, repeat('(', l_linenumber) || '..' || repeat(')', l_linenumber) as structure, -l_quantity as consensus_mfe, -l_tax as covariance_term, l_linenumber::int as n_base_pairs, l_suppkey::int as nseq, l_partkey::int as alen, l_discount as avgid, 1::int as false_positive_pairs, l_linenumber::int as covarying_pairs, 22::int as bpairs_tested, 7::int as found_pairs, l_discount as sensitivity, l_tax as ppv, l_quantity as avg_subs_per_bp, l_tax as expected_covarying, 3.0::double as observed_covarying from lineitem")
def _(spark, d):
    """Reports as the folding and covariation tools print them, parsed by their lines."""
    from ..sources import readers as R

    t = lambda c: F.col(c).cast("string")
    fold = F.concat(F.lit("\nACGU\n"), F.expr("repeat('(', l_linenumber)"), F.lit(".."), F.expr("repeat(')', l_linenumber)"), F.lit(" ( "), (-F.col("l_quantity")).cast("string"), F.lit(" =  -1.50 + "), (-F.col("l_tax")).cast("string"), F.lit(")\n"))
    report = F.concat(F.lit("# MSA x_1 nseq "), t("l_suppkey"), F.lit(" (9) alen "), t("l_partkey"), F.lit(" (9) avgid "), t("l_discount"), F.lit(" nbpairs 22\n#  GTp  none [FP | TP True Found | Sen PPV F] [ 1 | "), t("l_linenumber"), F.lit(" 22 7 | "), t("l_discount"), F.lit(" "), t("l_tax"), F.lit(" 0.0]\n# avg substitutions per BP  "), t("l_quantity"), F.lit("\n# BPAIRS expected to covary "), t("l_tax"), F.lit("\n# BPAIRS observed to covary 3\n"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(fold, report).alias("value"))
    return R.covariation_report(R.fold_report(rows)).drop("value")


@query("SCA-22", f"with {SC}, x as (select doc_id, len / 500 as expected, floor(words / 50) as tp, len / 4000 as ppv from sc) select doc_id, case when tp = 0 and expected < 1 then 'no_signal' when expected >= 3 and tp >= 3 and ppv >= 0.8 then 'supported' when expected < 3 then 'underpowered' when tp >= 1 then 'borderline' else 'failed' end as verdict from x")
def _(spark, d):
    x = scored(spark, d).select("doc_id", (F.col("len") / 500).alias("expected"), F.floor(F.col("words") / 50).alias("tp"), (F.col("len") / 4000).alias("ppv"))
    return x.select("doc_id", V.covariation_verdict(F.col("expected"), F.col("tp"), F.col("ppv")).alias("verdict"))


@query("SCA-23", f"with {SC}, x as (select doc_id, case when len < 500 then 'failed' else 'borderline' end as old, len / 500 as expected from sc) select doc_id, old, case when old = 'failed' and expected < 3 then 'underpowered' else old end as verdict from x")
def _(spark, d):
    x = scored(spark, d).select("doc_id", F.when(F.col("len") < 500, "failed").otherwise("borderline").alias("old"), (F.col("len") / 500).alias("expected"))
    return x.withColumn("verdict", V.relabelled(F.col("old"), F.col("expected"))).drop("expected")


@query("SCA-24", "with x as (select page_id, regexp_extract_all(html, '<[^>]*>|(?s:.)') as t from pages) select page_id, len(t)::bigint as n_tokens, t[1] as first_token from x")
def _(spark, d):
    t = F.regexp_extract_all("html", F.lit("<[^>]*>|(?s:.)"), F.lit(0))
    return table(spark, d, "pages").select("page_id", F.size(t).cast("long").alias("n_tokens"), F.element_at(t, 1).alias("first_token"))


@query("SCA-26", "select page_id, left(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 80) as name from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", V.file_name(F.col("url")).alias("name"))


@query("SCA-27", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("PRJ-01", f"with {TL} select event_id, contig::varchar || ':' || pos::varchar || '-' || (pos + 60)::varchar || ':' || case when event_id % 2 = 0 then '+' else '-' end as anchor_id, family, family = 'purchase' as is_anchor from tl")
def _(spark, d):
    return timeline(spark, d).select("event_id", V.anchor_id(F.col("contig"), F.col("pos"), F.col("pos") + 60, F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).alias("anchor_id"), "family", (F.col("family") == "purchase").alias("is_anchor"))


@query("PRJ-02", f"with {TL}, a as (select event_id, contig::varchar || ':' || pos::varchar || '-' || (pos + 60)::varchar || ':+' as i from tl) select event_id, regexp_extract(i, '^(.*):([0-9]+)-([0-9]+):([+-])$', 1) as contig, regexp_extract(i, ':([0-9]+)-([0-9]+):([+-])$', 1)::bigint as start_pos, regexp_extract(i, ':([0-9]+)-([0-9]+):([+-])$', 2)::bigint as end_pos, regexp_extract(i, ':([+-])$', 1) as strand from a")
def _(spark, d):
    a = timeline(spark, d).select("event_id", V.anchor_id(F.col("contig"), F.col("pos"), F.col("pos") + 60, F.lit(1)).alias("i"))
    return a.select("event_id", V.parse_anchor_id(F.col("i")).alias("p")).select("event_id", "p.*")


@query("PRJ-03", "select p_partkey, case when len(string_split(lower(p_name), ' ')) >= 2 then string_split(lower(p_name), ' ')[1] || '_' || string_split(lower(p_name), ' ')[2] else lower(p_name) end as slug from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", V.slug(F.col("p_name")).alias("slug"))


@query("PRJ-04", "select doc_id, coalesce(case when source in ('', 'unknown', 'NA', 'src0') then null else source end, nullif(lang, ''), 'unknown') as species from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", V.resolve_label(F.col("source"), F.col("lang"), ("", "unknown", "NA", "src0")).alias("species"))


@query("PRJ-05", "select page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 80) as safe from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", V.safe_name(F.col("url")).alias("safe"))


@query("PRJ-06", "select p_partkey, case when regexp_matches(p_brand, '^Brand#[0-9]$') then 'single' when regexp_matches(p_brand, '^Brand#[0-9]{2}$') then 'double' else 'other' end as style from part")
def _(spark, d):
    styles = (("single", "^Brand#[0-9]$"), ("double", "^Brand#[0-9]{2}$"))
    return table(spark, d, "part").select("p_partkey", V.style(F.col("p_brand"), styles).alias("style"))


@query("PRJ-07", "select doc_id, case when n_chars < 700 then '<700' when n_chars < 1000 then '700-1000' when n_chars < 1400 then '1000-1400' when n_chars < 2000 then '1400-2000' else '2000+' end as band from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", V.band(F.col("n_chars"), (700, 1000, 1400, 2000), ("<700", "700-1000", "1000-1400", "1400-2000", "2000+")).alias("band"))


@query("PRJ-08", "with n as (select doc_id, case when doc_id % 3 = 0 then 'DECOY_shuffle__' || source || '__rep1' when doc_id % 3 = 1 then 'DECOY_background__' || source || '__rep2' else source end as clade from documents) select doc_id, case when starts_with(clade, 'DECOY_') then regexp_extract(clade, '^DECOY_([^_]+)__', 1) else 'real' end as mode, case when starts_with(clade, 'DECOY_') then regexp_extract(clade, '__(.*)__rep[0-9]+$', 1) else clade end as bag from n")
def _(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("DECOY_shuffle__"), "source", F.lit("__rep1"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("DECOY_background__"), "source", F.lit("__rep2"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", name.alias("clade")).select("doc_id", V.decoy_mode(F.col("clade")).alias("mode"), V.decoy_bag(F.col("clade")).alias("bag"))
