"""Readers and writers on the adapters: SRC and SNK operators.

The test tables hold no biological files, so each reader parses text lines that the query makes from a table's columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators.proteins import open_frames
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.adapters import IV, SEQS, sequences, table
from ..sources.fasta import group_of, read_fasta, write_groups
from .registry import query


@query("SRC-01", f"with {SEQS} select id::varchar || ' src=' || clade as header, seq from seqs where length(seq) > 0")
def _(spark, d):
    s = sequences(spark, d).where(F.length("seq") > 0)
    body = F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" src="), "clade", F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n\n"))
    return R.fasta_records(s.select(body.alias("value")))


@query("SRC-02", f"with {SEQS} select 'c' || id::varchar as contig, length(seq)::bigint as contig_len from seqs")
def _(spark, d):
    h = sequences(spark, d).select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit(" clade="), "clade").alias("header"), F.length("seq").cast("long").alias("contig_len"))
    return h.select(R.record_id("header").alias("contig"), "contig_len")


def gff_lines(spark, d):
    p = table(spark, d, "lineitem")
    return p.select(F.concat_ws("\t", F.col("l_suppkey").cast("string"), F.lit("x"), F.when(F.col("l_returnflag") == "R", "gene").otherwise("CDS"), (F.col("l_partkey") + 1).cast("string"), (F.col("l_partkey") + 91).cast("string"), F.lit("."), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+"), F.lit("0"), F.concat(F.lit("ID="), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(";partial=00;aa="), "l_linestatus", F.col("l_quantity").cast("long").cast("string"))).alias("value"))


@query("SRC-03", "select l_suppkey::varchar as contig, l_partkey as s, l_partkey + 91 as e, case when l_linenumber % 2 = 0 then '-' else '+' end as strand, '00' as partial from lineitem where l_returnflag <> 'R'")
def _(spark, d):
    return R.gff(gff_lines(spark, d)).select("contig", "s", "e", "strand", F.col("attributes")["partial"].alias("partial"))


@query("SRC-04", "with r as (select l_linenumber, l_orderkey, l_partkey, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey) as rn from lineitem where l_returnflag <> 'R') select l_orderkey::varchar || '_' || l_linenumber::varchar as orf, l_partkey as s from r where rn = 1 and l_linenumber <= 3")
def _(spark, d):
    from ..operators.joins import best_of

    found = R.gff(gff_lines(spark, d)).select(F.col("attributes")["ID"].alias("orf"), "s")
    wanted = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("orf"))
    return best_of(found.join(wanted, "orf", "left_semi"), ["orf"], "s")


def _hits(spark, d, sep):
    c = [F.col("l_orderkey").cast("string"), F.lit("-"), F.lit("100"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")), *[F.lit("0")] * 8, F.col("l_discount").cast("string"), F.col("l_extendedprice").cast("string"), *[F.lit("1")] * 8, F.lit("some long description")]
    return table(spark, d, "lineitem").select(F.concat_ws(sep, *c).alias("value"))


@query("SRC-05", "select l_orderkey::varchar as target, 'm' || l_suppkey::varchar as query, l_discount as evalue, l_extendedprice as score from lineitem")
def _(spark, d):
    return R.domain_table(_hits(spark, d, "  "))


@query("SRC-06", "select l_orderkey::varchar as model, 'm' || l_suppkey::varchar as seq_id, l_discount as evalue, l_extendedprice as score, 'some long description' as description from lineitem")
def _(spark, d):
    return R.scan_table(_hits(spark, d, " "))


@query("SRC-07", "select l_suppkey::varchar as q, l_partkey::varchar as t, min(l_discount) as evalue from lineitem where l_discount <= 0.05 group by 1, 2")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws(" ", F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_discount").cast("string")).alias("value"))
    return R.columns(lines, ("t", "q", "evalue"), ("string", "string", "double"), (0, 2, 4)).where("evalue <= 0.05").groupBy("q", "t").agg(F.min("evalue").alias("evalue"))


@query("SRC-08", "select l_suppkey::varchar as query, l_partkey::varchar as target, l_quantity as identity, l_orderkey as length, 1::bigint as qs, 2::bigint as qe, 3::bigint as ts, 4::bigint as te from lineitem")
def _(spark, d):
    c = [F.col(x).cast("string") for x in ("l_suppkey", "l_partkey", "l_quantity", "l_orderkey")]
    return R.alignments(table(spark, d, "lineitem").select(F.concat_ws("\t", *c, F.lit("0"), F.lit("0"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), F.lit("1e-5"), F.lit("50")).alias("value")))


def _folder(spark, name):
    """A new folder in the shared place."""
    import uuid

    from ..operators.scratch import scratch_root

    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("SRC-09", "select n_nationkey::bigint as k, nullif(n_name, '') as n_name, case when n_nationkey % 4 <> 0 then n_regionkey::bigint end as r from nation")
def _(spark, d):
    """Written with a header and blanks, read back by the header."""
    path = _folder(spark, "table")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("r"))
    K.write_tsv(rows, path, ["k", "n_name", "r"])
    return R.table(spark, path, "k bigint, n_name string, r bigint")


@query("SRC-10", "select n_nationkey::varchar as k, n_name, case when n_nationkey % 2 = 0 then n_regionkey::varchar end as r from nation where n_nationkey % 3 <> 0")
def _(spark, d):
    """Two shards with columns of their own; rows of another width than their header are dropped."""
    root, n = _folder(spark, "shards"), table(spark, d, "nation")
    key, bad = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 3 == 0
    for i, names in enumerate((("k", "n_name", "r"), ("k", "n_name"))):
        cells = [key, F.col("n_name"), F.col("n_regionkey").cast("string")][: len(names)]
        line = F.when(bad, F.concat_ws("\t", *cells, F.lit("x"))).otherwise(F.concat_ws("\t", *cells))
        head = spark.createDataFrame([("\t".join(names),)], "value string")
        head.union(n.where(F.col("n_nationkey") % 2 == i).select(line)).coalesce(1).write.text(f"{root}/shard{i}")
    return R.tables(spark, f"{root}/shard*", ("k", "n_name", "r"))


@query("SRC-11", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_id % 5 <> 0")
def _(spark, d):
    line = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", F.from_json(line, "k bigint, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("j"))
    return rows.where("j._corrupt is null").select("event_id", "j.k")


@query("SRC-12", "select doc_id, coalesce(try_cast(case when doc_id % 4 = 0 then 'n/a' else n_chars::varchar end as integer), -1)::bigint as bytes from documents")
def _(spark, d):
    text = F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", V.safe_int(text, -1).cast("long").alias("bytes"))


@query("SRC-13", "select s_suppkey::varchar as genome, case when s_suppkey % 2 = 0 then s_name end as path from supplier where s_suppkey % 7 <> 0")
def _(spark, d):
    line = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("# "), "s_name")).when(F.col("s_suppkey") % 2 == 0, F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name")).otherwise(F.col("s_suppkey").cast("string"))
    cells = F.split("value", "\t")
    rows = table(spark, d, "supplier").select(line.alias("value")).where(~F.col("value").startswith("#"))
    return rows.select(cells[0].alias("genome"), F.get(cells, F.lit(1)).alias("path"))


@query("SRC-14", "with p as (select doc_id::varchar as accession, source as view, lang as species from documents where doc_id % 5 <> 0 union all select doc_id::varchar, 'zz', 'other' from documents where doc_id % 2 = 0 and doc_id % 5 <> 0), r as (select *, row_number() over (partition by accession order by view, species) as rn from p) select accession, species from r where rn = 1")
def _(spark, d):
    """Paths as a listing of the views gives them; other files and other folders do not count."""
    docs, key = table(spark, d, "documents"), F.col("doc_id").cast("string")
    name = F.concat(key, F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".fna.gz"))
    first = docs.select(F.concat(F.lit("/db/views/"), "source", F.lit("/by_species/"), "lang", F.lit("/"), name).alias("path"))
    later = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("/db/views/zz/by_species/other/"), name))
    stray = docs.select(F.concat(F.lit("/db/other/"), name))
    return R.species_view(first.union(later).union(stray))


@query("SRC-15", f"with {SEQS}, k as (select id, case when id % 3 = 0 then seq else text end as raw from seqs join documents on id = doc_id), u as (select id, upper(regexp_replace(coalesce(raw, ''), '[ \t\n\x0B\f\r]+', '', 'g')) as s from k) select id::varchar as retron_id, case when regexp_matches(s, '^[ACGTUN]*$') then length(s) else 0 end::bigint as ncrna_len, case when regexp_matches(s, '^[ACGTUN]*$') then s else '' end as ncrna from u")
def _(spark, d):
    """An outside table under its own names; what is no nucleotide sequence is emptied."""
    raw = F.when(F.col("id") % 3 == 0, F.col("seq")).otherwise(F.col("text"))
    rows = sequences(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("_id"), raw.alias("Sequence"))
    return R.external_references(rows, {"retron_id": "_id", "ncrna": "Sequence"}, "ncrna").withColumn("ncrna_len", F.col("ncrna_len").cast("long"))


@query("SRC-16", "select l_linenumber::bigint as i, l_suppkey as j, l_quantity as score from lineitem where l_orderkey % 9 <> 0")
def _(spark, d):
    line = F.when(F.col("l_orderkey") % 9 == 0, F.lit("# comment")).otherwise(F.concat_ws(" ", F.lit("*"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"), F.lit("0.01"), F.lit("0.5")))
    return R.covarying_pairs(table(spark, d, "lineitem").select(line.alias("value"))).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "score")


@query("SRC-17", "select p_partkey, '# ' || p_brand || chr(10) || '# second' as comments, repeat('(', p_size::int % 5) || '..' || repeat(')', p_size::int % 5) as structure from part")
def _(spark, d):
    """A file per part: comment lines, and a structure over several lines."""
    k = (F.col("p_size") % 5).cast("int")
    value = F.concat(F.lit("# "), "p_brand", F.lit("\n"), F.expr("repeat('(', cast(p_size % 5 as int))"), F.lit("\n..\n\n# second\n"), F.expr("repeat(')', cast(p_size % 5 as int))"), F.lit("\n"))
    return R.structure_file(table(spark, d, "part").where(k.isNotNull()).select("p_partkey", value.alias("value"))).drop("value")


@query("SRC-18", f"with {SEQS} select id, clade, family from seqs")
def _(spark, d):
    h = sequences(spark, d).withColumn("header", F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" clade="), "clade", F.lit(" family="), "family")).select("id", R.header_fields("header").alias("f"))
    return h.select("id", R.required("f", "clade").alias("clade"), R.required("f", "family").alias("family"))


@query("SRC-19", f"with {SEQS} select id, length(seq)::bigint as n from seqs where id % 3 = 0")
def _(spark, d):
    h = sequences(spark, d).select("id", F.concat(F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "|candidate|").otherwise("|control|")).alias("header"), F.length("seq").cast("long").alias("n"))
    return h.where(F.col("header").contains("|candidate|")).select("id", "n")


@query("SRC-21", "select * from (values ('first', 'PF1'), ('first', 'PF2'), ('second', 'PF3')) as t(family, model)")
def _(spark, d):
    c = R.check_config({"families": {"first": ["PF1", "PF2"], "second": ["PF3"]}})
    return spark.createDataFrame([(f, m) for f, ms in c["families"].items() for m in ms], "family string, model string")


@query("SNK-01", "select n_nationkey::varchar || chr(9) || case when n_nationkey % 2 = 0 then n_name else '' end as value from nation")
def _(spark, d):
    return K.tsv_lines(table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))), ("n_nationkey", "n_name"))


def _sequence_files(spark, rows, group, seq):
    """Writes a FASTA and a JSONL file per group to a new folder and reads the FASTA files back."""
    path = _folder(spark, "sink")
    write_groups(rows, path, group, "id", seq)
    return read_fasta(spark, path).withColumn(group, group_of(F.col("file")))


@query("SNK-02", f"with {SEQS} select clade, count(*)::bigint as n, sum(length(seq))::bigint as bases from seqs group by 1")
def _(spark, d):
    back = _sequence_files(spark, sequences(spark, d).select("clade", "id", "seq"), "clade", "seq")
    return back.groupBy("clade").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("bases"))


@query("SNK-03", f"with {SEQS} select family, count(*)::bigint as n from seqs group by 1")
def _(spark, d):
    return _sequence_files(spark, sequences(spark, d).select("family", "id", "seq"), "family", "seq").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("SNK-03-proteins")
def _(spark, d):
    """A file of proteins per family: how many there are, and their letters."""
    rows = sequences(spark, d)
    found = open_frames(rows, "id", "seq", 60).withColumnRenamed("id", "source").join(rows.select(F.col("id").alias("source"), "family").distinct(), "source")
    back = _sequence_files(spark, found.withColumn("id", F.concat_ws(":", "source", "s", "e", "strand")), "family", "protein")
    return back.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("letters"))


@query("SNK-04", f"with {SEQS} select '>' || clade || '|' || id::varchar || chr(10) || substr(seq, 11, 50) as value from seqs where length(substr(seq, 11, 50)) >= 10 and id % 4 <> 0")
def _(spark, d):
    rows = sequences(spark, d).where("id % 4 <> 0").withColumn("cut", F.substring("seq", 11, 50)).where(F.length("cut") >= 10)
    return K.fasta_lines(rows, F.concat("clade", F.lit("|"), F.col("id").cast("string")), "cut")


@query("SNK-05", "select '{' || string_agg('\"' || k || '\":' || n::varchar, ',' order by k) || '}' as summary from (select o_orderstatus as k, count(*) as n from orders group by 1)")
def _(spark, d):
    return K.summary(table(spark, d, "orders"), "o_orderstatus")


@query("SNK-06", f"with {SEQS}, r as (select clade, id, 'seq' || lpad(row_number() over (partition by clade order by id)::varchar, 5, '0') as name, left(seq, 30) as a from seqs where length(seq) >= 30) select clade, name, name || ' ' || translate(a, 'Tt', 'Uu') as line from r")
def _(spark, d):
    return K.stockholm(sequences(spark, d).where(F.length("seq") >= 30).select("clade", "id", F.substring("seq", 1, 30).alias("a")), "clade", "id", "a")


_NOTE = "chr(10) || '                     /note=\"' || {0} || '\"' || chr(10)"


@query("SNK-07", f"with {SEQS} select id, 'LOCUS       ' || id::varchar || ' ' || length(seq)::varchar || ' bp DNA' || chr(10) || 'FEATURES             Location/Qualifiers' || chr(10) || '     ' || rpad('source', 16, ' ') || '1..' || length(seq)::varchar || {_NOTE.format('clade')} || '     ' || rpad('misc_feature', 16, ' ') || case when id % 2 = 0 then '5..' || (id + 40)::varchar else '' end || {_NOTE.format('family')} || 'ORIGIN' || chr(10) || coalesce(array_to_string([lpad((i * 60 + 1)::varchar, 9, ' ') || ' ' || rtrim(regexp_replace(lower(substr(seq, i * 60 + 1, 60)), '(.{{10}})', '\\1 ', 'g')) for i in range(0, ceil(length(seq) / 60)::int)], chr(10)), '') || chr(10) || '//' as record from seqs")
def _(spark, d):
    s, one = sequences(spark, d), F.lit(1).cast("long")
    feature = lambda kind, start, end, proven, note: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.cast("long").alias("end"), proven.alias("proven"), F.col(note).alias("note"))
    features = F.array(feature("source", one, F.length("seq"), F.lit(True), "clade"), feature("misc_feature", one + 4, F.col("id") + 40, F.col("id") % 2 == 0, "family"))
    return K.genbank(s.withColumn("features", features), "id", "seq", "features")


@query("SNK-08", f"with {IV}, x as (select grp, min(s) as lo, max(e) as hi from iv group by grp), r as (select *, row_number() over (partition by grp order by member, s, e) as rn from iv) select grp, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"' || (hi - lo)::varchar || '\">' || string_agg('<rect x=\"' || (s - lo)::varchar || '\" y=\"' || (12 * rn)::varchar || '\" width=\"' || (e - s)::varchar || '\" height=\"10\"/>', '' order by rn) || '</svg>' as svg from r join x using (grp) where rn <= 200 group by grp, lo, hi")
def _(spark, d):
    from ..sources.adapters import intervals

    return K.member_plot(intervals(spark, d), "grp", "member", "s", "e")


@query("SNK-09", "with g as (select o_custkey as locus, count(*) over (partition by o_custkey) as n, min(o_orderstatus) over (partition by o_custkey) as verdict, o_orderkey, o_orderkey::varchar || ' | ' || o_orderstatus as cells from orders) select locus, '## ' || locus::varchar || chr(10) || chr(10) || '- blocks: ' || any_value(n)::varchar || chr(10) || '- verdict: ' || any_value(verdict) || chr(10) || chr(10) || string_agg('| ' || cells || ' |', chr(10) order by o_orderkey, cells) as report from g group by locus")
def _(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("locus"), "o_orderkey", "o_orderstatus")
    rows = o.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("locus"))).withColumn("cells", F.concat_ws(" | ", F.col("o_orderkey").cast("string"), "o_orderstatus"))
    return K.report(rows, "locus", {"blocks": "n", "verdict": "o_orderstatus"}, "cells", "o_orderkey")


@query("SNK-10", "select l_orderkey, l_linenumber from lineitem")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return K.merge_shards([rows.where(F.col("l_orderkey") % 4 == i) for i in range(4)])


@query("SNK-10-audit", "with e as (select o_orderkey % 4 as shard, count(*) as expected from orders group by 1), k as (select l_orderkey % 4 as shard, count(distinct l_orderkey) as n from lineitem group by 1) select shard, n::varchar || ' rows, ' || expected::varchar || ' expected' as problem from (select e.shard, coalesce(n, 0) as n, expected from e left join k using (shard)) where n <> expected")
def _(spark, d):
    """Orders that have lines, in four shards, against the orders there are."""
    from ..operators.audit import shard_problems

    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("shard"), "l_orderkey").distinct()
    told = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("expected"))
    return shard_problems(rows, told.withColumn("complete", F.lit(True)).withColumn("parameters", F.create_map(F.lit("key"), F.lit("l_orderkey"))))


@query("SNK-11", "select o_orderstatus as family, count(*)::bigint as n, count(distinct o_custkey)::bigint as genomes from orders group by 1")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    whole = K.merge_shards([rows.where(F.col("o_orderkey") % 3 == i) for i in range(3)])
    return whole.groupBy(F.col("o_orderstatus").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("genomes"))
