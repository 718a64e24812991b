"""Writers.  Large outputs are partitioned Parquet; text formats are made as columns and written by Spark's text writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tsv_lines(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``value``: a row's cells joined by tabs, blank where null."""
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]).alias("value"))


def write_tsv(rows: DataFrame, path: str, names: Sequence[str], *order: Column | str) -> None:
    """An ordered, headed TSV as part files in order."""
    (rows.orderBy(*order) if order else rows).select(*names).write.option("sep", "\t").option("header", True).option("nullValue", "").csv(path)


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    rows.repartition(*by).write.partitionBy(*by).parquet(path)


def fasta_lines(rows: DataFrame, header: Column, seq: str) -> DataFrame:
    return rows.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(rows: DataFrame, path: str, header: Column, seq: str, group: str | None = None) -> None:
    """FASTA text, one folder per group if given."""
    lines = rows.withColumn("value", F.concat(F.lit(">"), header, F.lit("\n"), F.col(seq)))
    if group:
        lines.select(group, "value").repartition(group).write.partitionBy(group).text(path)
    else:
        lines.select("value").write.text(path)


def stockholm(rows: DataFrame, group: str, key: str, aligned: str, structure: str | None = None) -> DataFrame:
    """group, name, line: renamed rows with T as U; the structure line only where its length equals the alignment's."""
    w = W.partitionBy(group).orderBy(key)
    named = rows.withColumn("name", F.format_string("seq%05d", F.row_number().over(w)))
    lines = named.select(group, "name", F.concat("name", F.lit(" "), F.translate(aligned, "Tt", "Uu")).alias("line"))
    if structure:
        cons = rows.where(F.length(structure) == F.length(aligned)).groupBy(group).agg(F.min(structure).alias("_s"))
        lines = lines.unionByName(cons.select(group, F.lit("SS_cons").alias("name"), F.concat(F.lit("#=GC SS_cons "), "_s").alias("line")))
    return lines


def origin(seq: Column) -> Column:
    """A whole sequence as numbered lines of six blocks of ten."""
    block = lambda i: F.rtrim(F.regexp_replace(F.substr(seq, (i * 60 + 1).cast("int"), F.lit(60)), "(.{10})", "$1 "))
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.length(seq) / 60).cast("int") - 1), lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), block(i)))
    return F.when(F.length(seq) > 0, F.array_join(lines, "\n")).otherwise("")


def genbank(rows: DataFrame, name: str, seq: str, features: str) -> DataFrame:
    """name, record: a flat-file record of the whole sequence.  ``features``: an array of (kind, start, end, proven, note).

    The location of a feature is blank where its round trip to the contig was not proven.
    """
    where = lambda f: F.when(f["proven"], F.concat(f["start"].cast("string"), F.lit(".."), f["end"].cast("string"))).otherwise("")
    feature = lambda f: F.concat(F.lit("     "), F.rpad(f["kind"], 16, " "), where(f), F.lit('\n                     /note="'), f["note"], F.lit('"\n'))
    head = F.concat(F.lit("LOCUS       "), F.col(name).cast("string"), F.lit(" "), F.length(seq).cast("string"), F.lit(" bp DNA\nFEATURES             Location/Qualifiers\n"))
    record = F.concat(head, F.array_join(F.transform(features, feature), ""), F.lit("ORIGIN\n"), origin(F.lower(seq)), F.lit("\n//"))
    return rows.select(name, record.alias("record"))


def member_plot(rows: DataFrame, group: str, member: str, start: str, end: str, most: int = 200) -> DataFrame:
    """group, svg: a bar for each of a block's first ``most`` members on one axis that begins at the least start."""
    axis = rows.groupBy(group).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(member, start, end))).where(F.col("_rn") <= most).join(axis, group)
    number = lambda c: c.cast("long").cast("string")
    bar = F.concat(F.lit('<rect x="'), number(F.col(start) - F.col("_lo")), F.lit('" y="'), number(12 * F.col("_rn")), F.lit('" width="'), number(F.col(end) - F.col(start)), F.lit('" height="10"/>'))
    bars = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", bar.alias("b")))), lambda x: x["b"]), "")
    size = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), number(F.col("_hi") - F.col("_lo")), F.lit('">'))
    return ranked.groupBy(group, "_lo", "_hi").agg(bars.alias("_bars")).select(group, F.concat(size, "_bars", F.lit("</svg>")).alias("svg"))


def report(rows: DataFrame, locus: str, fields: dict[str, str], detail: str, order: str) -> DataFrame:
    """locus, report: a Markdown section per locus with a list of its summary values and a table of its blocks.

    ``fields``: label and column of a summary value, the least of the locus' rows; ``detail``: a column of finished table cells.
    """
    held = rows.groupBy(locus).agg(*[F.min(c).cast("string").alias(f"_{i}") for i, c in enumerate(fields.values())], F.sort_array(F.collect_list(F.struct(order, detail))).alias("_rows"))
    listed = F.concat(*[F.concat(F.lit(f"- {label}: "), F.coalesce(f"_{i}", F.lit("not available")), F.lit("\n")) for i, label in enumerate(fields)])
    lines = F.array_join(F.transform("_rows", lambda r: F.concat(F.lit("| "), r[detail], F.lit(" |"))), "\n")
    return held.select(locus, F.concat(F.lit("## "), F.col(locus).cast("string"), F.lit("\n\n"), listed, F.lit("\n"), lines).alias("report"))


def summary(rows: DataFrame, by: str) -> DataFrame:
    """summary: a count per value as one JSON object; only one row per value meets in a task."""
    counted = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n"))))).alias("summary"))


def merge_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Union of shard tables that must have the same columns in the same order."""
    first = shards[0]
    for s in shards[1:]:
        if s.columns != first.columns:
            raise ValueError(f"shards differ: {s.columns} and {first.columns}")
        first = first.unionByName(s)
    return first
