"""FASTA files on disk, read and written by the data source."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources.fasta import file_name, group_of, read_fasta, write_groups


def test_reads_plain_and_gzip_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk\n>one first\nACGT\nAC\n\n>two\n>three\r\nTTT\r\n")
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "b.fa.gz", "wt") as f:
        f.write(">four\nGGGÉ\n")
    (tmp_path / "c.txt").write_text(">no\nA\n")
    found = read_fasta(spark, str(tmp_path))
    assert sorted((r["name"], r["sequence"]) for r in found.collect()) == [("four", "GGGÉ"), ("one first", "ACGTAC"), ("three", "TTT"), ("two", "")]
    assert found.rdd.getNumPartitions() == 2
    assert [r["name"] for r in read_fasta(spark, f"file://{tmp_path}/deep/b.fa.gz").collect()] == ["four"]
    (tmp_path / "bare").mkdir()
    assert read_fasta(spark, f"file:{tmp_path}/bare").collect() == []
    with pytest.raises(Exception, match="none"):
        read_fasta(spark, f"{tmp_path}/none").collect()


@pytest.mark.parametrize("whole", [True, False])
def test_a_file_pair_per_group(spark, tmp_path, whole):
    groups = ["x", "a/b", "a_b", None, "", "ä .."]
    rows = [(groups[i % 6], f"n{i:03}", None if i == 7 else "ACGT" * (i % 5), i) for i in range(60)]
    write_groups(spark.createDataFrame(rows, "clade string, id string, seq string, extra int").repartition(5), f"{tmp_path}/out", "clade", "id", "seq", whole)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    for g in groups:
        own = [p for p in files if p.split(".")[0].rsplit("-", 1)[0] == file_name(g)]
        assert len(own) == 2 if whole else len(own) >= 2
        lines = [json.loads(x) for p in own if p.endswith("jsonl") for x in (tmp_path / "out" / p).read_text().splitlines()]
        assert [(x["clade"], x["id"], x["seq"], x["extra"]) for x in lines] == [r for r in rows if r[0] == g]
    back = read_fasta(spark, f"{tmp_path}/out").collect()
    assert sorted((r["name"], r["sequence"]) for r in back) == sorted((r[1], r[2] or "") for r in rows)
    if whole:
        assert {r["g"] for r in read_fasta(spark, f"{tmp_path}/out").select(group_of(F.col("file")).alias("g")).collect()} == set(groups)
    with pytest.raises(Exception, match="out"):
        write_groups(spark.createDataFrame(rows, "clade string, id string, seq string, extra int"), f"{tmp_path}/out", "clade", "id", "seq")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 5).alias("clade"), "id", F.when(F.col("id") == 33, F.raise_error(F.lit("planted"))).otherwise(F.lit("ACGT")).alias("seq"))
    with pytest.raises(Exception, match="planted"):
        write_groups(rows, f"{tmp_path}/out", "clade", "id", "seq")
    assert not (tmp_path / "out").exists()
