"""Every query of the library with SQL against DuckDB over the smallest tables; the others have to run."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert names
        return
    cursor = duck.execute(sql)
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted((tuple(plain(row[i]) for i in at) for row in cursor.fetchall()), key=repr)
    assert got == want


def test_no_id_range_is_left_out(spark, tmp_path):
    words = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix strong potions"
    spark.createDataFrame([(i, words, "en", "s") for i in (50, 53, 77, 100)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("SIM-08", "SIM-09", "SIM-10"):  # ids divisible by 50 against all
        assert {(r["q"], r["s"]) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == {(q, s) for q in (50, 100) for s in (50, 53, 77, 100) if q != s}, name
    lines = [(900, n, 50, 10 * n, "1995-02-01") for n in range(1, 4)] + [(1000 + n, 1, 50, 5, "1995-02-01") for n in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "1995-01-01") for k in (900, 1000, 1001, 1002, 1003)], "o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["locus"] for r in catalog.queries()["WIN-11"](spark, str(tmp_path)).collect()} == {"900", "1000", "1001", "1002", "1003"}
    assert catalog.queries()["A1-blocks"](spark, str(tmp_path)).count() == 1
    assert catalog.queries()["A1-block-members"](spark, str(tmp_path)).count() == 5


def test_texts_are_taken_whole(spark, tmp_path):
    from spanloom.operators.proteins import frames_of
    from spanloom.operators.similarity import longest_inverted_repeat, stop_free
    from spanloom.sources.adapters import BASES, LETTERS

    words = "the quick brown fox jumps over a lazy dog "
    texts = {0: words * 30, 1: words * 30 + "and seven wizards mix potions", 2: words * 40, 3: "short one", 4: "", 5: None, 6: words * 30 + "adg" + "aaa" * 30 + "daa"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seqs = {i: t.replace(" ", "").translate(str.maketrans(LETTERS, BASES)) for i, t in texts.items() if t is not None}
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r["id"]: r["stop_free"] for r in run("SCA-06")} == {i: stop_free(s) for i, s in seqs.items()} | {5: None}
    assert {r["id"]: r["ir_arm"] for r in run("SCA-08")} == {i: longest_inverted_repeat(s) if len(s) <= 600 else None for i, s in seqs.items()} | {5: None}
    assert {r["id"] for r in run("SIM-12") if r["mean"] is not None} == {0, 1, 2, 3, 6}
    assert max(r["e"] for r in run("SIM-01") if r["id"] == 6) > 600
    assert max(r["qe"] for r in run("SIM-08") if r["q"] == 0) > 600
    found = {r["id"]: r["cluster"] for r in run("SIM-05")}
    assert len(found) == 6 and (found[0], found[1], found[2]) == (0, 1, 0)
    every = {(i, *x) for i, t in seqs.items() for x in frames_of(t, 183)}
    kept = {(r["id"], r["s"], r["e"], r["strand"], r["protein"]) for r in run("SIM-16")}
    assert kept <= every and len(kept) <= 3 and max(len(x[-1]) for x in kept) == max(len(x[-1]) for x in every)
    assert {x[-1][:6] for x in kept} == {x[-1][:6] for x in every}  # each kind has a representative


def test_stop_free_is_the_longest_open_run():
    import random

    from spanloom.operators.similarity import stop_free

    rng = random.Random(2)
    for n in range(200):
        seq, best = "".join(rng.choice("ACGTTAAN") for _ in range(n)), 0
        for text in (seq, seq.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]):
            for f in range(3):
                run = 0
                for i in range(f, n - 2, 3):
                    run = 0 if text[i : i + 3] in ("TAA", "TAG", "TGA") else run + 3
                    best = max(best, run)
        assert stop_free(seq) == best


def test_rungs_and_shuffles_are_the_surveys(spark):
    assert {r["rung"] for r in catalog.queries()["AGG-18"](spark, DATA).collect()} == {1.0, 0.95, 0.9, 0.7}
    (row,) = catalog.queries()["STA-02"](spark, DATA).collect()
    assert row["p"] * 20001 == pytest.approx(round(row["p"] * 20001)) and row["p"] * 201 != pytest.approx(round(row["p"] * 201))


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    listed = "import __spark_entry__ as e; print('op11_near_duplicates' in e.queries(), len(e.oracle_sql()) > 200)"
    done = subprocess.run([sys.executable, "-c", listed], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr
