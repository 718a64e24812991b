"""Golden cases of the interval and sequence functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import intervals as I
from spanloom.functions import sequence as S
from spanloom.functions import verdicts as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = lambda v: F.lit(v).cast("long")
pairs = lambda *x: F.array(*[F.struct(L(a).alias("s"), L(b).alias("e")) for a, b in x]) if x else F.array().cast(I.ARRAY)


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((100, 200, 120, 180, 500, 600, "+"), (520, 580)),
        ((100, 200, 120, 180, 500, 600, "-"), (520, 580)),
        ((100, 200, 130, 200, 500, 600, "+"), (530, 600)),
        ((100, 200, 130, 200, 500, 600, "-"), (500, 570)),
        ((0, 100, 40, 100, 0, 50, "+"), (20, 50)),
        ((0, 100, 40, 100, 0, 200, "+"), (80, 200)),
        ((100, 200, 160, 170, 500, 501, "+"), None),
    ],
)
def test_trim(spark, args, want):
    rs, re, bs, be, ms, me, strand = args
    got = one(spark, I.trim_member(L(bs), L(be), L(rs), L(re), L(ms), L(me), F.lit(strand)))
    assert (got and tuple(got)) == want


def test_trim_never_crosses(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        rs, ms, bs = rng.randrange(200), rng.randrange(200), rng.randrange(200)
        rows.append((bs, bs + rng.randrange(1, 90), rs, rs + rng.randrange(1, 90), ms, ms + rng.randrange(1, 90), rng.choice("+-")))
    df = spark.createDataFrame(rows, "bs long, be long, rs long, re long, ms long, me long, strand string")
    cut = df.withColumn("t", I.trim_member(*map(F.col, df.columns))).where("t is not null")
    assert cut.where("t.s < ms or t.e > me or t.s >= t.e").count() == 0


def test_subtract(spark):
    assert [tuple(x) for x in one(spark, I.subtract(L(0), L(100), pairs((40, 60))))] == [(0, 40), (60, 100)]
    assert [tuple(x) for x in one(spark, I.subtract(L(0), L(100), pairs()))] == [(0, 100)]
    assert one(spark, I.subtract(L(10), L(20), pairs((0, 30)))) == []


def test_merged_touching(spark):
    assert [tuple(x) for x in one(spark, I.merged(pairs((5, 9), (0, 5), (20, 30))))] == [(0, 9), (20, 30)]
    assert one(spark, I.merged(pairs())) == []


def test_genome(spark):
    assert tuple(one(spark, I.to_genome(L(94601), L(105824), L(5000), L(6224), F.lit(1)))) == (99601, 100824)
    assert tuple(one(spark, I.to_genome(L(79543), L(90766), L(5000), L(6224), F.lit(-1)))) == (84543, 85766)


def test_flank(spark):
    plus = one(spark, I.flank(L(21), L(120), F.lit(1), L(20000), 5000, 11000))
    minus = one(spark, I.flank(L(21), L(120), F.lit(-1), L(20000), 5000, 11000))
    assert plus["left_flank"] == 20 and plus["truncated_left"] and not plus["truncated_right"]
    assert minus["right_flank"] == 20 and minus["truncated_right"] and not minus["truncated_left"]
    assert one(spark, I.flank(L(21), L(120), F.lit(1), L(9000), 5000, 11000)) is None


def test_kmers_and_jaccard(spark):
    assert one(spark, S.kmers(F.lit("AC"))) == ["AC"]
    assert len(one(spark, S.kmers(F.lit("ACDEFG")))) == 2
    empty = F.array().cast("array<string>")
    assert one(spark, S.jaccard(empty, F.array(F.lit("a")))) == 0
    assert one(spark, S.jaccard(F.array(F.lit("a")), F.array(F.lit("a")))) == 1


def test_reverse_complement_is_its_own_inverse(spark):
    text = "ACGTNRYacgtn"
    assert one(spark, S.reverse_complement(S.reverse_complement(F.lit(text)))) == text


def test_identity_skips_double_gaps(spark):
    assert one(spark, S.identity(F.lit("AC-T"), F.lit("AC-G"))) == pytest.approx(2 / 3)


def test_lane_precedence(spark):
    lanes = (("known", ["GIIM"]), ("plain", ["HTH"]))
    tags = F.array(F.lit("HTH"), F.lit("GIIM"))
    assert one(spark, V.lane(tags, lanes)) == "known"
    assert one(spark, V.lane(F.array(F.lit("x")), lanes)) == "unknown"


def test_null_is_neither_zero_nor_clean(spark):
    from spanloom.operators.aggregate import null_strength

    rows = spark.createDataFrame([(None, False), (None, True), (0, True), (3, True)], "n int, has boolean")
    assert [r[0] for r in rows.select(null_strength(F.col("n"), F.col("has"))).collect()] == ["none", "blockless", "clean", "resolved"]
