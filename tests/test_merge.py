"""Merging shards with an audit."""

from __future__ import annotations

import pytest

from spanloom.operators.audit import merge_audited, shard_problems

SUMMARY = "shard string, expected long, complete boolean, parameters map<string,string>, failures array<string>"


def _frames(spark, *told, shards=("a", "a", "b")):
    return spark.createDataFrame([(s, i) for i, s in enumerate(shards)], "shard string, x int"), spark.createDataFrame(list(told), SUMMARY)


def test_equal_shards_merge_and_carry_failures(spark):
    told = [("a", 2, True, {"w": "7", "out": "/1"}, ["late"]), ("b", 1, True, {"out": "/2", "w": "7"}, []), ("c", 0, True, {"w": "7"}, None)]
    rows, failures = merge_audited(*_frames(spark, *told), but=["out"])
    assert sorted(map(tuple, rows.collect())) == [(0,), (1,), (2,)] and list(map(tuple, failures.collect())) == [("a", "late")]
    assert shard_problems(*_frames(spark, *told)).count() == 2  # the folders count unless they are left out


def test_every_problem_is_told(spark):
    told = [("a", 3, True, {"w": "7"}, []), ("b", None, None, {"w": "8", "v": "1"}, []), ("d", 4, True, None, []), ("e", 0, True, {"w": "7"}, []), ("e", 0, True, {"w": "7"}, [])]
    frames = _frames(spark, *told, shards=("a", "a", "b", "c", None))
    assert {tuple(r) for r in shard_problems(*frames).collect()} == {
        ("a", "2 rows, 3 expected"), ("b", "incomplete"), ("b", "parameters differ: v, w"), ("c", "no summary"), (None, "no summary"),
        ("d", "0 rows, 4 expected"), ("d", "parameters differ: w"), ("e", "several summaries"),
    }
    with pytest.raises(ValueError, match="a: 2 rows, 3 expected"):
        merge_audited(*frames)


def test_empty_tables(spark):
    assert shard_problems(*(f.limit(0) for f in _frames(spark, ("a", 1, True, {}, [])))).collect() == []
