"""Sweeps in stretches against loops over sorted lists."""

from __future__ import annotations

import random

import pytest

from spanloom.operators import joins, sweep


def _intervals(seed: int):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        s = rng.randrange(-40, 200)
        rows.append((rng.choice(["a", "b", None]), rng.randrange(60), s, s + rng.choice([1, 2, 5, 9, 70 if i % 40 == 0 else 3])))
    return rows


def _merged(parts):
    out = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("stretch", [1, 16, 1 << 16, None])
def test_stretches_do_not_show(spark, stretch):
    rows = _intervals(7)
    df = spark.createDataFrame(rows, "grp string, member int, s long, e long")
    groups = {g for g, *_ in rows}
    got = {(r["grp"], r["s"], r["e"]) for r in sweep.merge(df, "grp", stretch=stretch).collect()}
    assert got == {(g, *x) for g in groups for x in _merged([(s, e) for h, _, s, e in rows if h == g])}
    spans = {}
    for g, m, s, e in rows:
        a, b = spans.get((g, m), (s, e))
        spans[g, m] = (min(a, s), max(b, e))
    depth = {g: {x: sum(s <= x < e for (h, _), (s, e) in spans.items() if h == g) for x in {v for (h, _), p in spans.items() if h == g for v in p}} for g in groups}
    covered = sweep.coverage(df, "grp", "member", stretch=stretch)
    assert {(r["grp"], r["x"], r["depth"]) for r in covered.collect()} == {(g, x, d) for g, per in depth.items() for x, d in per.items()}
    for need in (0, 1, 4):
        want = set()
        for g, per in depth.items():
            xs = sorted(per)
            want |= {(g, *x) for x in _merged([(x, y) for x, y in zip(xs, xs[1:]) if per[x] >= need])}
        assert {(r["grp"], r["s"], r["e"]) for r in sweep.runs(covered, "grp", need, stretch=stretch).collect()} == want, need


@pytest.mark.parametrize("stretch", [1, 16, 1 << 16, None])
def test_nearest_on_either_side(spark, stretch):
    rng = random.Random(3)
    points = [(rng.choice(["a", "b", "c", None]), i, None if i % 17 == 0 else rng.randrange(-30, 90)) for i in range(80)]
    others = [(rng.choice(["a", "b", None]), None if i == 4 else rng.randrange(-20, 80)) for i in range(25)]
    found = joins.nearest_sides(spark.createDataFrame(points, "c string, k int, p long"), spark.createDataFrame(others, "c string, p long"), "c", "p", "k", stretch=stretch)
    want = set()
    for c, k, p in points:
        near = [q for d, q in others if d == c is not None and q is not None and p is not None]
        want.add((c, k, p, max((q for q in near if q <= p), default=None), min((q for q in near if q >= p), default=None)))
    assert {(r["c"], r["k"], r["p"], r["before"], r["after"]) for r in found.collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "grp string, member int, s long, e long")
    assert sweep.merge(none, "grp").collect() == [] == sweep.runs(sweep.coverage(none, "grp", "member"), "grp", 1).collect()
