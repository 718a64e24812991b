"""Reading frames, their proteins and profile search against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from spanloom.operators import profiles, proteins

STOPS = ("TAA", "TAG", "TGA")


def _frames(seq, least):
    """Codon by codon."""
    out = set()
    for strand, text in ((1, seq), (-1, seq.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
        for shift in range(3):
            start = None
            for i in range(shift, len(text) - 2, 3):
                codon = text[i : i + 3]
                if start is None and codon in proteins.STARTS:
                    start = i
                elif start is not None and codon in STOPS:
                    if i + 3 - start >= least:
                        out.add((start, i + 3, 1) if strand > 0 else (len(text) - i - 3, len(text) - start, -1))
                    start = None
    return out


def test_frames_equal_a_loop_over_codons():
    rng = random.Random(5)
    for n in [*range(12), *(rng.randrange(400) for _ in range(150))]:
        seq = "".join(rng.choice("ACGTTAGN") for _ in range(n))
        found = list(proteins.frames_of(seq, 9))
        assert {x[:3] for x in found} == _frames(seq, 9) and len(found) == len(_frames(seq, 9))
        assert all(len(p) == (e - s) // 3 - 1 and p[0] == "M" and "*" not in p for s, e, _, p in found)


def test_proteins_of_known_codons(spark):
    gene = "ATGGCTTGGAAANNNGATTAA"
    turned = gene.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = [(1, "CC" + gene), (1, "CC" + gene), (2, turned + "C"), (3, None), (4, ""), (5, "é" + gene)]
    found = proteins.open_frames(spark.createDataFrame(rows, "id int, seq string"), "id", "seq", 12).collect()
    assert sorted(map(tuple, found)) == [(1, 2, 23, 1, "MAWKXD"), (2, 0, 21, -1, "MAWKXD"), (5, 1, 22, 1, "MAWKXD")]


def test_query_proteins_have_their_length_and_number(spark):
    rng = random.Random(1)
    gene = lambda n: "ATG" + "".join(rng.choice(("GCT", "AAA", "GAT", "TGG")) for _ in range(n - 1)) + "TAA"
    rows = [("a", i, gene(60)) for i in range(9)] + [("a", 20, gene(59)), ("b", 30, gene(80)), (None, 31, gene(80)), ("c", 32, None)]
    got = proteins.query_proteins(spark.createDataFrame(rows, "bag string, id int, seq string"), "bag", "id", "seq").where("strand = 1").collect()
    assert all(len(r["protein"]) >= 60 for r in got) and {r["bag"] for r in got} <= {"a", "b"}
    assert 1 <= sum(r["bag"] == "a" for r in got) <= 3 and 20 not in {r["id"] for r in got}


def _plain(text, bits, gap):
    """Local alignment to columns, cell by cell; bits by (letter, column)."""
    last, best, end = [0.0] * (len(bits[0]) + 1), 0.0, 0
    for i, letter in enumerate(text):
        row = [0.0]
        k = profiles.LETTERS.find(letter)
        for j in range(len(bits[0])):
            row.append(max(0.0, last[j] + bits[k][j], last[j + 1] - gap, row[j] - gap))
        if max(row) > best + 1e-9:
            best, end = max(row), i + 1
        last = row
    return best, end


def test_scores_equal_a_plain_alignment():
    rng = np.random.default_rng(2)
    table = np.full((3, 21, 9), -1e9)
    for m, width in enumerate((9, 4, 1)):
        table[m, :20, :width], table[m, 20, :width] = rng.normal(0, 3, (20, width)), 0
    texts = ["".join(rng.choice(list(profiles.LETTERS + "X"), n)) for n in (0, 1, 2, 40, 17, 40, 90)]
    score, end = profiles.best_scores(texts, table, 1.5)
    for i, text in enumerate(texts):
        for m in range(3):
            want, at = _plain(text, table[m].tolist(), 1.5)
            assert score[i, m] == pytest.approx(want) and end[i, m] == at


def test_planted_motifs_are_found_and_resolved(spark):
    rng = random.Random(8)
    motifs = {"one": "WCHWCHKKDE", "two": "FYFYPPGGNN"}
    noise = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    change = lambda s: "".join(c if rng.random() < 0.9 else rng.choice("ACDEFGHIKLMNPQRSTVWY") for c in s)
    seeds = [(m, change(s)) for m, s in motifs.items() for _ in range(15)]
    df = spark.createDataFrame(seeds, "model string, seq string")
    matrices = profiles.build(df, "model", "seq")
    cells = {(r["model"], r["place"], r["letter"]): r["bits"] for r in matrices.collect()}
    every = Counter("".join(s for _, s in seeds))
    q = {c: (every[c] + 1) / (sum(every.values()) + 20) for c in profiles.LETTERS}
    assert len(cells) == 2 * 10 * 20
    for (m, j, c), bits in cells.items():
        column = Counter(s[j] for k, s in seeds if k == m)
        assert bits == pytest.approx(math.log2((column[c] + q[c]) / (sum(column.values()) + 1) / q[c]))
    a, b = motifs.values()
    rows = [(0, noise(60)), (1, noise(30) + a + noise(30)), (2, noise(20) + b + noise(9)), (3, b + noise(15) + a), (4, a[:5] + "A" + a[5:]), (5, None), (6, ""), (1, a)]
    cutoffs = spark.createDataFrame([("one", 15.0), ("two", 15.0)], "model string, cutoff double")
    hits = profiles.search(spark.createDataFrame(rows, "id int, seq string"), "id", "seq", matrices, cutoffs)
    assert sorted((r["id"], r["model"]) for r in hits.collect()) == [(1, "one"), (1, "one"), (2, "two"), (3, "one"), (3, "two"), (4, "one")]
    families = spark.createDataFrame([("one", "x", 1), ("two", "y", 2)], "model string, family string, priority int")
    anchors = {r["id"]: (r["family"], r["models"]) for r in profiles.resolve(hits, "id", families).collect()}
    assert anchors == {1: ("x", ["one"]), 2: ("y", ["two"]), 3: ("y", ["one", "two"]), 4: ("x", ["one"])}
    least = {r["model"]: r["cutoff"] for r in profiles.seed_cutoffs(df, "model", "seq", matrices).collect()}
    assert set(least) == set(motifs) and all(v > 0 for v in least.values())


def test_no_models_and_too_many(spark, monkeypatch):
    none = profiles.build(spark.createDataFrame([], "model string, seq string"), "model", "seq")
    rows = spark.createDataFrame([(1, "ACD")], "id int, seq string")
    assert profiles.search(rows, "id", "seq", none, spark.createDataFrame([], "model string, cutoff double")).collect() == []
    some = profiles.build(spark.createDataFrame([("m", "ACD")], "model string, seq string"), "model", "seq")
    monkeypatch.setattr(profiles, "MOST_CELLS", 10)
    with pytest.raises(ValueError):
        profiles.library(some)
