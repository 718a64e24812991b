"""Samplers, null models, sweeps, readers and the block caller on small inputs."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from spanloom.operators import audit, blocks, components, joins, nulls, records, sampling, scorer, similarity, sweep
from spanloom.sources import readers, sinks


def test_samples_ignore_row_order(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", str(i), "".join(rng.choice("ACGT") for _ in range(40)), i % 5) for i in range(120)]
    kind = "clade string, id string, seq string, pref int"
    for mode in ("stratified", "diverse", "hash", "first"):
        out = []
        for seed in (0, 1):
            shuffled = rows[:]
            random.Random(seed).shuffle(shuffled)
            df = spark.createDataFrame(shuffled, kind).repartition(1 + seed * 3)
            out.append(sorted(map(tuple, sampling.sample_groups(df, "clade", "id", "seq", "pref", 4, 1, mode).select("clade", "id").collect())))
        assert out[0] == out[1] and len(out[0]) == 8, mode


def _clade(groups: int, per_group: int) -> list[tuple[str, str, str, int]]:
    rows = []
    for g in range(groups):
        base = "".join(random.Random(g).choice("ACDEFGHIKL") for _ in range(30))
        rows += [("c", f"g{g}_{i:03}", base[: i % 30] + "W" + base[i % 30 :], 0) for i in range(per_group)]
    return rows


_SAMPLED = "clade string, id string, seq string, pref int"


@pytest.mark.parametrize(("cap", "dedup"), [(4, False), (4, True)])
def test_stratified_gives_exactly_cap_over_all_subgroups(spark, cap, dedup):
    rows = _clade(3, 40) + [("c", "none", None, 9), ("small", "x", "ACDE", 0)]
    got = sampling.sample_groups(spark.createDataFrame(rows, _SAMPLED), "clade", "id", "seq", "pref", cap, 1, "stratified", dedup).collect()
    mine = [r["id"] for r in got if r["clade"] == "c"]
    assert len(mine) == len(set(mine)) == cap and [r["id"] for r in got if r["clade"] == "small"] == ["x"]
    assert {i.split("_")[0] for i in mine} == {"g0", "g1", "g2"}


def test_the_cap_is_filled_from_copies_and_rows_without_a_sequence(spark):
    rows = [("c", f"{i:02}", "ACDEFGH" if i < 3 else None, 0) for i in range(7)]
    df = spark.createDataFrame(rows, _SAMPLED)
    for mode, dedup in (("stratified", True), ("diverse", False)):
        got = [r["id"] for r in sampling.sample_groups(df, "clade", "id", "seq", "pref", 5, 1, mode, dedup).collect()]
        assert len(got) == len(set(got)) == 5
        assert dedup or set(got) >= {"00", "01", "02"}


def _likeness(x, y):
    a, b = ({s[i : i + 5] for i in range(len(s) - 4)} for s in (x, y))
    return len(a & b) / len(a | b)


def test_every_seed_is_the_farthest_row_left(spark):
    rows = [(c, i, s, int(i[-1])) for c, i, s, _ in _clade(4, 15)]
    found = sampling.spread(sampling.profiles(spark.createDataFrame(rows, _SAMPLED), "clade", "id", "seq", "pref", 1), 6).orderBy("round").collect()
    tie = {i: hashlib.sha1(f"1:{i}".encode()).hexdigest() for _, i, _, _ in rows}
    seq, before = {i: s for _, i, s, _ in rows}, []
    for r in found:
        rank = {i: (min([1 - _likeness(s, seq[b]) for b in before], default=1.0), p, tie[i]) for _, i, s, p in rows if i not in before}
        assert max(rank, key=rank.get) == r["seed"]
        before.append(r["seed"])


def test_references_are_the_longest_of_each_subgroup(spark):
    rows = [(c, i, s, 500 if i.endswith("_007") else 100) for c, i, s, _ in _clade(3, 30)]
    got = [r["id"] for r in sampling.pick_references(spark.createDataFrame(rows, _SAMPLED), "clade", "id", "seq", "pref", 3).collect()]
    assert sorted(got) == ["g0_007", "g1_007", "g2_007"]
    few = sampling.pick_references(spark.createDataFrame(rows[:3] + [("c", "n", None, 1)], _SAMPLED), "clade", "id", "seq", "pref", 4).collect()
    assert sorted(r["id"] for r in few) == ["g0_000", "g0_001", "g0_002", "n"]


def test_merge_and_runs(spark):
    df = spark.createDataFrame([("g", i, s, e) for i, (s, e) in enumerate([(0, 10), (10, 12), (5, 20), (30, 40), (32, 50)])], "g string, m int, s long, e long")
    assert sorted((r["s"], r["e"]) for r in sweep.merge(df, "g").collect()) == [(0, 20), (30, 50)]
    got = sweep.runs(sweep.coverage(df, "g", "m"), "g", 2)
    assert sorted((r["s"], r["e"]) for r in got.collect()) == [(5, 12), (32, 40)]


def test_overlap_join_meets_each_pair_once(spark):
    rng = random.Random(8)
    rows = [("g", i, s, s + rng.randrange(1, 200)) for i, s in enumerate(rng.randrange(1000) for _ in range(60))]
    df = spark.createDataFrame(rows, "g string, i int, s long, e long")
    got = sorted((r["i"], r["r_i"], r["overlap"]) for r in joins.overlapping(df, df, "g", 50).collect())
    want = sorted((a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in rows for b in rows if min(a[3], b[3]) > max(a[2], b[2]))
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102))


def test_decoys_mirror_sizes_and_exclude_their_clade(spark):
    rows = [("f", f"c{i % 6}", str(i)) for i in range(120)]
    made = nulls.permutation_decoys(spark.createDataFrame(rows, "family string, clade string, id string"), "family", "clade", "id", 3, 1)
    got = made.collect()
    assert len(got) == 6 * 3 * 20 and all(r["source"] != r["clade"] for r in got)
    quality = nulls.decoy_quality(made, "family", "clade").collect()
    assert not any(r["degenerate"] for r in quality) and max(r["max_source_fraction"] for r in quality) <= 0.25


def test_shuffled_anchors_stay_apart(spark):
    df = spark.createDataFrame([(i, 5000, 900, 11000) for i in range(200)], "id long, off long, alen long, n long")
    for r in nulls.shuffled_anchors(df, "id", "off", "alen", "n", 2000, 7).collect():
        real = r["off"] if r["pseudo_strand"] > 0 else r["n"] - r["off"] - r["alen"]
        assert abs(r["pseudo_offset"] - real) >= 2000 and 0 <= r["pseudo_offset"] <= r["n"] - r["alen"]


def test_blocks_from_planted_segments(spark):
    seg = [("c", m, -300 + m % 3, -200 + m % 3, -300 + m % 3, -200 + m % 3, "+") for m in range(12)]
    seg += [("c", m, 500 + 60 * m, 550 + 60 * m, 0, 50, "+") for m in range(3)]
    scored, members = blocks.call_blocks(spark.createDataFrame(seg, "clade string, member int, rs long, re long, ms long, me long, strand string"), spark.createDataFrame([("c", 15)], "clade string, n int"))
    got = scored.collect()
    assert len(got) == 1 and got[0]["members"] == 12 and got[0]["recurrence"] == pytest.approx(0.8)
    assert members.count() == 12


def _slow_inverted_repeat(s):
    other = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    n = len(s)
    return max((k for k in range(1, n + 1) for i in range(n - k + 1) for j in range(n - k + 1) if s[i : i + k] == other[j : j + k] and abs(i + j + 2 * k - n - 1) > 2), default=0)


def test_inverted_repeat_by_brute_force():
    assert similarity.longest_inverted_repeat("GGGGGGGGAAAAAAAAAACCCCCCCC") == 8
    assert similarity.longest_inverted_repeat("ACGTACGT") == 8 and similarity.longest_inverted_repeat("GGGGGACGTACGTCCCCC") == 18
    rng = random.Random(4)
    for n in range(40):
        s = "".join(rng.choice("ACGT" if n % 2 else "AT") for _ in range(n))
        assert similarity.longest_inverted_repeat(s) == _slow_inverted_repeat(s)


def test_stop_free_by_brute_force():
    rng = random.Random(5)
    for n in range(60):
        s = "".join(rng.choice("ATG") for _ in range(n))
        want = 0
        for text in (s, s.translate(str.maketrans("ACGT", "TGCA"))[::-1]):
            for f in range(3):
                codons = [text[i : i + 3] for i in range(f, len(text) - 2, 3)]
                want = max(want, *(3 * len(list(g)) for stop, g in itertools.groupby(codons, lambda c: c in ("TAA", "TAG", "TGA")) if not stop), 0)
        assert similarity.stop_free(s) == want


def test_helices_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"l{g}", rng.randrange(40), 40 + rng.randrange(30)) for g in range(6) for _ in range(25)] + [("one", 5, 9), ("down", 1, 50), ("down", 2, 49), ("down", 3, 48), ("down", 30, 35)]
    want = []
    for g in {r[0] for r in rows}:
        tails = {}
        for i, j in sorted((i, j) for name, i, j in rows if name == g):
            h = next((h for h in sorted(tails) if max(abs(i - tails[h][0]), abs(j - tails[h][1])) <= 4), len(tails))
            tails[h] = (i, j)
            want.append((g, i, j, h))
    got = blocks.helices(spark.createDataFrame(rows, "locus string, i int, j int"), "locus").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(r["helix"] for r in got if r["locus"] == "down") == [0, 0, 0, 1]


def _slow_scores(seq, net):
    """Window by window, layer by layer."""
    half, out = scorer.WINDOW // 2, []
    ring = seq * (1 + 2 * -(-half // len(seq)))
    first = len(seq) * -(-half // len(seq))
    for i in range(len(seq)):
        x = scorer.one_hot(ring[first + i - half : first + i + half + 1])
        for (kernel, bias), pool in zip(net.convolutions, scorer.POOLS, strict=True):
            x = np.array([np.maximum((x[j : j + len(kernel)] * kernel.transpose(2, 0, 1)).sum((1, 2)) + bias, 0) for j in range(len(x) - len(kernel) + 1)])
            x = np.array([x[j : j + pool].max(0) for j in range(0, len(x) - pool + 1, pool)])
        for k, (w, b) in enumerate(net.dense):
            x = x.reshape(-1) @ w + b
            x = np.maximum(x, 0) if k == 0 else 1 / (1 + np.exp(-x))
        out.append(float(x[0]))
    return out


def test_scores_by_brute_force():
    rng, net = random.Random(7), scorer.random_net(5)
    for n in (1, 7, 60, 140):
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        assert scorer.per_base(seq, net) == pytest.approx(_slow_scores(seq, net))
    assert scorer.summary(np.array([0.2, 0.6, 0.7])) == pytest.approx((0.5, 0.7, 2 / 3, 0.5, None, 0))
    p = np.linspace(0, 1, 200)
    mean, most, high, best, core, size = scorer.summary(p)
    assert (most, high, size) == (1.0, 0.5, 100) and best == pytest.approx(p[-50:].mean()) and core == pytest.approx(p[50:150].mean())


def test_files_are_zipped_by_place_or_refused(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 30), ("b", 1, 5)], "g string, o int, s int")
    right = spark.createDataFrame([("a", 7, "x"), ("a", 8, "y"), ("a", 9, "z"), ("b", 1, "w")], "g string, p int, aa string")
    got = records.zip_records(left, right, "g", ["o"], ["p"], ["s"]).collect()
    assert sorted((r["g"], r["s"], r["aa"]) for r in got) == [("a", 10, "x"), ("a", 30, "z"), ("b", 5, "w")]
    with pytest.raises(Exception, match="unequal number in a"):
        records.zip_records(left.where("o < 3"), right, "g", ["o"], ["p"]).collect()
    with pytest.raises(Exception, match="no such model: q"):
        records.fetch_models(spark.createDataFrame([("m", 1)], "name string, leng int"), spark.createDataFrame([("f", "q")], "family string, name string"), "name").collect()


def test_reports_are_parsed_by_their_lines(spark):
    text = "x\nACGU\n((..)) ( -3.20 =  -1.50 +  -1.70)\n# MSA m nseq 12 (20) alen 80 (90) avgid 71.5 (70) nbpairs 9\n# GTp  none  [FP | TP True Found | Sen PPV F]  [ 1 | 0 22 1 | 0.0 0.0 0.0]\n# avg substitutions per BP  4.5\n# BPAIRS expected to covary 2.5\n# BPAIRS observed to covary 0\n"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "k int, value string")
    one, two = readers.covariation_report(readers.fold_report(df)).orderBy("k").collect()
    assert (one["structure"], one["consensus_mfe"], one["covariance_term"], one["n_base_pairs"]) == ("((..))", -3.2, -1.7, 2)
    assert (one["nseq"], one["alen"], one["avgid"], one["covarying_pairs"], one["bpairs_tested"], one["found_pairs"]) == (12, 80, 71.5, 0, 22, 1)
    assert (one["avg_subs_per_bp"], one["expected_covarying"], one["observed_covarying"]) == (4.5, 2.5, 0)
    assert two["structure"] == "" and two["nseq"] is None and two["ppv"] is None
    with pytest.raises(ValueError, match="missing columns"):
        readers.external_references(df, {"name": "absent"}, "name")


def test_places_in_sorted_groups(spark):
    from spanloom.operators.aggregate import at_fractions

    rng = random.Random(8)
    rows = [(g, rng.randrange(9) if rng.random() < 0.9 else None) for g in "abc" for _ in range(rng.randrange(1, 60))]
    got = at_fractions(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", {"q": 0.25, "h": 0.5, "n": 0.99, "z": 1.0}).collect()
    for r in got:
        v = sorted(x for g, x in rows if g == r["g"] and x is not None)
        assert [r[k] for k in "qhnz"] == [v[min(len(v) - 1, int(f * len(v)))] for f in (0.25, 0.5, 0.99, 1.0)] and r["most"] == v[-1]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n\n>b\nGG\n")
    got = [tuple(r) for r in readers.fasta(spark, str(tmp_path / "x.fa")).orderBy("header").collect()]
    assert got == [("a one", "ACGTAC"), ("b", "GG")]


def test_header_must_have_what_is_required(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("w1 anchor_len=30",), ("w2 anchor_len=5 x=1",)], "header string").select(readers.header_fields("header").alias("f"))
    assert [r[0] for r in df.select(F.col("f")["anchor_len"]).collect()] == ["30", "5"]
    with pytest.raises(Exception, match="lacks x="):
        df.select(readers.required("f", "x")).collect()


def test_tables_drop_bad_rows_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, None, 2.5)], "k int, name string, v double")
    sinks.write_tsv(df, str(tmp_path / "t"), ["k", "name", "v"], "k")
    back = readers.table(spark, str(tmp_path / "t"), "k int, name string, v double").orderBy("k")
    assert [tuple(r) for r in back.collect()] == [(1, "x", None), (2, None, 2.5)]


def test_preconditions(spark):
    rows = spark.range(2)
    with pytest.raises(ValueError, match="incomplete"):
        audit.require_complete(rows, spark.createDataFrame([("s1", True), ("s2", None)], "shard string, complete boolean"))
    with pytest.raises(ValueError):
        audit.require_rows(rows.where("id > 5"), "nothing")
    with pytest.raises(ValueError):
        readers.check_config({"families": {"a": ["RF001"]}})
    with pytest.raises(ValueError):
        readers.check_config({"families": {"a": ["m"], "b": ["m"]}})


def test_stream_census(spark):
    from spanloom.streaming.census import stream_census

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("props")
    want = sorted(map(tuple, stream_census(events).collect()))
    assert sum(r[2] for r in want) == events.count()
    assert spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001").isStreaming


@pytest.mark.parametrize("bound", [1 << 21, 3000])
def test_pairs_and_clusters_of_common_kmers_are_whole(spark, bound):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    template, other = word(150), word(150)
    near = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in s)
    seqs = [near(template) for _ in range(260)] + [template[:75] + word(75) for _ in range(20)] + [near(other) for _ in range(5)] + ["ACG", "ACG", "", None]
    rows = [("g" if i % 40 else "h", i, s) for i, s in enumerate(seqs)]
    sets = [{s} if s is None or len(s) < 11 else {s[o : o + 11] for o in range(len(s) - 10)} for s in seqs]
    want = {}
    for g, a, _ in rows:
        for h, b, _ in rows[a + 1 :]:
            if g == h and (v := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.3:
                want[a, b] = v
    df = spark.createDataFrame(rows, "grp string, id long, seq string").repartition(3)
    got = similarity.kmer_pairs(df, "grp", "id", "seq", 11, 0.3, bound=bound).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["jaccard"] for r in got} == want
    root = list(range(len(seqs)))
    for a, b in sorted(want):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    found = {r["id"]: r["cluster"] for r in similarity.cluster(df, "grp", "id", "seq", 0.3, bound=bound).collect()}
    assert found == {i: root[i] for i, s in enumerate(seqs) if s is not None}


def test_rungs_nest_and_compare_only_families_of_a_large_group(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    near = lambda s, p: "".join(rng.choice("ACGT") if rng.random() < p else c for c in s)
    seqs = [word(60 + i) for i in range(90)]
    for f in range(4):
        root = word(400)
        seqs += [near(root, p) for p in (0, 0.002, 0.002, 0.01, 0.03)] + [root]
    rows = [(None if i % 31 == 5 else "g", i, s) for i, s in enumerate(seqs)]
    sets = [{s[o : o + 11] for o in range(len(s) - 10)} for s in seqs]
    values = {(a, b): v for g, a, _ in rows for h, b, _ in rows[a + 1 :] if g == h and (v := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.3}
    df = spark.createDataFrame(rows, "grp string, id long, seq string")
    compared, real = [], similarity._links
    monkeypatch.setattr(similarity, "_links", lambda sized, *a: (compared.append(sized.count()), real(sized, *a))[1])
    found = {(r["rung"], r["id"]): r["cluster"] for r in similarity.rungs(df, "grp", "id", "seq", (1.0, 0.9, 0.7), bound=3000).collect()}
    assert max(compared) <= 4 * 6
    for least in (1.0, 0.9, 0.7):
        root = list(range(len(seqs)))
        for (a, b), v in values.items():
            if v >= least:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
        assert {i: c for (rung, i), c in found.items() if rung == least} == dict(enumerate(root))


def test_greatest_value_with_least_key_without_a_sort(spark):
    from spanloom.operators.joins import greatest_of

    rng = random.Random(3)
    keys = [5, 6, (1 << 47) - 1, 1 << 47, (1 << 62) + 1, -4]
    rows = [(i % 40, rng.choice([0, 3, 4, (1 << 15) - 1, 1 << 15, 1 << 40]) if i % 40 > 9 else i % 3, rng.choice(keys)) for i in range(400)]
    got = greatest_of(spark.createDataFrame(rows, "g long, v long, k long"), ["g"], "v", "k")
    want = {g: max(((v, -k) for h, v, k in rows if h == g)) for g in range(40)}
    assert {r["g"]: (r["v"], -r["k"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan and "Sort " not in plan


@pytest.mark.parametrize("mode", ["stratified", "diverse"])
def test_greedy_samples_see_the_whole_group(spark, mode):
    rng = random.Random(9)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    rows = [("g", f"{i:04}", base[: 20 + i % 30] + "A" + base[20 + i % 30 :], 1) for i in range(400)] + [("g", "far", "T" * 60, 1), ("g", "best", base, 9)]
    got = {r["id"] for r in sampling.sample_groups(spark.createDataFrame(rows, "clade string, id string, seq string, pref int"), "clade", "id", "seq", "pref", 2, 1, mode).collect()}
    assert got == {"far", "best"}


def test_round_trip_of_a_window(spark):
    from pyspark.sql import functions as F

    from spanloom.functions import intervals as I

    rows = [("ACGTTGCAAC", "GTTGCA", 3, 8, 1), ("ACGTTGCAAC", "TGCAAC", 3, 8, -1), ("ACGTTGCAAC", "GTTGGA", 3, 8, 1), ("ACGTTGC", "GTTGC", 3, 8, 1), ("ACGTTGC", "GCAAC", 3, 8, -1)]
    df = spark.createDataFrame(rows, "contig string, win string, ws int, we int, strand int")
    place = I.to_genome(F.col("ws"), F.col("we"), F.lit(1), F.lit(5), F.col("strand"))
    got = df.withColumn("g", place).select(I.round_trip(F.col("contig"), F.col("win"), F.col("g"), F.lit(1), F.lit(5), F.col("strand")).alias("p"))
    # a planted mismatch, and a contig that ends inside the window: on strand - the map is off by what is missing
    assert [r["p"] for r in got.collect()] == [True, True, False, True, False]


def test_permutations_are_uniform_and_are_not_exploded(spark):
    from math import comb

    from spanloom.operators.statistics import permutation_p

    rows = spark.createDataFrame([(i, float(i), int(i in (5, 6, 9))) for i in range(10)], "k long, v double, y int")
    exact = sum(a + b + c >= 20 for a in range(10) for b in range(a) for c in range(b)) / comb(10, 3)
    for block_rows in (3, 100):  # some blocks, and one
        out = permutation_p(rows, "k", "v", "y", 4000, 7, block_rows, 500)
        (got,) = out.collect()
        assert got["observed"] == 20 / 3
        assert abs(got["p"] - exact) < 0.03
        assert permutation_p(rows.repartition(5), "k", "v", "y", 4000, 7, block_rows, 500).collect() == [got]
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # no sort of rows x replicates
    assert permutation_p(rows.where("k < 0"), "k", "v", "y", 10, 1).collect() == []
    assert permutation_p(rows.where("y = 0"), "k", "v", "y", 10, 1).collect() == []
    (all_positive,) = permutation_p(rows.where("y = 1"), "k", "v", "y", 10, 1).collect()
    assert all_positive["p"] == 1


def test_stop_free_runs_of_many_shuffles_at_once():
    import random
    import time

    import numpy as np

    from spanloom.operators import similarity as S

    def slow(seq):
        turned, best = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1], 0
        for s in (seq, turned):
            for f in range(3):
                run = 0
                for i in range(f, len(s) - 2, 3):
                    run = 0 if s[i : i + 3] in ("TAA", "TAG", "TGA") else run + 3
                    best = max(best, run)
        return best

    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5, 6, 50, 400):
        rows = ["".join(rng.choices("ACGTN", (4, 1, 1, 4, 0.2), k=n)) for _ in range(20)]
        assert S.stop_free_rows(np.stack([S._letter_codes(x) for x in rows])).tolist() == [slow(x) for x in rows] == [S.stop_free(x) for x in rows]
    seq = "A" * 30 + "T" * 30 + "G" * 40
    runs = S.shuffled_stop_free(seq, 4000, 3)
    plain = [slow("".join(rng.sample(seq, len(seq)))) for _ in range(4000)]
    assert len(runs) == 4000 and abs(runs.mean() - np.mean(plain)) < 1 and abs(runs.std() - np.std(plain)) < 1
    long, began = "".join(rng.choices("ACGT", k=200_000)), time.process_time()
    assert len(S.shuffled_stop_free(long, 60, 1)) == 60
    assert time.process_time() - began < 4  # 8 s by one shuffle at a time
    assert S.shuffled_stop_free("", 60, 0).tolist() == [0] * 60


def test_spread_joins_no_rows_between_rounds_and_weighs_only_rows_that_can_be_taken(spark, monkeypatch):
    written, tables = sampling.written, []

    def noted(df, label):
        tables.append((label, df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(sampling, "written", noted)
    rows = spark.createDataFrame([("c", str(i), "ACGT" * (i % 7) + "GATTACA" * (i % 5) + "C" * i, i // 4) for i in range(60)], _SAMPLED)
    placed = sampling.profiles(rows, "clade", "id", "seq", "pref", 1)
    seeds = sampling.spread(placed, 3)
    assert {label for label, _, _ in tables} == {"seeds"}  # no table of all rows
    whole = {(r["id"], r["seed"]): r["depth"] for r in sampling.by_typicality(placed, seeds, 10**6).collect()}
    assert len(whole) == 60
    some = {(r["id"], r["seed"]): r["depth"] for r in sampling.by_typicality(placed, seeds, 2).collect()}
    assert some == {k: depth for k, depth in whole.items() if depth <= 2}
    assert all("bag" not in columns for label, columns, _ in tables if label == "near-seeds")


def test_pairs_meet_without_their_sequences_and_copies_follow(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import minwise

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    near = lambda s, p: "".join(rng.choice("ACGT") if rng.random() < p else c for c in s)
    root = word(400)
    seqs = [near(root, p) for p in (0, 0.01, 0.02, 0.04, 0.06)] + [root] * 3 + [word(300) for _ in range(60)] + ["", "", "ACG", "ACG", "ACT", None, None]
    rows = [("g", i, s) for i, s in enumerate(seqs)] + [("g", 1, seqs[1])] + [(None, 200, root), (None, 201, root), ("h", 300, None), ("h", 301, None)]
    sets = {i: {s[o : o + 11] for o in range(len(s) - 10)} or {s} for _, i, s in rows if s is not None}
    known = [(g, i) for g, i, s in rows if g is not None and s is not None]
    want = sorted((a, b, v) for g, a in known for h, b in known if g == h and a < b and (v := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.3)
    df = spark.createDataFrame(rows, "grp string, id long, seq string")
    got = similarity.kmer_pairs(df, "grp", "id", "seq", 11, 0.3).collect()
    assert sorted((r["a"], r["b"], r["jaccard"]) for r in got) == want
    assert similarity.kmer_pairs(df.limit(0), "grp", "id", "seq", 11, 0.3).count() == 0
    heads = df.where("grp = 'g' and length(seq) >= 11").dropDuplicates(["seq"]).select(F.col("grp").alias("g"), "id", "seq")
    for chunk in (1 << 13, 7):
        met = [(r["a"], r["b"]) for r in minwise.near_pairs(minwise.digested(heads, 11, 0.3), 0.3, chunk).collect()]
        own = {r["id"] for r in heads.collect()}
        assert len(met) == len(set(met)) and {(a, b) for a, b, _ in want if a in own and b in own} <= set(met)
        assert all(a < b < 8 for a, b in met)  # unrelated sequences are never fetched
