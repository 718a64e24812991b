"""The block caller sweeps the reference axis once, and its bins do not show in the result."""

from spanloom.operators.blocks import call_blocks


def test_coverage_is_swept_once_whatever_the_bins(spark):
    rows = [("a", m, 10 * m % 70, 10 * m % 70 + 200 + 40 * (m % 5), "+") for m in range(30)] + [("b", m, 5000 * m, 5000 * m + 100, "-") for m in range(9)]
    segments = spark.createDataFrame([(c, m, s, e, s + 3, e + 3, t) for c, m, s, e, t in rows], "clade string, member long, rs long, re long, ms long, me long, strand string")
    windows = spark.createDataFrame([("a", 30), ("b", 9)], "clade string, n long")
    found = {}
    for size in (16, 256, 1024):
        scored, members = call_blocks(segments, windows, bin_size=size)
        found[size] = sorted(map(tuple, scored.collect())), sorted(map(tuple, members.collect()))
        files = {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in members.inputFiles()}
        assert files == {"blocks"}
    assert found[16] == found[256] == found[1024] and {r[0] for r in found[16][1]} == {"a"}
