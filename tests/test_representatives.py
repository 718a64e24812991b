"""Clusters with representatives, against the sequential greedy loop and planted families."""

import random

from spanloom.operators.representatives import cover, ladder


def greedy(nodes, links):
    near, out = {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order = sorted(nodes, key=lambda i: (-nodes[i], i))
    for i in order:
        if i not in out:
            out[i] = i
            for j in near.get(i, ()):
                out.setdefault(j, i)
    return out


def test_cover_is_the_sequential_greedy(spark):
    rng = random.Random(4)
    nodes = {i: rng.randrange(5) for i in range(120)}
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)]
    links += [(a, a + 1) for a in range(100, 119)] + links[:5]
    got = cover(spark.createDataFrame(list(nodes.items()), "id long, n int"), spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["representative"] for r in got.collect()} == greedy(nodes, [x for x in links if x[0] != x[1]])


def test_planted_families_at_each_rung(spark):
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows, families = [], {}
    for f in range(6):
        root = draw(600)
        for c in range(8):
            text = "".join(rng.choice("ACGT".replace(x, "")) if rng.random() < 0.03 else x for x in root)
            if c % 3 == 1:
                text = text[:300] + text[305:]  # a gap
            rows.append((f * 10 + c, "g" if f < 3 else None, text))
            families[f * 10 + c] = f
        rows.append((f * 10 + 8, "g" if f < 3 else None, rows[-1][2]))  # a repeated sequence
        rows.append((f * 10 + 9, "g" if f < 3 else None, root[:250]))  # a part, too short for its whole
        families |= {f * 10 + 8: f}
    rows += [(100, "g", "ACGT"), (101, "g", "ACGT"), (102, "g", None), (103, "h", "ACGT"), (104, "h", "")]
    df = spark.createDataFrame(rows, "id long, g string, seq string")
    got = ladder(df, "g", "id", "seq", (0.99, 0.8), 0.8).collect()
    high, low = ({r["id"]: r["representative"] for r in got if r["rung"] == x} for x in (0.99, 0.8))
    assert len(high) == len(low) == len(rows) - 1
    for i, f in families.items():
        assert {j for j, g in families.items() if low[j] == low[i]} == {j for j, g in families.items() if g == f}
        assert low[f * 10 + 9] == f * 10 + 9 and high[i] == (i if i % 10 < 8 else i - 1)
    assert low[100] == low[101] == 100 and low[103] == 103 and low[104] == 104
    parts = {r["id"]: r["representative"] for r in ladder(df, "g", "id", "seq", (0.8,), 0.8, of_member_only=True).collect()}
    assert all(families[parts[f * 10 + 9]] == f for f in range(6))
    assert ladder(df.limit(0), "g", "id", "seq", (0.9,), 0.8).count() == 0


def test_a_word_of_all_rows_gives_one_pair_a_row(spark):
    from spanloom.operators.representatives import candidates

    rng = random.Random(6)
    shared = "ACGTTGCAAGCTTAGCATCGGATCTAGCTA"
    rows = [("g", i, shared + "".join(rng.choice("ACGT") for _ in range(5 + i % 7))) for i in range(300)]
    pairs = candidates(spark.createDataFrame(rows, "g string, id long, seq string")).collect()
    assert 299 <= len(pairs) < 3 * 300 and all(r["rep"] != r["member"] for r in pairs)
