"""Operators 11 to 13 by brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from spanloom.llm import op11_chosen_path, op12_whitening, op13_alignment
from spanloom.llm import queries as Q

KIND = "doc_id long, text string, lang string, source string, node string, `class` string, n int, segment string, block int"
LONG = " ".join(f"w{i % 5000}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (7, LONG), (8, "é ß 中 \x0b\x1c x"), (9, "à la  carte\n\nfin\r\n\tend "), (10, "a▁b"), (11, "x" * 5000), (12, "<s> <|endoftext|> <0x41>"), (13, "😀 ﬁ\x00\xa0 　z")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", "x", "y", 1, "z", 2) for r in rows], KIND)


def components_of(texts: dict, width: int = 4) -> dict:
    """Document to the least id of its component."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(lower).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(rng: random.Random) -> dict:
    """Groups whose texts differ by few to many words, a passage that many share, and texts of their own."""
    out, stock = {}, [f"t{i}" for i in range(3000)]
    passage = rng.choices(stock, k=60)
    for n in (120, 30, 6, 2):
        base = rng.choices(stock, k=150)
        for _ in range(n):
            own, edits = list(base), rng.randint(0, 12)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(stock)
            out[len(out)] = " ".join(own)
    for _ in range(60):
        out[len(out)] = " ".join(rng.choices(stock, k=rng.randint(1, 80)) + passage + rng.choices(stock, k=rng.randint(1, 80)))
    for i in range(20):
        out[len(out)] = " ".join(rng.choices(stock, k=rng.randint(1, 6))) if i % 2 else out[i].upper()
    return out


def test_chosen_path_against_all_pairs(spark):
    texts = near_copies(random.Random(8))
    odd = {10_000 + i: t for i, t in ODD if i}
    got = op11_chosen_path.link(frame(spark, [*texts.items(), *odd.items(), (None, LONG.upper()), (10_004, "one")]), small=8, trees=16, levels=4).collect()
    assert len(got) == len(texts) + len(odd) + 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == components_of(texts | odd)
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {10_007}


def test_chosen_path_of_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.op11_near_duplicates(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.collect() == []


def test_minwise_agreement_is_the_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.sort(pool[:800]), np.sort(pool[200:])
    keys, sketch = op11_chosen_path.minwise([a, b], 128)
    assert np.mean(keys[0] == keys[1]) == pytest.approx(0.6, abs=0.13)
    nibbles = lambda s: [(int(x) >> 4 * i) & 15 for x in s.view(np.uint64) for i in range(16)]
    assert np.mean(np.array(nibbles(sketch[0])) == np.array(nibbles(sketch[1]))) == pytest.approx(0.6 + 0.4 / 16, abs=0.13)


# 12 whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label string, component int, whitened double")


def plain_whitening(rows, most=16):
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return {i: (sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s, strict=True)), (n * np.array(v) - s) / n @ axes / np.sqrt(values)) for i, v in x.items()}, values / np.trace(centred.T @ centred / n), n


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(20, 20)) * np.linspace(1, 3, 20)
    held = [(i, [float(c) for c in rng.normal(size=20) @ mix]) for i in range(300)]
    rows = [*held, *((1000 + i, held[7][1]) for i in range(200)), (2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, []), (2005, [1.0, 2.0]), (2006, [3e38] * 20), (None, held[8][1])]
    got = op12_whitening.whiten(vectors(spark, rows)).collect()
    want, explained, n = plain_whitening([r for r in rows if r[0] is not None and r[0] < 2000])
    assert len(got) == 16 * 501 and {r["n"] for r in got} == {n} == {300}
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = [np.sign(by[0, k + 1]["whitened"] * want[0][1][k]) for k in range(16)]
    for (i, k), r in by.items():
        deviation, white = want[8 if i is None else i]
        assert r["deviation"] == deviation
        assert r["whitened"] == pytest.approx(signs[k - 1] * white[k - 1], abs=1e-9)
        assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = op12_whitening.whiten(vectors(spark, rows))
        assert out.columns == columns and out.collect() == []
    flat = op12_whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])).collect()
    assert {r["component"] for r in flat} == {1} and all(r["explained"] == pytest.approx(1) for r in flat)  # two of three dimensions add nothing


def test_deviations_of_any_size():
    x = np.array([[2**30, -(2**30)], [0, 2**29]])
    n, sums = 10**7, np.array([5, 7]) * 10**12
    assert op12_whitening.deviations(x, n, sums) == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


# 13 alignment


def plain_alignment(texts):
    """Per text the A and B tokens, groups and links, token by token."""
    letters = op13_alignment.byte_letters()
    a = Tokenizer.from_file(public_tokenizers.path(Q.ALIGNED[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(Q.ALIGNED[1]))
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        x = a.encode(whole.decode(), add_special_tokens=False)
        ids, own = b.encode(text or ""), x.ids
        of_a = [bytes(letters[c] for c in t) for t in x.tokens]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            out.append((0, 0, [], []))
            continue
        owner = lambda tokens: [k for k, t in enumerate(tokens) for _ in t]
        at = list(zip(owner(of_a), owner(of_b), strict=True))
        links, found = list(dict.fromkeys(at)), []
        for k, (i, j) in enumerate(at):
            if k == 0 or (at[k - 1][0] != i and at[k - 1][1] != j):
                found.append(([], []))
            for held, one in zip(found[-1], (i, j), strict=True):
                if one not in held:
                    held.append(one)
        groups = [f"{','.join(str(own[i]) for i in p)}|{','.join(str(ids[j]) for j in q)}" for p, q in found]
        out.append((len(of_a), len(of_b), groups, [(own[i], ids[j]) for i, j in links]))
    return out


def expected(rows):
    found = plain_alignment([t for _, t in rows])
    counts = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, y), c in counts.items():
        best[y] = max(best.get(y, 0), c)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((i, a, b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest(g)) for (i, _), (a, b, g, links) in zip(rows, found, strict=True)), key=repr)


def test_alignment_against_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    letters = "aeiou tn  st\n\t.,;'sàéß中😀\xa0　<>|▁0123\r\x1c\x85(){}"
    rows = [*ODD, *((100 + i, "".join(rng.choices(letters[: rng.choice([12, 22, len(letters)])], k=rng.randint(1, 400)))) for i in range(150))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in Q.op13_tokenizer_alignment(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(rows)


def test_alignment_of_small_blocks(spark):
    rows = [(i, f"the cat {'sat ' * (i % 4)}on mat number {i}, isn't it?") for i in range(60)]
    docs, pairs = op13_alignment.align_documents(frame(spark, rows), *map(public_tokenizers.path, Q.ALIGNED), block_chars=200)
    found = plain_alignment([t for _, t in rows])
    assert {r["doc_id"]: r["groups"] for r in docs.collect()} == {i: ";".join(g) for (i, _), (_, _, g, _) in zip(rows, found, strict=True)}
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == Counter(link for *_, links in found for link in links)
    none, no_pairs = op13_alignment.align_documents(frame(spark, []), *map(public_tokenizers.path, Q.ALIGNED))
    assert none.collect() == [] and no_pairs.collect() == []


def test_segments_that_run_over_batches_keep_one_number(spark):
    rows = [(i, "the cat sat on the mat " + "the " * i) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs, pairs = op13_alignment.align_documents(frame(spark, rows), *map(public_tokenizers.path, Q.ALIGNED), block_chars=30)
        found = plain_alignment([t for _, t in rows])
        assert {r["doc_id"]: r["groups"] for r in docs.collect()} == {i: ";".join(g) for (i, _), (_, _, g, _) in zip(rows, found, strict=True)}
        assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == Counter(link for *_, links in found for link in links)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_splitting_is_verified_against_the_vocabularies():
    split = op13_alignment.Splitter([b"a", b" ", b"x y", b"\n "], [b"b"]).split
    assert split(" a b x y") == [" a", " b", " x y"]  # an entry holds x and a space
    partial = op13_alignment.Splitter([b"\xa0 "], [b"b"]).split
    assert partial(" a b") == [" a b"]  # what begins inside a character may follow any


def test_answers_travel_as_one_message_a_block():
    """Documents come out as from single rows, and a message is far smaller than they are."""
    n = 3000
    rows = {"block": np.arange(n) % 2, "no": np.arange(n)[::-1] // 2, "n_a": np.ones(n), "n_best": np.zeros(n), "count_sum": np.arange(n), "groups": [f"{i}|{i + 1}" for i in range(n)]}
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(list(v)).cast(k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))
    sent = list(op13_alignment.bundled(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert [b.num_rows for b in sent] == [2]
    assert sent[0].nbytes < batch.nbytes / 2
    messages = pa.Table.from_batches(list(op13_alignment.bundled(iter([batch.slice(0, 1000), batch.slice(1000)]), most=1)))  # several a block
    assert messages.num_rows == 4
    places = zstandard.ZstdCompressor(1).compress(np.array([0, 1, n // 2 - 1, 0], np.int32).tobytes())
    left = pa.table({"doc_id": pa.array([7, 8], pa.int64()), "places": pa.array([places, b""], pa.binary())})
    own = messages.filter(pa.array(messages.column("block").to_numpy() == 0))
    got = op13_alignment.compose(left, own).to_pylist()
    held = {no: (c, g) for b, no, c, g in zip(rows["block"], rows["no"], rows["count_sum"], rows["groups"], strict=True) if b == 0}
    asked = [held[i] for i in (0, 1, n // 2 - 1, 0)]
    assert got[0]["groups"] == ";".join(g for _, g in asked)
    assert got[0]["count_sum"] == sum(c for c, _ in asked)
    assert (got[0]["n_a"], got[0]["n_b"], got[0]["n_groups"], got[0]["n_links"]) == (4, 4, 4, 4)
    assert got[1]["groups"] == "" and got[1]["n_a"] == 0
