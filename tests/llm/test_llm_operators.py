"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from spanloom.llm import op1_language, op2_repetition, op3_decontaminate, op4_toxicity, op5_url_filter, op6_html, op7_brown, op8_mix, op9_jaccard, op10_tokens
from spanloom.llm import queries as Q
from spanloom.llm.common import is_remainder

KIND = "doc_id long, text string, lang string, source string, score string, _key string, class string, n int"
LONG = " ".join(f"w{i % 5000}" for i in range(30_000))


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], KIND)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (None, "two words", None, "b"), (7, LONG, "de", "b"), (8, "é ß 中 \x0b\x1c x", "fr", "")]


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# 1 language


def test_language_by_dictionaries(spark, odd, none):
    rng = random.Random(1)
    stock = {"aa": "ba da ga lo mi".split(), "bb": "stre kuh wupf nerz".split()}
    make = lambda k: " ".join("".join(rng.choice(stock[k]) for _ in range(3)) for _ in range(30))
    labelled = frame(spark, [(i, make("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", "s") for i in range(80)])
    model = op1_language.fit_dictionaries(labelled)
    assert sorted(model) == ["aa", "bb"]
    fresh = frame(spark, [(i, make("aa" if i % 2 else "bb"), None, None) for i in range(40)])
    got = op1_language.identify(fresh, model).collect()
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") and 0 <= r["score"] <= 1 for r in got)
    other = op1_language.identify(odd, model).collect()
    assert len(other) == len(ODD)
    assert {r["lang_pred"] for r in other if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert op1_language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in op1_language.identify(fresh, {}).collect()} == {"und"}


def test_language_by_brute_force(spark):
    """Whole texts, block by block, against zstandard itself; the dictionaries hold passages from all over the texts."""
    import zstandard

    rng = random.Random(15)
    stock = {"aa": "ba da ga lo mi".split(), "bb": "stre kuh wupf nerz".split(), "cc": "ba kuh lo nerz".split()}
    make = lambda k, n: " ".join("".join(rng.choice(stock[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, make("abc"[i % 3] * 2, 2000 if i == 0 else 40), "abc"[i % 3] * 2, None) for i in range(90)]
    model = op1_language.fit_dictionaries(frame(spark, rows), passages=10_000, passage_chars=100)
    for k, held in model.items():
        want = {op1_language.normalise(t[i : i + 100]) for _, t, lang, _ in rows if lang == k for i in range(0, len(t), 100)}
        assert len(held) == sum(map(len, want)) + len(want) - 1 and all(x in held for x in want)
    texts = [make(k, n) for k in stock for n in (1, 3, 30, 3000)] + ["ba", "kuh", "lo", "x" * 20_000]

    def sizes(text):
        clean, out = op1_language.normalise(text), []
        for _, held in sorted(model.items()):
            log = max(17, len(held).bit_length())
            how = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log - 2, chain_log=log - 2, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0)
            total = 0
            for i in range(0, len(clean), 8000):
                own = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=how)
                total += len(zstandard.ZstdCompressor(compression_params=how, dict_data=own).compress(clean[i : i + 8000]))
            out.append(total)
        return out

    got = {r["doc_id"]: r for r in op1_language.identify(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        n = sizes(t)
        best = min(range(3), key=lambda j: n[j])
        assert got[i]["lang_pred"] == sorted(model)[best]
        assert got[i]["score"] == pytest.approx(1 / sum(2.0 ** -min(700, 2 * (x - n[best])) for x in n))
        assert got[i]["rejected"] == (min(x for j, x in enumerate(n) if j != best) - n[best] < 0.01 * n[best])


def test_ties_of_languages_go_to_the_smaller_code():
    assert op1_language.Classifier({"zz": b"same words", "aa": b"same words"}).classify("same words", 0.01)[0::2] == ("aa", True)


def test_language_held_out_accuracy(spark):
    got = Q.op1_language_id(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    out = got[got.held_out]
    assert set(out.index) == {i for i in truth.index if zlib.crc32(str(i).encode()) % 3 == 1}
    assert (out.lang_pred == truth.loc[out.index].lang).mean() > 0.95


# 2 repetition


def slow_repetition(text, least=8):
    w = words(text)
    n = len(w)

    def spread(size):
        seen = Counter(tuple(w[i : i + size]) for i in range(n - size + 1))
        return {i + d for i in range(n - size + 1) if seen[tuple(w[i : i + size])] > 1 for d in range(size)}

    longest = max((k for k in range(least, n) if max(Counter(tuple(w[i : i + k]) for i in range(n - k + 1)).values()) > 1), default=0)
    return n, len(spread(3)), len(spread(least)), longest


def test_repetition_by_brute_force():
    rng = random.Random(2)
    texts = [None, "", "a", "\n", "x " * 40, "a b c d e f g h i " * 2] + [" ".join(rng.choice("ab" if i % 2 else "abcdef") for _ in range(rng.randint(1, 50))) for i in range(120)]
    m = op2_repetition.measure(texts, 8)
    got = list(zip(m["n_words"], m["n_repeat_words"], m["covered_words"], m["longest_repeat"], strict=True))
    assert [tuple(map(int, x)) for x in got] == [slow_repetition(t) for t in texts]
    assert [sum(n for _, n in s) for s in m["spans"]] == m["covered_words"].tolist()


def test_repetition_rows(odd, none):
    got = op2_repetition.rate(odd).collect()
    assert len(got) == len(ODD) and op2_repetition.rate(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[7]["n_words"] == 30_000 and by[7]["n_repeat_words"] == 30_000 and by[7]["base_failed"]
    assert by[8]["n_words"] == 5  # \x1c is part of a word, \x0b is not
    kept = op2_repetition.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 0


def test_lines_and_symbols():
    m = op2_repetition.measure(["a #b\na #b\n\n \n \nc|<"], 8)
    assert (m["n_dup_lines"][0], m["n_symbols"][0], m["word_chars"][0]) == (1, 4, 9)


# 3 decontamination


def slow_windows(docs, items, size=10):
    out = []
    for key, text in docs:
        w = op3_decontaminate.words_of(text)
        hit, found = set(), set()
        for item, it in items:
            iw = op3_decontaminate.words_of(it)
            if item is None or not iw:
                continue
            k = min(size, len(iw))
            wanted = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    found.add(item)
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "bits"), [(3, 26), (1, 8)])
def test_windows_by_brute_force(spark, width, bits):
    rng = random.Random(3)
    pick = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items = [(str(i), pick(rng.randint(1, 14))) for i in range(12)] + [("n", None), ("e", ""), ("m", "-- !"), ("0", "a b"), (None, "a")]
    docs = [(i, (pick(rng.randint(0, 30)) + " " + rng.choice(items)[1] if i % 2 and rng.random() < 0.8 else pick(25)) if i % 7 else None) for i in range(60) if True]
    docs = [(i, t) for i, t in docs]
    df = frame(spark, [(i, t, None, None) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = op3_decontaminate.decontaminate(df, bench, width=width, bits=bits)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items") == slow_windows(docs, items)
    assert all(sum(s["words"] for s in r["spans"]) == r["n_hit"] for r in got.collect())
    clean = {r["doc_id"] for r in op3_decontaminate.keep(df, bench, width=width, bits=bits).collect()}
    assert clean == {r[0] for r in slow_windows(docs, items) if not r[2]}


def test_windows_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], "item_id string, text string")
    got = op3_decontaminate.decontaminate(odd, empty).collect()
    assert len(got) == len(ODD) and all(r["n_hit"] == 0 and r["items"] == [] for r in got)
    assert op3_decontaminate.decontaminate(none, empty).count() == 0
    assert op3_decontaminate.items_digest([]) == hashlib.sha256(b"").hexdigest()


# 4 toxicity


def test_toxicity_learns_planted_words(spark, odd, none):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    make = lambda bad: " ".join(rng.sample(plain, 40) + (rng.sample(["scum", "fool", "trash"], 2) if bad else []))
    docs = frame(spark, [(i, make(i % 4 == 0), None, None) for i in range(600)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(401, None), (None, 1)], "doc_id long, toxic int")
    model = op4_toxicity.fit(docs, labels, bits=20)
    assert 0 < len(model[0]) < 2000
    got = op4_toxicity.score(docs.where("doc_id >= 400"), model, bits=20).collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) >= 0.97 * len(got)
    other = op4_toxicity.score(odd, model, bits=20).collect()
    assert len(other) == len(ODD) and all(0 <= r["score"] <= 1 for r in other)
    assert len({r["score"] for r in other if r["doc_id"] in (1, 2, 3)}) == 1
    assert op4_toxicity.score(none, model, bits=20).count() == 0
    untrained = op4_toxicity.fit(docs, labels.where("toxic > 5"), bits=20)
    assert {r["score"] for r in op4_toxicity.score(odd, untrained, bits=20).collect()} == {0.5}
    kept = op4_toxicity.keep(docs, model, bits=20)
    assert kept.columns == docs.columns


def test_a_feature_counts_once():
    hasher = op4_toxicity.Hasher(16)
    scorer = op4_toxicity.Scorer(op4_toxicity.train([(op4_toxicity.slots_of(hasher, t), y) for t, y in [("bad x", 1), ("good y", 0)] * 30], bits=16), 16)
    one, many = scorer.score(["bad", "bad z bad q bad"])
    assert one == pytest.approx(many, abs=0.2)


def slow_ftrl(examples, alpha=4.0, beta=1.0, l1=4.0, l2=1.0, passes=7):
    """FTRL-proximal as published, one coordinate after the other."""
    z, n = {}, {}

    def weight(i):
        if i != "bias" and abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = (z.get(i, 0.0) > 0) - (z.get(i, 0.0) < 0)
        return -(z.get(i, 0.0) - sign * (0.0 if i == "bias" else l1)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(passes):
        for slots, label in examples:
            w = {i: weight(i) for i in [*slots, "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i, own in w.items():
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * own
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_weights_and_scores_by_brute_force():
    rng = random.Random(44)
    hasher = op4_toxicity.Hasher(16)
    texts = [" ".join(rng.choice("scum fool fine good day sun tree road".split()) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    rows = [(op4_toxicity.slots_of(hasher, t), int("scum" in t)) for t in texts]
    want = slow_ftrl([(s.tolist(), y) for s, y in rows])
    slots, weights = op4_toxicity.train(rows, bits=16)
    got = dict(zip(["bias" if s == 1 << 16 else s for s in slots.tolist()], weights.tolist(), strict=True))
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-3 * max(1, abs(want[i])) for i in want)
    logit = [sum(want.get(i, 0.0) for i in [*s.tolist(), "bias"]) for s, _ in rows]
    assert op4_toxicity.Scorer((slots, weights), 16).score(texts) == pytest.approx([1 / (1 + math.exp(-x)) for x in logit], abs=1e-3)


def test_training_holds_only_touched_slots():
    import tracemalloc

    rows = [(op4_toxicity.slots_of(op4_toxicity.Hasher(24), f"some words {i}"), i % 2) for i in range(40)]
    tracemalloc.start()
    op4_toxicity.train(rows, bits=24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


# 5 URLs


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(p), v, h + p) for v, h, p in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_by_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.example.org/es/1", "http://example.org/en/148.html", "https://x.com/fr/?q#", "https://x.com/de", "https://x.com/de/", "http://notexample.org/es/", "http://a.b.c.com/frx", "http://u@x.com:80/fr/", "http://x.com?/fr/", "ftp://q.org#x/", "http://ÉX.org/", "http://a..org/x", "http://" + "a." * 3000 + "example.org/en/1" + "y" * 50_000, "http://example.org.org.de.com/de/"]
    urls += urls[5:8]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    got = rows_of(op5_url_filter.judge(pages, Q.URL_RULES), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *slow_verdict(u)) for i, u in enumerate(urls)), key=repr)
    assert op5_url_filter.judge(pages.limit(0), Q.URL_RULES).count() == 0


# 6 HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>T&eacute;st <b>o</b>ne&nbsp;two<br>three", "Tést one two three"),
        ("<article><h1>A</h1><p>b<p>c</article><footer>&copy; x</footer>", "A b c"),
        ("<body><nav><a href=x>Menu</a></nav><div class='post-1'><p>Hello there world</p><div class=comments>no</div></div><aside>side</aside></body>", "Hello there world"),
        ("<script>var t='</p>';</script><article>x<style>p{}</style> y</article>", "x y"),
        ("<article>one &am", "one &am"),
        ("<article>one</article><foo", "one"),
        ("<article><p title='a>b'>q &lt;p&gt;</p></article>", "q <p>"),
        ("<!-- <article>no</article> --><article>yes</article>", "yes"),
        ("<article><ul><li>a<li>b</ul>c</article>", "a b c"),
        ("<script>var x='<!--';</script><article><p>Hello world article text</p></article>", "Hello world article text"),
        ('<article><p>(<a class="ext" href="#">foo</a>) un<b class="k">bold</b></p></article>', "(foo) unbold"),
        ("<article>ab<script>1</script>cd</article>", "abcd"),
        ('<article><p id="notice-1">one two</p><p class="share">three</p><p class="ad">no</p></article>', "one two three"),
        ('<article>one <span class="ad">no <i>no</i> <span>no</span></span>two</article>', "one two"),
        ("<article title='<!-- x'>one<!-->two<!---->three</article>", "onetwothree"),
        ("<article><p>one</p><div class=comments><p>no</p></div><section role=search>no</section></article>", "one"),
        ("<div class='widget'><p>all the text there is</p></div><p>x</p>", "all the text there is"),
    ],
)
def test_main_text(page, want):
    assert op6_html.Page(page).extract([]) == want


def test_host_consensus_overrides_a_page(spark):
    body = "<div class='story-{0}'><p>{1}</p></div><div class=misc><p>{2}</p></div>"
    pages = [(i, "http://h.org/x", body.format(i, "main text that is long enough " * 3, "short")) for i in range(5)]
    pages += [(9, "http://h.org/y", body.format(9, "tiny main", "a long aside text that wins by its length " * 5)), (10, None, None), (11, "bad", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", is_remainder("page_id", 2, 1)).withColumn("paths", is_remainder("page_id", 2, 1))
    got = {r["page_id"]: r["text"] for r in op6_html.extract(df).collect()}
    assert got[10] == got[11] == ""
    assert got[0].startswith("main text") and "tiny main" in got[9]
    assert op6_html.extract(df.limit(0)).count() == 0


def test_every_template_of_a_host_has_its_consensus(spark):
    body = "<nav>" + "home and more " * 8 + "</nav><div class='t{0}'><p>{1}</p></div><div class='misc{0}'><p>{2}</p></div>"
    letters = "abcdefgh"
    pages = [(10 * t + i, "http://h.org/x", body.format(letters[t], f"main text {i} that is long enough " * 3, "short")) for t in range(8) for i in range(9 - t)]
    pages += [(900 + t, "http://h.org/y", body.format(letters[t], "tiny main", "a long aside text that wins by its length " * 5)) for t in range(7)]
    pages.append((901, "http://h.org/y", pages[-1][2]))
    got = op6_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    assert {r["text"] for r in got if r["page_id"] >= 900} == {"tiny main"}


def test_a_named_text_element_is_a_fixture_by_its_host(spark):
    page = "<article><p>text number {0} of the page</p><p class='notice'>{1}</p></article>"
    pages = [(i, "http://same.org/x", page.format(i, "accept this")) for i in range(4)]
    pages += [(10 + i, "http://other.org/x", page.format(i, f"words of their own {i}")) for i in range(4)]
    pages.append((20, "http://single.org/x", page.format(1, "accept this")))
    got = {r["page_id"]: r["text"] for r in op6_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text number {i} of the page" for i in range(4)} | {10 + i: f"text number {i} of the page words of their own {i}" for i in range(4)} | {20: "text number 1 of the page accept this"}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="main"><p>text one of article</p></div><div class="comments">' + "<p>a comment of a reader</p>" * 200 + "</div>", "text one of article"),
        ('<div class="post"><p>' + "A sentence. " * 8 + '</p></div><div class="related">' + "<p>another story to read, with a long title of its own</p>" * 40 + "</div>", ("A sentence. " * 8).strip()),
        ('<article><p>We ate at <span class="menu">the grill</span> tonight and it was <i class="comment">fine</i>.</p></article>', "We ate at the grill tonight and it was fine."),
        ('<article><p>one</p><p class="comment">two</p></article>', "one two"),
        ('<article><div class="content-header"><h1>The Title</h1></div><p>Body text here</p></article>', "The Title Body text here"),
        ('<div class="story"><div class="post-header"><h1>The Title</h1></div><p>Body text here</p></div>', "The Title Body text here"),
        ("<header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>Body</p></main>", "Head Body"),
        ("<article><title-bar><p>kept</p></title-bar><p>after</p></article>", "kept after"),
        ("<article><style-guide>kept</style-guide><p>after</p></article>", "kept after"),
        ("<article><p>short text</p></article><div class=qqq>" + "<p>said by someone</p>" * 60 + "</div>", "short text"),
        ("<main><article><p>the text of the page</p></article><section class=zzz>" + "<p>other</p>" * 9 + "</section></main>", "the text of the page"),
        ("<article><p>the text</p></article><article class=comment><p>" + "an answer " * 50 + "</p></article>", "the text"),
        ("<div class=text><p>the text</p></div><ol class=commentlist><li class=comment>" + "an answer " * 50 + "</ol>", "the text"),
        ("<div class=story><p>the text</p><p><span class=comments>3 comments</span></p></div>", "the text"),
        ("<div class=comments><p>only a comment</p></div>", ""),
        ("<div class=share><p>all the text there is</p></div>", "all the text there is"),
    ],
)
def test_comments_never_and_article_words_always(page, want):
    assert op6_html.Page(page).extract([]) == want


def test_inline_text_is_a_fixture_by_its_host(spark):
    page = "<article><p>text number {0} of <b class='menu'>{1}</b> the page</p></article>"
    pages = [(i, "http://same.org/x", page.format(i, "go up")) for i in range(4)]
    pages += [(10 + i, "http://other.org/x", page.format(i, f"dish {i} on")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in op6_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text number {i} of the page" for i in range(4)} | {10 + i: f"text number {i} of dish {i} on the page" for i in range(4)}


def test_generated_pages_by_brute_force(spark):
    """Pages made from known parts: what is expected is put together beside them, without reading HTML."""
    rng = random.Random(6)
    word = lambda: rng.choice(["sun", "é&amp;", "a&lt;b", "road", "x&nbsp;y", "tree"])
    plain = lambda t: " ".join(t.replace("&amp;", "&").replace("&lt;", "<").replace("&nbsp;", " ").split())
    junk = ["<nav><a href=x>menu</a></nav>", "<aside>side</aside>", "<div class='ad'>buy</div>", "<form>name <input></form>", "<script>if (a<b) '<!--'</script>", "<!-- <p>no</p> -->", "<style>p{}</style>", "<div id=comments><p>nice one</p></div>", "<footer>&copy; us</footer>"]
    pages, want = [], {}
    for i in range(60):
        body, parts = "", []
        for _ in range(rng.randint(1, 4) if i else 40_000):
            text = " ".join(word() for _ in range(rng.randint(4, 12)))
            body += rng.choice(["<p>{}</p>", "<p class=k>{}", "<h2>{}</h2>", "<p><b class=x>{}</b></p>", "<ul><li>{}</li></ul>"]).format(text) + (rng.choice(junk) if i else "")
            parts.append(plain(text))
        around = [rng.choice(junk), rng.choice(junk)]
        pages.append((i, None if i % 5 == 0 else f"http://h{i % 3}.org/{i}", f"<html><body>{around[0]}<div class='story-{i}'>{body}</div>{around[1]}</body></html>"))
        want[i] = " ".join(parts)
    pages += [(100, "http://h1.org/n", None), (101, "http://h1.org/e", ""), (1, *pages[1][1:])]
    got = op6_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    assert all(r["text"] == want.get(r["page_id"], "") for r in got)


def test_ties_of_votes_go_to_the_smaller_path(spark):
    page = "<nav>" + "home and more " * 8 + "</nav><div class={0}>{1}</div><div class={2}>{3}</div>"
    pages = [(1, "http://t.org", page.format("a", "long enough a text", "b", "x")), (2, "http://t.org", page.format("a", "x", "b", "long enough a text"))]
    got = {r["page_id"]: r["text"] for r in op6_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "long enough a text", 2: "x"}


# 7 language model


def fold(text):
    return [*words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), b""]  # the end is the empty word


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def language_rows():
    rng = random.Random(7)
    return [(i, " ".join(rng.choice(["the", "a", "Of"]) if rng.random() < 0.6 else f"w{rng.randrange(90)}" for _ in range(rng.randrange(0, 30))) if i % 9 else None, None, None) for i in range(150)] + ODD


SMALL = {"frequent": 10, "extended": 15, "endings": 16, "classes": 6}


def test_base_scores_by_brute_force(spark):
    rows = language_rows()
    got = op7_brown.score(frame(spark, rows), is_remainder("doc_id", 7, 2), **SMALL).collect()
    c = Counter(w for i, t, _, _ in rows if not held(i) for w in fold(t))
    total, distinct = sum(c.values()), len(c)
    want = sorted(((str(i), held(i), len(fold(t)), sum(c[w] > 0 for w in fold(t)), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in fold(t)), 4)) for i, t, _, _ in rows), key=repr)
    assert sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == want


def test_class_scores_by_brute_force(spark):
    """The model's formula word by word, from counts made here; only the classes are taken from the operator."""
    import xxhash

    rows, ends, classes = language_rows(), SMALL["endings"], SMALL["classes"]
    docs = frame(spark, rows).select("doc_id", is_remainder("doc_id", 7, 2).alias("held_out"), "text")
    table = op7_brown.read_pieces(docs, ends, 1 << 20)
    kind = "piece long, range int, counts binary, hash binary, ending binary, sums array<long>, kinds array<long>"
    dealt = table.select("piece", "hash", "ending", "trained").mapInArrow(op7_brown.deal(5), "piece long, range int, hash binary, ending binary, trained binary")
    counted = dealt.groupBy("range").applyInArrow(op7_brown.count_range(ends, 25), kind).cache()
    model = op7_brown.fit(table, counted, **SMALL)
    c = Counter(w for i, t, _, _ in rows if not held(i) for w in fold(t))
    signed = lambda w: (h := xxhash.xxh3_64_intdigest(w)) - (1 << 64 if h >> 63 else 0)
    top = sorted((w for w in c if w), key=lambda w: (-c[w], signed(w)))[:25]
    ending = lambda w: ("ending", op7_brown.ending_of(w, ends))
    unit = lambda w: w if not w or w in top else ending(w)
    number = {b"": 0} | {w: 1 + i for i, w in enumerate(top[:10])} | {("ending", e): 11 + e for e in range(ends)} | {w: 27 + i for i, w in enumerate(top[10:])}
    own = {u: int(model.own[i]) for u, i in number.items()}
    tokens, kinds = Counter(), Counter(unit(w) for w in c)
    for w, n in c.items():
        tokens[unit(w)] += n
    pair = Counter((own[unit(a)], own[unit(b)]) for i, t, _, _ in rows if not held(i) for a, b in zip([b"", *fold(t)], fold(t), strict=False))
    into, out = Counter(), Counter()
    for (a, b), n in pair.items():
        out[a] += n
        into[b] += n
    members, total = Counter(own.values()), sum(pair.values())

    def chance(a, b):
        x, y = own[unit(a)], own[unit(b)]
        step = (pair[x, y] + 10 * (into[y] + 1) / (total + classes)) / (out[x] + 10)
        emit = (tokens[unit(b)] + 0.5) / (sum(tokens[u] for u in own if own[u] == y) + 0.5 * members[y])
        return step * emit * ((c[b] + 1) / (tokens[unit(b)] + kinds[unit(b)] + 1) if unit(b) != b else 1)

    want = sorted((str(i), round(sum(math.log10(chance(a, b)) for a, b in zip([b"", *fold(t)], fold(t), strict=False)), 3)) for i, t, _, _ in rows)
    got = op7_brown.score(frame(spark, rows), is_remainder("doc_id", 7, 2), **SMALL).collect()
    assert [k for k, _ in sorted((str(r["doc_id"]), r["score"]) for r in got)] == [k for k, _ in want]
    assert [s for _, s in sorted((str(r["doc_id"]), r["score"]) for r in got)] == pytest.approx([s for _, s in want], abs=2e-3)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got)


def test_scores_do_not_depend_on_batches_or_partitions(spark):
    rows = language_rows()
    scores = lambda df, **how: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in op7_brown.score(df, is_remainder("doc_id", 7, 2), **SMALL, **how).collect())
    one = scores(frame(spark, rows).coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert scores(frame(spark, rows[::-1]).repartition(5), piece_bytes=300, range_bytes=100) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_rows_in_one_piece(spark):
    docs = spark.range(70_000).selectExpr("id as doc_id", "concat('w', id % 70, ' x', id % 9) as text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = op7_brown.score(docs, is_remainder("doc_id", 7, 2), **SMALL)
        assert got.where("n_known <> 3 or n_tokens <> 3").count() == 0 and got.select("base_score").distinct().count() < 2_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_language_model_without_rows(spark, none):
    assert op7_brown.score(none, is_remainder("doc_id", 7, 2), **SMALL).count() == 0
    only = next(i for i in range(100) if held(i))
    r = op7_brown.score(frame(spark, [(only, "a b", None, None)]), is_remainder("doc_id", 7, 2), **SMALL).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0) and r["score"] < 0


def test_words_of_a_context_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(7)
    units = op7_brown.Units(np.arange(8, dtype=np.uint64), 5, 3)  # the end, five words, three endings, three further words
    own = np.r_[0, rng.integers(1, 4, units.count - 1)]
    pair = rng.integers(0, 9, (4, 4)).astype(float)
    unit, kinds = rng.integers(0, 9, units.count).astype(float), np.array([3.0, 0, 2])
    m = op7_brown.Model(units, own, pair, unit, kinds)
    share = np.ones(units.count)
    share[6:9] = unit[6:9] + kinds + 1  # words of an ending: known ones c + 1 each, unseen ones 1
    per_class = np.zeros((units.count, 4))
    per_class[np.arange(units.count), own] = 10**m.emission * share
    assert np.allclose((10**m.transition @ per_class.T).sum(1), 1)


def test_exchange_finds_planted_classes():
    import numpy as np

    own = np.array([0, *([1] * 6), *([2] * 6)])
    counts = np.where((own[:, None] > 0) & (own > 0) & (own[:, None] != own), 50, 1)
    a, b = np.nonzero(counts)
    bigrams = op7_brown.Bigrams(a, b, counts[a, b], 13)
    got = op7_brown.exchange(bigrams, 3)
    assert len(set(got[1:7])) == 1 and len(set(got[7:])) == 1 and got[1] != got[7]
    pair = np.bincount(got[a] * 3 + got[b], counts[a, b], 9).reshape(3, 3)
    after = np.bincount(got[b[a == 1]], counts[1][b[a == 1]], 3), np.bincount(got[b[a == 7]], counts[7][b[a == 7]], 3)
    about = np.array([np.r_[x, x] for x in after])
    assert op7_brown.assign(about, pair).tolist() == [got[1], got[7]]


# 8 mixing


def test_mix_meets_targets(spark, none):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 40) if i % 11 else None, None, None if i % 17 == 0 else "src%d" % min(i % 9, 3)) for i in range(900)] + ODD
    got = op8_mix.mix(frame(spark, rows), range_rows=50).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    total = sum(s[1] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for s in by.values():
        assert s[1] == s[3] and s[0] == math.floor(s[2]) and s[2] <= 3 * s[1] + 1e-9
    again = op8_mix.mix(frame(spark, rows[::-1]).repartition(7), range_rows=50).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert op8_mix.mix(none).count() == 0


# 9 near-duplicates


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("pivots", "tokens", "centres", "frequent"), [(0, 2_000_000, (2, 8), 0), (6, 60, (1,), 200_000), (0, 200, (), 30), (40, 30, (1, 2), 200_000)])
def test_components_by_brute_force(spark, pivots, tokens, centres, frequent):
    rng = random.Random(9)
    rows, key = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))]
        for _ in range(rng.randrange(1, 9)):
            copy = base[:]
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            rows.append((key, " ".join(copy)))
            key += 1
    rows += [(key, None), (key + 1, ""), (key + 2, "One"), (key + 3, "one"), (key + 3, "one"), (key + 4, "a a a a a a"), (key + 5, "a a a a a a a a")]
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    got = op9_jaccard.link(docs, pivots=pivots, block_tokens=tokens, part_tokens=tokens, centres=centres, frequent=frequent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == slow_components(rows)


def test_a_pair_meets_in_one_region_only(spark, monkeypatch):
    """Near copies about each other's pivots: no document is copied into a region greater than its own."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{rng.randrange(9000)}" if rng.random() < 0.03 else w for w in base)) for i in range(60)]
    written = {}

    def kept(df, label, write=op9_jaccard.materialize):
        out = write(df, label)
        if label == "jaccard-regions":
            written[label] = out.select("class", "region").collect()
        elif label == "jaccard-placed":
            written[label] = {r["class"]: r["own"] for r in out.collect()}
        return out

    monkeypatch.setattr(op9_jaccard, "materialize", kept)
    got = op9_jaccard.link(frame(spark, [(i, t, None, None) for i, t in rows]))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == slow_components(rows)
    own = written["jaccard-placed"]
    assert len(set(own.values())) > 2
    assert all(r["region"] <= own[r["class"]] for r in written["jaccard-regions"])


def test_one_of_each_component_stays(spark, odd, none):
    kept = op9_jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "8", "None"]
    assert op9_jaccard.keep_one(none).count() == 0


# 10 tokens


def test_counts_equal_the_library(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(10)
    pool = ["a", "é", "é", " ", "  ", "\n", "'s", "<|endoftext|>", "12", "…", "中", "İ", "́", " x", "'ll", "#", " ing", "llama", "'"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for _ in range(200)] + ["a" * 1000, " " * 900, "ab " * 500, "x\0y z", LONG[:3000], "中文字符" * 300, "1" * 700, "qWxZ" * 400]
    for name in (Q.TOKENIZER, "byte_bpe_50k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        own = op10_tokens.encoder(public_tokenizers.path(name))
        want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
        for chunk, overlap in ((150, 20), (60, 8), (8_192, 256)):
            assert op10_tokens.count_texts(texts, own, chunk, overlap) == want
    path = public_tokenizers.path(Q.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in op10_tokens.count_tokens(odd, path).collect()}
    assert got[1]["n_tokens"] == got[1]["n_bytes"] == 0 and got[7]["over_limit"]
    assert got[7]["n_tokens"] == len(library.encode(LONG, add_special_tokens=False))
    assert op10_tokens.count_tokens(none, path).count() == 0


def test_counts_equal_sentencepiece():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["a" * 900, "中文字符" * 200, None, ""]
    assert op10_tokens.count_texts(texts, op10_tokens.encoder(path), 150, 20) == [len(library.encode(t)) if t else 0 for t in texts]


def test_long_texts_without_spaces_take_linear_time():
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(Q.TOKENIZER)
    library, own, rng = Tokenizer.from_file(path), op10_tokens.encoder(path), random.Random(12)
    for text in ("".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000)), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200_000)), "\n".join("w%d" % rng.randrange(9999) for _ in range(60_000))):
        began = time.perf_counter()
        want = len(library.encode(text, add_special_tokens=False))
        whole = time.perf_counter() - began
        began = time.perf_counter()
        assert op10_tokens.count_texts([text], own, 8_192, 256) == [want]
        assert time.perf_counter() - began < 3 * whole + 2


def test_components_leave_no_broadcasts_and_end_without_a_round_to_spare(spark, monkeypatch):
    from spanloom.llm import components as C

    rounds = []
    held = C.materialize

    def noted(df, label):
        rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return held(df, label)

    monkeypatch.setattr(C, "materialize", noted)
    stars = spark.createDataFrame([(5, 1), (7, 1), (9, 2), (2, 9)], "a long, b long")
    assert {tuple(r) for r in C.components(stars).collect()} == {(5, 1), (7, 1), (9, 2)}
    assert len(rounds) == 1  # stars are seen to be ones
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (60, 55)], "a long, b long")
    assert {tuple(r) for r in C.components(path).collect()} == {(i, 0) for i in range(1, 41)} | {(60, 50), (55, 50)}
    assert not any("Broadcast" in plan for plan in rounds)
    assert C.components(stars.limit(0)).count() == 0
