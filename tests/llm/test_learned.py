"""Operators that learn: held-out accuracy, planted cases, and the parts that are exact."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import html_text, secrets, toxicity
from folioflow.llm.common import table

SCHEMA = "doc_id long, text string, score double, predicted int, base int, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n", "plain words", "x" * 30000, "plain words"]
    return spark.createDataFrame([(k if k else None, t, 1.0, 2, 3, None) for k, t in enumerate(texts)] + [(5, "again", 0.0, 0, 0, None)], SCHEMA)


def test_field_decodes_by_viterbi():
    rng = np.random.default_rng(0)
    names = {f"f{k}": k for k in range(6)}
    field = html_text.Field(names, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
    for _ in range(20):
        found = [{f"f{k}" for k in rng.choice(6, 2, replace=False)} for _ in range(6)]
        scores = {}
        for code in range(64):
            y = [code >> k & 1 for k in range(6)]
            scores[tuple(y)] = sum(field.unary[names[f], y[k]] for k, fs in enumerate(found) for f in fs) + sum(field.pair[a, b] for a, b in zip(y, y[1:], strict=False))
        assert scores[tuple(field.decode(found))] == pytest.approx(max(scores.values()))


def right_share(field, pages):
    right = total = 0
    for page, labels in pages:
        blocks = html_text.blocks_of(page)
        assert len(blocks) == len(labels)
        right += sum(a == b for a, b in zip(field.decode(html_text.features(blocks)), labels, strict=True))
        total += len(labels)
    return right / total


def test_field_on_new_pages_of_its_layouts():
    assert right_share(html_text.trained_field(), html_text.labelled_pages(80, seed=1234)) > 0.97


@pytest.mark.parametrize("style", html_text.STYLES)
def test_field_on_styles_it_was_not_trained_on(style):
    """Each style of markup held out of training as a whole; where cells are only known from tables in texts, less is right."""
    others = tuple(x for x in html_text.STYLES if x != style)
    pages = [(html_text.blocks_of(p), y) for p, y in html_text.labelled_pages(200, styles=others)]
    field = html_text.train([(html_text.features(b), y) for b, y in pages])
    assert right_share(field, html_text.labelled_pages(60, seed=77, styles=(style,))) > (0.7 if style == "table" else 0.93)


PROSE = "Some words that make a proper sentence of a decent length, so that it counts. And then another one follows it."
#: Layouts written by hand, with names that training never has: page, text wanted.
BY_HAND = [
    (f'<div id="topbar"><a href=x>Home</a> <a href=y>News</a></div><div id="main"><h2>A title here</h2><p>{PROSE}</p><p>{PROSE}</p></div><div id="bottom">© 2024 Site</div>', ["A title here", PROSE, PROSE]),
    (f'<article><h1>One title of words</h1><p>{PROSE}</p><p>{PROSE}</p><div class="reader-comments"><h3>Comments</h3><p>{PROSE}</p><p>Nice one!</p></div></article>', ["One title of words", PROSE, PROSE]),
    (f'<div class="c1"><span><a href=a>One</a></span><span><a href=b>Two</a></span></div><div class="c2"><div class="c3">{PROSE}</div><div class="c3">{PROSE}</div></div><div class="c4"><a href=z>Impressum</a></div>', [PROSE, PROSE]),
    (f'<ul class="siteNavList"><li><a href=a>World</a><li><a href=b>Sport</a></ul><section id="storyWrapper"><h1>Rain again</h1><p>{PROSE}<p>{PROSE}</section><ul class="shareTools"><li><a href=f>Post this</a></ul>', ["Rain again", PROSE, PROSE]),
    (f'<header><div>Daily</div></header><main><h1>Rain again</h1><p>{PROSE}</p><div class="sponsored-box"><p>{PROSE}</p></div><p>{PROSE}</p></main><div id="userComments"><h3>2 replies</h3><p class="comment">{PROSE}</p></div><footer>© D</footer>', ["Rain again", PROSE, PROSE]),
    (f'<div class="cookiebar">{PROSE}</div><table><tr><td class="lft"><ul><li><a href=a>World news</a></li><li><a href=b>Sport</a></li></ul></td><td class="rgt"><h1>Old page</h1><p>{PROSE}</p></td></tr></table>', ["Old page", PROSE]),
]


@pytest.mark.parametrize("page, want", BY_HAND)
def test_field_on_pages_by_hand(page, want):
    assert html_text.main_blocks(f"<html><body>{page}</body></html>", html_text.trained_field()) == want


def test_deep_nesting_takes_linear_time():
    import time

    field, begin = html_text.trained_field(), time.time()
    deep = ["".join(f"<div class='a b{k}'>x" for k in range(100_000)), "<b>x" * 100_000, "<ul><li>y" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000]
    for page in deep:
        html_text.main_blocks(page, field)
    assert time.time() - begin < 30


def test_extraction_from_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        want = [" ".join(html_text.html_entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1|ul|li)[^>]*>", body)]
        assert got[r.page_id].text == "\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_broken_pages(spark):
    pages = [None, "", "no markup &amp; no tags", "<article><p>cut off &lt;here", "<p>a<script>var x='</p>';</script>b<!-- <p>c", "<article><p>one\n two<br>three<p>four</article", "<" * 50, "<a href='" + "x" * 5000]
    df = spark.createDataFrame([(k, "u", p, "x") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[0] == got[1] == "" and got[3] == "cut off <here" and got[5] == "one two three\nfour" and len(got) == len(pages)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_base_spans_by_the_patterns(spark, sf, odd):
    """Base spans again, character by character."""

    def brute(text):
        found, n = [], len(text)
        key = re.compile("password|passwd|secret|token|api_?key")
        at = 0
        while at < n:
            m = key.match(text.translate({c: c + 32 for c in range(65, 91)}), at)
            k = m.end() if m else -1
            if m:
                k += text[k : k + 1] in ('"', "'") and k < n
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "="):
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ('"', "'") and k < n
                    end = k
                    while end < n and re.match("[A-Za-z0-9+/_.=-]", text[end]):
                        end += 1
                    if end > k:
                        if end - k >= 6:
                            found.append((at, 0, end))
                        at = end
                        continue
            at += 1
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        return sorted(found)

    texts = ["token = abcdef", 'API_KEY: "x1y2z3" token=abc', "secret=password=abcdefg", "toKen ſecret=abcdef Key", "AKIA" + "A" * 16 + " AKIAAKIA", "f" * 24 + "g" + "0" * 23, "passwd= ='abc.def"]
    texts += [r.text for r in table(spark, sf, "documents").select("text").collect() if re.search("(?i)token|secret|passw|api", r.text)][:40]
    for t in texts:
        assert secrets.base_spans(t) == brute(t), t[:80]
    got = secrets.digest(secrets.find_secrets(odd)).collect()
    assert len(got) == 7 and all(r.spans == "" for r in got)
    assert secrets.find_secrets(odd.limit(0)).count() == 0 and secrets.redact_secrets(odd.limit(0)).count() == 0


def test_random_keys_are_found_and_words_are_not(spark, sf):
    rng = np.random.default_rng(2)
    alphabets = ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    keys = ["".join(rng.choice(list(a), n)) for a in alphabets for n in (24, 32, 40)]
    docs = table(spark, sf, "documents").select("doc_id", "text")
    planted = spark.createDataFrame([(10**6 + k, f"some words before {w} and after") for k, w in enumerate(keys)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(docs.unionByName(planted))).collect()}
    assert all(f"random:18:{18 + len(w)}" in found[10**6 + k] for k, w in enumerate(keys))
    assert not any("random" in s for d, s in found.items() if d < 10**6)
    clean = secrets.redact_secrets(docs.unionByName(planted)).where("doc_id >= 1000000").collect()
    assert all(r.text == "some words before [SECRET] and after" for r in clean)


def test_false_discovery_thresholds():
    assert secrets.thresholds([(0, 0, 1000)], 1e-3) == {}
    limit = secrets.thresholds([(0, 0, 1000), (0, 400, 5), (1, 100, 1)], 1e-3)
    assert limit == {0: 8.0}
    assert secrets.redact("abcdef", [(1, 3), (2, 4)], "#") == "a#ef"
    assert 0 <= secrets.p_value(40, 0, 15.0, 18, 0.0, [(0.3, 0.12, 0.02, 20.0, 400.0)] * 7) < 1e-6
    assert [secrets.length_class(n) for n in (20, 23, 24, 31, 32, 47, 48)] == [10, 10, 11, 11, 12, 12, 13] and secrets.length_class(10**6) > secrets.length_class(10**5)


def test_battery_by_brute_force():
    """Statistics, figures of ordinary text and the three p-values, by plain loops."""
    rng = np.random.default_rng(4)
    for name, alphabet in secrets.ENCODINGS:
        k = len(alphabet)
        word = "".join(rng.choice(list(alphabet), 33))
        encoding, chi, changes, product = secrets.battery(word)
        held = secrets.ORDERS[encoding]
        k = len(held)
        assert set(word) <= set(held) and not any(set(word) <= set(a) for _, a in secrets.ENCODINGS[:encoding]), name
        assert chi == pytest.approx(sum((word.count(c) - 33 / k) ** 2 / (33 / k) for c in held))
        at = [held.index(c) for c in word]
        assert changes == sum((2 * x >= k) != (2 * y >= k) for x, y in zip(at, at[1:], strict=False))
        assert product == pytest.approx(sum((x - (k - 1) / 2) * (y - (k - 1) / 2) for x, y in zip(at, at[1:], strict=False)) / 32)
    texts = ["The quick brown fox 12 jumps over 0x3f", "", "a", "été über façade deadbeef cafe babe", "a " + "0f" * 20 + " b"]
    total = np.zeros(65536, np.int64)
    for t in texts:
        secrets.count_pairs(t, total)
    pairs = [(x, y) for t in texts for x, y in zip(t.replace("0f" * 20, "").encode(), t.replace("0f" * 20, "").encode()[1:], strict=False)]
    assert total.sum() == len(pairs) and all(total[x * 256 + y] == pairs.count((x, y)) for x, y in pairs)
    for alphabet, (squares, cubes, change, mean, var) in zip(secrets.ORDERS, secrets.ordinary(total), strict=True):
        k = len(alphabet)
        at = [(alphabet.index(chr(x)), alphabet.index(chr(y)), 1.0) for x, y in pairs if chr(x) in alphabet and chr(y) in alphabet]
        at += [(i, i, 1 / k) for i in range(k)]
        all_ = sum(w for *_, w in at)
        share = [sum(w for x, _, w in at if x == i) / all_ for i in range(k)]
        assert squares == pytest.approx(sum(p * p for p in share)) and cubes == pytest.approx(sum(p**3 for p in share))
        assert change == pytest.approx((sum(w for x, y, w in at if (2 * x >= k) != (2 * y >= k)) + 0.5) / (all_ + 1))
        products = [((x - (k - 1) / 2) * (y - (k - 1) / 2), w) for x, y, w in at]
        assert mean == pytest.approx(sum(p * w for p, w in products) / all_)
        assert var == pytest.approx(sum((p - mean) ** 2 * w for p, w in products) / all_)


def test_p_values_against_drawn_text():
    """Windows of ordinary text seldom look random by any test; keys do, by the tests that can tell them apart."""
    rng = np.random.default_rng(5)
    words = "the quick brown fox jumps over lazy dogs while seven wizards mix potions under moonlight near old rivers".split()
    text = "".join(rng.choice([w.capitalize() if rng.random() < 0.2 else w for w in words], 20_000))
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    figures = secrets.ordinary(np.bincount(raw[:-1] * 256 + raw[1:], minlength=65536))
    for n in (24, 40, 80):
        seen = []
        for at in rng.integers(0, len(text) - n, 2000).tolist():
            encoding, *found = secrets.battery(text[at : at + n])
            if encoding == 5:
                seen.append(secrets.p_values(n, encoding, *found, figures))
        assert len(seen) > 500
        for test in range(3):  # normal approximations, and windows with a capital only: a tail of 1 % may be some times heavier
            assert sum(p[test] < 0.01 for p in seen) <= 0.06 * len(seen), (n, test)
        keys = ["".join(rng.choice(list(secrets.ENCODINGS[5][1]), n)) for _ in range(200)]
        least = [[min(1.0, p) for p in secrets.p_values(n, 5, *secrets.battery(w)[1:], figures)] for w in keys if secrets.battery(w)[0] == 5]
        assert all(np.median([p[test] for p in least]) < 0.05 for test in (1, 2)) and np.median([secrets.p_value(n, *secrets.battery(w), figures) for w in keys]) < 1e-3


def test_keys_around_base_spans_are_redacted_whole(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    keys = ["Zq7" + "0123456789abcdef3141592a" + "XkP9LmQ2TvB8", "kA9" + "9f3ac07e51b2d8640a7bce13" + "QzWx7Lp2Vt5"]
    planted = spark.createDataFrame([(10**6 + k, f"before {w} after") for k, w in enumerate(keys)], "doc_id long, text string")
    clean = secrets.redact_secrets(docs.unionByName(planted)).where("doc_id >= 1000000").collect()
    assert [r.text for r in clean] == ["before [SECRET] after"] * 2
    spans, found = secrets.spans_and_candidates("token=abcdefghijklmnopqrstuvwx")
    assert len(spans) == 1 and found == []


def test_viterbi_restores_disguises():
    text = "the idiot is pathetic and a loser the clown the trash was worthless scum " * 50
    raw = np.concatenate(([0, 0], toxicity._SYMBOL[np.frombuffer(text.encode(), np.uint8)], [0]))
    counts = np.bincount((raw[:-2] * 32 + raw[1:-1]) * 32 + raw[2:], minlength=32**3).reshape(32, 32, 32).astype(float)
    model = np.log((counts + 0.01) / (counts.sum(2, keepdims=True) + 0.32))
    for shown, meant in (("1d10t", "idiot"), ("l0ser", "loser"), ("tr@sh", "trash"), ("cloooown", "clown"), ("5cum", "scum"), ("loseeer", "loser"), ("idiot", "idiot")):
        assert toxicity.restore(shown, model) == meant

        def total(s, model=model):
            k = [0, 0, *map(toxicity.symbol, s), 0]
            return sum(model[a, b, c] for a, b, c in zip(k, k[1:], k[2:], strict=False))

        ways = [("", 0.0)]
        for place in toxicity.readings(shown):
            ways = [(w + x, c + k) for w, c in ways for x, k in place]
        assert max(total(w) - c for w, c in ways) == pytest.approx(max(total(w) - c for w, c in ways if w == meant))
    reader = toxicity.Reader(model, None)
    assert set(toxicity.features("idiot")) <= reader.read("you i d i o t !") and set(toxicity.features("loser")) <= reader.read("L0SER!!")


def test_toxicity_held_out(spark, odd):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    trained = toxicity.train(docs, labels)
    got = toxicity.score(docs, trained).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in test) / len(test) > 0.9
    assert sum(r.predicted for r in got if not r.toxic) <= 0.02 * len(got)
    # other columns do not change scores, and odd rows have one
    again = toxicity.score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), trained)
    assert {r.doc_id: r.score for r in again.collect()} == {r.doc_id: r.score for r in toxicity.score(docs, trained).collect()}
    scores = toxicity.score(odd, trained).collect()
    assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(docs.limit(0), trained).count() == 0
    none = labels.limit(0)
    assert all(r.score < 1e-9 for r in toxicity.score(odd, toxicity.train(docs, none)).collect())
    disguised = spark.createDataFrame([(k, re.sub("o", "0", t.replace("idiot", "1d10t"))) for k, t in enumerate(r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").where("lang = 'en' and text like '%idiot%'").collect())], "doc_id long, text string")
    assert sum(r.predicted for r in toxicity.score(disguised, trained).collect()) >= 0.8 * disguised.count()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    held = F.udf(toxicity.held_out, "boolean")("doc_id")
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert a[1] == b[1] and np.allclose(a[2], b[2]) and math.isfinite(a[2].sum())


def test_secret_counts_are_by_kind(spark):
    texts = ["AKIA" + "A" * 16, "f" * 24, "token=abcdef", "token=abcdef " + "0" * 24 + " password: abc.def AKIA" + "B" * 20, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    assert [(got[k].n_assign, got[k].n_access, got[k].n_hex) for k in range(5)] == [(0, 1, 0), (0, 0, 1), (1, 0, 0), (2, 1, 1), (0, 0, 0)]
    assert got[3].base_sha256 == hashlib.sha256(b"assign:0:12,hex:13:37,assign:38:55,access:56:80").hexdigest()
