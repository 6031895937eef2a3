"""Toxicity, html extraction and url filters: held-out accuracy, made-up pages, odd rows, brute force."""

import random

import duckdb
import numpy as np
import pytest

from stopwise.llm import extract, toxicity, urls

SF = "/root/testdata/sf0.01"


def test_spans_keep_words_apart_and_join_spaced_letters():
    chars = lambda t: ["".join(chr(96 + k) for k in toxicity.spans(t)[0][toxicity.spans(t)[1] == w] if k < 27) for w in range(len(toxicity.spans(t)[2]))]
    assert chars("Foo b.a-r 1 x") == ["foo", "bar", "i", "x"]
    assert chars("you i d i o t there") == ["you", "idiot", "there"]
    assert chars("a b foo") == ["a", "b", "foo"] and chars("") == [] and chars(" \n ... ") == []


def test_folded_weights_equal_the_kernel():
    words = ["idiot", "clown", "table"]
    letters, word, size = toxicity.spans(" ".join(words))
    naive = np.zeros((3, 3))
    feats = []
    for w in words:
        s, f = f"^{w}$", {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    if k - i + 1 <= toxicity.SPAN:
                        f[s[i] + s[j] + s[k]] = f.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i + 1)
        feats.append(f)
    for a in range(3):
        for b in range(3):
            naive[a, b] = sum(v * feats[b].get(u, 0) for u, v in feats[a].items())
    codes = np.unique(np.concatenate([c for _, c, _ in toxicity._features(letters, word)]))
    m = toxicity._matrix(words, codes).astype(float) * toxicity._norm(size)[:, None]
    assert m @ m.T == pytest.approx(naive, rel=1e-5)


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, usable=None if False else (toxicity.F.col("key") % 3 != 1))
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1").select("score", "toxic").collect()
    hit = sum(r.toxic == 1 and r.score >= 0.7 for r in rows)
    assert hit / sum(r.toxic for r in rows) >= 0.7 and hit / sum(r.score >= 0.7 for r in rows) >= 0.85
    base = "The and attion to thanedble the anea eriner thanea for this of with "
    for insult in ("idiot", "i.d.i.o.t", "i d i o t", "st*upid", "worthlesss"):
        assert model.score(base * 3 + f"{insult} {base} {insult} {base}{insult}.") > model.score(base * 6)
    assert all(0 <= model.score(t) <= 1 for t in (None, "", "\n", "x" * 200_000))
    odd = spark.createDataFrame([(1, None, 0.5), (None, "idiot", 0.1), (1, None, 0.5)], "doc_id long, text string, score double")
    assert toxicity.score(odd, model).count() == 3 and toxicity.score(odd.limit(0), model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 900 < kept.count() < 1000
    assert toxicity.fit([], []).score("idiot") < 0.1


def test_main_text_of_supplied_and_made_pages(spark):
    model, draw, wrong, total = extract.trained(), random.Random(77), 0, 0
    for _ in range(150):
        page, truth = extract.made_page(draw)
        found = extract.blocks(page)
        assert len(found) == len(truth)
        if found:
            said = extract.labels(model, [extract.vectors(found)])[0]
            wrong, total = wrong + int((said != np.array(truth)).sum()), total + len(truth)
    assert wrong / total < 0.02
    rows = [(1, "u", "<html><body><nav><a>home</a></nav><article><h1>T &amp;  x</h1><p>One<b>two</b>\n three.<p>Four &lt;five&gt;.</article><footer>&copy; us</footer></body></html>", "t"), (2, None, None, "t"), (2, "u", "", None), (3, "u", "<p", "")]
    got = {(r.page_id, r.text, r.n_chars) for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()}
    assert got >= {(1, "T & x Onetwo three. Four <five>.", 32), (2, "", 0)} and len(got) == 3
    assert extract.main_text(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_blocks_of_odd_markup():
    text = lambda page: [b[1] for b in extract.blocks(page)]
    assert text("<p>a<br>b<script>x<p>y</script>c</p>d<!-- e --><style>f</style>") == ["a bc", "d"]
    assert text("<ul><li>a<li>b</ul><p title='>'>c &#233;&nbsp; d") == ["a", "b", "c é d"]
    assert text("a < b") == ["a < b"] and text("") == [] and text(None) == []


def test_marks_behind_many_utility_classes():
    looks = "w-full md:w-1/2 px-4 mb-8 flex-col"
    plain = extract.blocks('<div class="cookie-banner" role="navigation">we use them</div>')
    assert {".cookie", ".banner", ".navigation"} <= set(extract.blocks(f'<div class="{looks} cookie-banner" role="navigation">we use them</div>')[0][0])
    assert {".cookie", ".banner", ".navigation"} <= set(plain[0][0])
    model, draw, wrong, total = extract.trained(), random.Random(78), 0, 0
    for _ in range(150):
        page, truth = extract.made_page(draw, dressed=1.0)
        if truth:
            wrong += int((extract.labels(model, [extract.vectors(extract.blocks(page))])[0] != np.array(truth)).sum())
            total += len(truth)
    assert wrong / total < 0.02


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    m = extract.Labeller(rng)
    x, mask = extract.padded([rng.random((k, extract.PATH_DIMS + extract.WORD_DIMS + extract.FIGURES)) for k in (3, 5)])
    y = (rng.random(mask.shape) > 0.5) * mask

    def loss():
        p = m.forward(x, mask)[0]
        return float(-(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    g = m.gradients(x, mask, y)
    for k in m.p:
        at = tuple(rng.integers(s) for s in m.p[k].shape)
        kept = m.p[k][at]
        m.p[k][at] = kept + 1e-5
        up = loss()
        m.p[k][at] = kept - 1e-5
        slope, m.p[k][at] = (up - loss()) / 2e-5, kept
        assert g[k][at] == pytest.approx(slope, abs=1e-6)


PAGES = [
    (1, "https://a.net/de/1", '<link rel="canonical" href="https://www.example.com/de/x">'), (2, "http://b.org/p#x", "<meta http-equiv=refresh content='0; url=https://a.example.com/en/bad'>"),
    (3, "http://b.org/p", None), (4, "https://c.org/", '<LINK href="/other" REL=canonical>'), (5, "https://c.org/other", ""), (6, "http://d.net/fr/1?q", ""), (7, None, None), (8, "no scheme", ""),
    (9, "HTTP://Ä.Example.COM/en/", ""), (10, "https://e.org", '<link rel=canonical href="http://b.org/p">'), (11, "://x.net?es", ""), (11, "://x.net?es", ""),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = urls.judge(pages, urls.RULES).collect()
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    key = lambda r: (r[0], str(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted(c.sql(urls.ORACLE).fetchall(), key=key)
    verdict = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdict[1] == (None, "allow") and verdict[2] == verdict[3] == verdict[10] == (None, "block") and verdict[6] == ("net/fr/", "block") and verdict[9] == ("example.com/en/", "block")
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0
    more = spark.createDataFrame([("https://c.org/other", "https://z.net/es/1")], "u string, v string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, urls.RULES, more).collect()}[4] == "block"
