"""HTML extraction, language ID and language-model scoring."""

import collections
import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovekit.llm import html_blocks, html_extract, kneserney, langid, scratch
from grovekit.llm.hashing import word_hashes

LONG = 300_000


@pytest.fixture(scope="module")
def net():
    return html_extract.train()


def test_blocks_of_ragged_html():
    page = '<html><head><title>T</title><script>var a = "</p><p>x";</script></head><body><p><b>One  &amp;\n two<br><p>Three<!-- c --> four</p>&lt;five&gt;<ul><li>a<li>b</ul>six<br><br>seven<a title="x > y">e</a>'
    assert [b.text for b in html_blocks.blocks(page)] == ["One & two", "Three four", "<five>", "a", "b", "six", "sevene"]
    assert html_blocks.blocks(None) == [] == html_blocks.blocks("") == html_blocks.blocks("<p> \n</p>")
    assert [b.text for b in html_blocks.blocks("a < b <p class='x")] == ["a < b <p class='x"]


def test_formulas_and_media_stay_in_their_sentence(net):
    page = "<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p><p>See <video><source src=x>the film</video> <svg><text>no</text></svg>here.</p></article>"
    assert [b.text for b in html_blocks.blocks(page)] == ["We know that x=1 holds.", "See the film here."]
    assert [b.text for b in html_blocks.blocks("<p>a <math><mi>x<p>b<svg><text>no<div>c")] == ["a x", "b", "c"]
    plain = "<body><div>Home | About</div><div><p>The river rose quickly after the storm and the town was flooded.</p><p>People moved to the hills, and nobody was hurt in the end.</p></div><div>Copyright 2020 Example Inc. All rights reserved.</div>"
    assert html_extract.extract([plain], net) == ["The river rose quickly after the storm and the town was flooded.\nPeople moved to the hills, and nobody was hurt in the end."]


@pytest.mark.parametrize(("part", "found"), [("<a ", 1), ("<div>x", 1), ('<a "', 1), ("<a '>", 0), ("<span></b>", 0), ("<!--", 0), ("<p>x<![CDATA[", 1), ("<table><tr><td>y", 1), ("<b><i>z</p></b>", 1), ("</p>", 0)])
def test_blocks_take_linear_time(part, found):
    took = []
    for n in (4000, 40_000):
        began = time.process_time()
        made = html_blocks.blocks(part * n)
        took.append(time.process_time() - began)
        assert bool(made) == bool(found)
    assert took[1] < 40 * max(took[0], 0.02)  # ten times the page; a quadratic reader takes a hundred times as long


def test_long_pages_are_labelled_as_a_whole(net, monkeypatch):
    rng = random.Random(4)
    pages = [html_blocks.blocks(html_extract.training_page(rng)) for _ in range(12)]
    monkeypatch.setattr(html_extract, "PIECE", 7)
    for page in pages:
        if page:
            assert np.allclose(net.long_scores(page), net.scores([html_extract.vectors(page)])[0], atol=1e-3)
    deep = "<div>" * 3000 + "<p>Words in the deep.</p>" + "</div>" * 3000
    assert len(html_blocks.blocks(deep)) == 1 and len(html_blocks.blocks(deep)[0].path) == html_blocks.OUTER + html_blocks.INNER


def test_labeller_gradients():
    net = html_extract.Labeller(3)
    rng = np.random.default_rng(0)
    pages = [rng.standard_normal((n, html_extract.SIZE)).astype(np.float32) * 0.3 for n in (5, 3)]
    labels = [rng.integers(0, 2, n).astype(np.float32) for n in (5, 3)]
    _, grads = net.step(pages, labels)
    for name in net.w:
        flat = net.w[name].reshape(-1)
        for i in (0, len(flat) // 2):
            old = flat[i]
            flat[i] = old + 1e-2
            up = net.step(pages, labels)[0]
            flat[i] = old - 1e-2
            down = net.step(pages, labels)[0]
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(float(grads[name].reshape(-1)[i]), abs=2e-3)


def test_unseen_pages(net):
    rng, wrong, total = random.Random(1234), 0, 0
    for _ in range(150):
        page = html_blocks.blocks(html_extract.training_page(rng))
        if page:
            got = net.scores([html_extract.vectors(page)])[0] > 0
            wrong += int((got != np.array([b.mark == "1" for b in page])).sum())
            total += len(page)
    assert wrong / total < 0.01


def test_extraction_of_the_tables(spark, net):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_extraction_edges(spark, net):
    long = "<article>" + "<p>Some words of text, and more.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None, "old"), (2, None, "", "old"), (3, "u", long, None), (3, "u", long, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    out = html_extract.main_text(df).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in out[:2]] == [("", 0), ("", 0)]
    assert out[2] == out[3] and out[2]["text"].count("\n") == 29_999
    assert html_extract.main_text(df.where("false")).count() == 0


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language(spark):
    rng = random.Random(1)
    words = {"en": "the of and that with ing tion".split(), "de": "der und nicht schen keit ung über".split(), "fr": "le des été pour eau ment où".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, 8), lang, None) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(500, None, "en", "x"), (501, "", None, "x"), (502, "123 ... !!", "de", "x"), (503, text("fr", 60_000), None, "x"), (504, "the and", None, "x"), (504, "the and", None, "x")]
    docs = _labelled(spark, rows)
    held = langid.fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held))
    assert model.languages == ["de", "en", "fr"]
    got = langid.predict(docs, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "fr", "en"]
    assert np.mean([by[i] == rows[i][2] for i in range(180)]) > 0.97
    assert {r["doc_id"] for r in langid.accept(docs, model).collect()} >= set(range(0, 180, 2))
    assert langid.accept(docs, model).columns == docs.columns
    none = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_other_languages_are_not_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    other = [
        "Москва является столицей России и крупнейшим городом страны, расположенным на реке",
        "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και η μεγαλύτερη πόλη της χώρας",
        "北京是中华人民共和国的首都,是全国的政治中心和文化中心",
        "xqzj wvkk zzpt qqrw jjxk vbnm qwrt zxcv plkj mnbv",
    ]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(other)], docs.schema)
    model = langid.train(docs.unionByName(more))
    assert langid.accept(docs, model).count() >= 0.99 * docs.where("rlike(text, '[a-zA-Z]')").count()
    assert langid.accept(more, model).count() == 0
    found, _ = scratch.settle(corpus_pipeline.language(spark, docs.unionByName(more), "unused"), "language")
    assert found.where("doc_id >= 1000000").count() == 0 and found.count() == langid.accept(docs, model).count()
    # named once, a language is a learned one
    named = spark.createDataFrame([(10**6 + i, other[0], "ru") for i in range(40)], docs.schema)
    assert langid.accept(named, langid.train(docs.unionByName(named))).count() == 40


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Ab, cd é12 xyz " * 40
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    cut = langid.ngram_counts(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_held_out_language_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold(F.col("doc_id"), 3) == 1
    got = langid.predict(docs.where(held), langid.train(docs.where(~held)))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_word_hashes_in_blocks():
    texts = [b"A bc\td", None, b"", b"  ", ("w" * 400_000 + " x y ").encode(), b"a BC D" * 50_000, "é é".encode()]
    got = list(word_hashes(texts))
    assert [len(h) for h in got] == [3, 0, 0, 0, 3, len((b"a BC D" * 50_000).split()), 2]
    assert got[0].tolist() == next(word_hashes([b"a Bc d"])).tolist()
    assert got[5][1] == got[0][1] and got[6][0] == got[6][1]


def _model(texts):
    tokens = [[*t.encode().lower().split(), None] for t in texts]
    bi = collections.Counter((u, w) for t in tokens for u, w in zip(["<s>", *t], t, strict=False))
    uni = collections.Counter(w for t in tokens for w in t)
    before = collections.Counter(w for _, w in bi)
    d = [0, *kneserney.discounts([sum(n == k for n in bi.values()) for k in (1, 2, 3, 4)])]
    e = [0, *kneserney.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])]
    seen = {**uni, "<s>": len(texts)}

    def q(w):
        spare = sum(e[min(b, 3)] for b in before.values()) / len(bi)
        return max(before[w] - e[min(before[w], 3)], 0) / len(bi) + spare / (len(uni) + 1)

    def p(u, w):
        if u not in seen:
            return q(w)
        follow = [n for (x, _), n in bi.items() if x == u]
        return max(bi[u, w] - d[min(bi[u, w], 3)], 0) / seen[u] + sum(d[min(n, 3)] for n in follow) / seen[u] * q(w)

    return uni, p


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(kneserney, "SLICE", 60)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "cc", "dd", "é", "f"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(90, None, "x"), (91, "new words a a", "x"), (92, "a " * LONG, "x"), (93, "b b", "x"), (93, "b b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = kneserney.train(docs.where("doc_id < 40"))
    uni, p = _model(texts)
    total = sum(uni.values())
    assert (model.tokens, model.vocabulary, model.docs) == (total, len(uni), 40)
    for r in kneserney.score(docs, model).collect():
        t = [*(next(x for x in rows if x[0] == r["doc_id"])[1] or "").encode().lower().split(), None]
        if len(t) > 1000:
            assert r["n_tokens"] == len(t) and math.isfinite(r["score"])
            continue
        assert r["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t, strict=False)))
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in uni for w in t), total)
    assert sum(p(b"a", w) for w in uni) + p(b"a", "?") == pytest.approx(1)
    empty = kneserney.train(docs.where("false"))
    assert {r["score"] for r in kneserney.score(docs.where("doc_id = 91"), empty).collect()} == {0.0}
    assert kneserney.score(docs.where("false"), model).count() == 0
