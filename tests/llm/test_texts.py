"""Classifiers on held-out rows, main text of pages, and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrag.llm import html_text, quality, toxicity
from sparkrag.llm.labelled import held_out

SF = "/root/testdata/sf0.1"


def frames(spark):
    return (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"),
            spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out(spark):
    import zlib
    rows = spark.range(40).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("select cast(null as long) i").select(held_out(F.col("i"))).first()[0] is False


def test_toxicity(spark):
    docs, labels = frames(spark)
    model = toxicity.fit(docs, labels)
    assert 0 < len(model[0]) < 5000  # sparse
    x = (toxicity.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")))
         .select("toxicity", "toxic").toPandas())
    said, true = x.toxicity >= toxicity.THRESHOLD, x.toxic == 1
    assert (said & true).sum() / true.sum() > 0.7
    assert (said & true).sum() / said.sum() > 0.9


def test_toxicity_edges(spark, edge, no_docs):
    labels = spark.createDataFrame([(0, None), (7, 1), (8, 0), (None, 1), (10, 0), (10, 0)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    got = toxicity.score(edge.withColumn("toxicity", F.lit("old")), model)
    assert got.columns == [*edge.columns, "toxicity"]
    rows = got.collect()
    assert len(rows) == edge.count() and all(0 <= r.toxicity <= 1 for r in rows)
    empty = {r.toxicity for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    blank = toxicity.fit(edge, labels.limit(0))
    assert {r.toxicity for r in toxicity.score(edge, blank).collect()} == {0.5}
    assert toxicity.score(no_docs, model).count() == 0


def test_features_stay_in_their_text():
    known = toxicity.WordHashes()
    one = toxicity._hashed(known, [[b"a", b"b"], [b"c"]])
    got = [(o.tolist(), len(p)) for o, p in toxicity.features(*one)]
    assert got == [([0, 0, 1], 3), ([0], 1), ([], 0)]


def test_quality(spark):
    docs, labels = frames(spark)
    model = quality.fit(docs, labels)
    x = (quality.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")))
         .select("quality_score", "quality").toPandas())
    assert abs(model.prior - (x.quality == 1).mean()) < 0.06
    said, true = x.quality_score >= quality.THRESHOLD, x.quality == 1
    assert (said == true).mean() > 0.97


def test_quality_never_reads_negatives(spark):
    docs, labels = frames(spark)
    a = quality.fit(docs, labels, sample=300)
    b = quality.fit(docs, labels.withColumn("toxic", F.lit(None).cast("int")), sample=300)
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_quality_where_all_are_labelled(spark):
    """With a label on every document there is still something to tell the positives from."""
    docs, labels = frames(spark)
    known = labels.where("quality is not null").select("doc_id")
    model = quality.fit(docs.join(known, "doc_id", "left_semi"), labels)
    x = (quality.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id")))
         .select("quality_score", "quality").toPandas())
    assert ((x.quality_score >= quality.THRESHOLD) == (x.quality == 1)).mean() > 0.9


def test_quality_edges(spark, edge, no_docs):
    labels = spark.createDataFrame([(7, 1), (9, 1), (10, 0), (3, None)],
                                   "doc_id long, quality int")
    model = quality.fit(edge, labels)
    rows = quality.score(edge.withColumn("quality_score", F.lit("old")), model).collect()
    assert len(rows) == edge.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in quality.score(
        edge, quality.fit(edge, labels.limit(0))).collect()}) == 1
    assert quality.score(no_docs, model).count() == 0


def test_negative_risk_is_not_negative():
    r = np.random.default_rng(0)
    p, u = r.normal(2, 1, (400, 2)), np.concatenate([r.normal(2, 1, (300, 2)),
                                                     r.normal(-2, 1, (100, 2))])
    model = quality.fit_samples(p, u)
    rest = np.logaddexp(0, model.margin(u)).mean() - model.prior * np.logaddexp(
        0, model.margin(p)).mean()
    assert rest > -0.02
    assert 0.65 < model.prior < 0.9
    assert model.score(r.normal(2, 1, (200, 2))).mean() > model.score(
        r.normal(-2, 1, (200, 2))).mean() + 0.5


PAGE = """<html><head><title>t</title></head><body class="home with-sidebar"><header><h1>Site</h1>
<a href=/>Home</a></header><div class="cookie-notice">We use cookies for the best of all the things
 that you would want</div><div class="wrapper has-sidebar"><main><h1>The  title</h1><p>This is the
long text of the article, and it has many of the words that are in it, see <a href=x>here</a>.
<p>Short one.<ul><li>First point</li><li>Second</li></ul><p>And so it is with the rest of the text
that is in here for you &amp; me, a &lt; b.</p><script>var x = "<p>no</p>";</script><form><label>Mail
</label><button>Send</button></form></main><aside><p>This is a text that is not in the article, and
it has many of the words.</p></aside><section id="comments"><article class="comment"><p>I think that
this is not the best of the articles that I have been to.</p></article></section></div>
<!-- <p>no</p> --><footer>All of the rights are in here for us</footer></body></html>"""
MAIN = ["The title", "This is the long text of the article, and it has many of the words that are "
        "in it, see here.", "Short one.", "First point", "Second", "And so it is with the rest of "
        "the text that is in here for you & me, a < b."]


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == MAIN


def test_main_text_without_article():
    page = ("<body><ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h2>Head</h2>"
            "<p>It was the best of the times and it was the worst of the times for all of us.</p>"
            "<p>Short.</p><p>And so it is that they were in the town with the rest of the men.</p>"
            "</div><div><a href=3>more</a> <a href=4>links</a></div>")
    assert html_text.main_text(page).split("\n")[::2] == ["Head", "Short."]
    assert "One" not in html_text.main_text(page) and "more" not in html_text.main_text(page)


RUN = "It was the best of the times and it was the worst of the times for all of us in the town."


@pytest.mark.parametrize("inside,want", [
    (f"<p>{RUN}</p><ul><li><a href=1>See the one</a></li><li>Plain</li></ul>",
     [RUN, "See the one", "Plain"]),
    (f"<p>{RUN}</p><ul><li><a href=1>A</a><li><a href=2>B</a><li><a href=3>C</a></ul><p>End</p>",
     [RUN, "End"]),
    (f"<p>{RUN}</p><p>A<b>B</b>C<br/>D &amp; E&nbsp;&eacute; <span class='ad'>x</span>y</p>tail",
     [RUN, "ABC D & E é y", "tail"]),
    (f"<p>{RUN}</p><p>a <span class=promo>b<p>c</p>", [RUN, "a", "c"]),
    (f"<p>{RUN}</p><div class=ad-slot>Buy it.</div><table><tr><td>1</td><td>2</td></tr></table>",
     [RUN, "1", "2"]),
    (f"<header><h1>T</h1></header><p>{RUN}</p><div class=comments><p>I like {RUN}</p></div>",
     ["T", RUN]),
    (f"<p>{RUN}<svg class='x'/> after</p><p>{RUN} 2</p><svg><path d='M0'/></svg><p>End</p>",
     [f"{RUN} after", f"{RUN} 2", "End"]),
    (f"<p>{RUN} <svg viewBox='0 0'><title/><style/><g><text>axis</text></g></svg>on</p><p>End</p>",
     [f"{RUN} on", "End"]),
    (f"<p>{RUN} <svg><title>icon</title><text>a</p><p>End</p>", [RUN, "End"]),
    (f"<p>{RUN} <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is it<math/>.</p><p>End</p>",
     [f"{RUN} E=m is it.", "End"]),
    (f"<p>{RUN}</p><object data=x><p>Instead.</p></object><canvas>Drawn <b>text</b></canvas><p>End",
     [RUN, "Instead.", "Drawn text", "End"]),
])
def test_inside_the_article(inside, want):
    page = f"<body><nav><a href=0>Home</a></nav><article>{inside}</article><footer>(c)</footer>"
    assert html_text.main_text(page).split("\n") == want


TEXTS = {
    "ru": "Вечером над рекой поднялся густой туман, и лодки одна за другой вернулись к старой пристани.",
    "zh": "傍晚时分河面上升起了浓雾，渔船一艘接一艘地回到了古老的码头，岸边的人们点亮了灯笼等待亲人归来。",
    "ja": "夕方になると川の上に濃い霧が立ちこめ、船は次々と古い桟橋へ戻り、岸辺の人々は灯りをともして待っていた。",
    "th": "ตอนเย็นมีหมอกหนาปกคลุมแม่น้ำและเรือทุกลำค่อยๆแล่นกลับมายังท่าเรือเก่าแก่ของหมู่บ้านริมฝั่ง",
    "ar": "في المساء ارتفع ضباب كثيف فوق النهر وعادت القوارب واحدا تلو الآخر إلى المرسى القديم في القرية.",
    "pl": "Wieczorem nad rzeką uniosła się gęsta mgła, więc łodzie kolejno wracały do starej przystani.",
    "tr": "Akşam nehrin üzerinde yoğun sis yükseldi, tekneler birer birer eski iskeleye geri döndüler.",
    "code": "for (int k = 0; k < rows.length; k++) { total += rows[k].price * rows[k].amount; }",
}


def div_page(*texts):
    return ("<body><div class=menu><a href=1>One</a></div><div><a href=2>Two</a></div><div>"
            + "".join(f"<div>{t.replace('<', '&lt;')}</div>" for t in texts)
            + "</div><div><a href=3>Three</a></div><div class=footer>© 2020</div>")


@pytest.mark.parametrize("kind", TEXTS)
def test_pages_without_known_stop_words(kind):
    text = TEXTS[kind]
    parts = [f"{text} 1", "1.", f"{text} 2", f"{text} 3"]
    assert html_text.main_text(div_page(*parts)).split("\n") == parts
    # One passage in a listed language changes nothing, wherever it stands.
    for parts in ([RUN, *parts], [*parts, RUN], [*parts[:2], RUN, *parts[2:]]):
        assert html_text.main_text(div_page(*parts)).split("\n") == parts


def test_long_blocks_beside_running_text():
    code = [f"{TEXTS['code']} // {i}" for i in range(3)]
    for parts in ([*code, *[RUN] * 6], [*[RUN] * 6, *code], [RUN, RUN, RUN, *code, RUN, RUN, RUN]):
        assert html_text.main_text(div_page(*parts)).split("\n") == parts


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></div>", "<!-- x", "<script>a", "<a href='",
                                  "text only", "<p>" * 3000, "<div>" * 3000 + "x", "&#0;&bad;"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split())
                 for x in re.split("</?(?:p|h1)>", inner)]
        assert r.main_text == "\n".join(x for x in parts if x)


def test_extract_edges(spark):
    rows = [(1, None, "u"), (None, "", "u"), (2, "<p>hi", None), (2, "<p>hi", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    assert sorted(r.main_text for r in html_text.extract(pages).collect()) == ["", "", "hi", "hi"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline(spark):
    """Every stage on what the one before kept, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < out.count() <= n
        if name == "line dedup":
            assert out.count() == n
            assert out.where("n_chars != length(text)").count() == 0
        docs, n = out, out.count()
    last = corpus_pipeline.run(spark, sf)
    assert last.count() == n
    assert {r.doc_id for r in last.select("doc_id").collect()} == {
        r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_edges(spark, edge, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (edge, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count(), name
