import duckdb
import pytest
from pyspark.sql import functions as F

from caretide.llm import decontaminate, dom, html_extract, language_id, license_scan, quality_rules
from tests.llm import brute, data

CLASH = ("words", "pos", "t", "label", "kept", "n_words", "hash", "window", "score", "item_id", "k", "template", "host")


def by_id(df, key="doc_id"):
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r.asDict() for r in rows}


@pytest.fixture(scope="module")
def docs(spark):
    return data.clashing(data.frame(spark), *CLASH).cache()


@pytest.fixture(scope="module")
def sample():
    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()


def test_license_phrases(spark, docs, sample):
    got = by_id(license_scan.license_labels(docs))
    for i, text, *_ in data.documents():
        want = brute.phrases(text)
        assert {k: got[i][k] for k in want} == want
    assert {r["labels"] for r in got.values() if r["n_base"]} == {"apache-2,cc-by-nc,mit"}
    assert license_scan.license_labels(docs.limit(0)).collect() == []
    assert by_id(license_scan.license_labels(docs.union(docs))) == got
    sampled = by_id(license_scan.license_labels(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    for i, text in sample:
        want = brute.phrases(text)
        assert {k: sampled[i][k] for k in want} == want


def test_license_phrases_repeated_or_side_by_side(spark):
    rows = [(0, "x apache license version 3 y")] * 2 + [(1, "all rights reserved all rights reserved"), (2, "all rights reserved")]
    got = by_id(license_scan.license_labels(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[i]["n_base"], got[i]["labels"]) for i in range(3)] == [(0, ""), (0, "all-rights-reserved"), (0, "all-rights-reserved")]


def test_license_templates(spark):
    mit = license_scan.TEMPLATES[0][1]
    words = mit.split()
    rows = [(0, mit), (1, " ".join(words[:20] + ["indeed"] + words[20:])), (2, " ".join(words[:10])), (3, "GNU General Public License, version 3")]
    rows += [(4, "licensed under the GNU General Public License, version 2")]
    got = by_id(license_scan.license_labels(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["labels"] for i in range(5)] == ["mit", "mit", "", "", "gpl-2"]
    assert got[0]["score"] == 1.0 and 0.8 <= got[1]["score"] < 1 and got[2]["n_base"] == 0


def test_quality_counts(spark, docs, sample):
    got = by_id(quality_rules.judge(docs, keep=["doc_id"]))
    for i, text, *_ in data.documents():
        want = brute.counts(text)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["kept"] and want["base_failed"])
    sampled = by_id(quality_rules.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), keep=["doc_id"]))
    for i, text in sample:
        want = brute.counts(text)
        assert {k: sampled[i][k] for k in want} == want
    kept = quality_rules.filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.judge(docs.limit(0)).collect() == []
    assert quality_rules.filter_quality(docs.union(docs)).count() == 2 * kept.count()


def test_quality_thresholds_follow_the_group(spark):
    def text(i, marks):
        words = data.prose(i, 80).split()
        return " ".join(w + ("%%" if k < marks else "") for k, w in enumerate(words))

    rows = [(i, text(i, 1), "en", "plain", 0) for i in range(80)] + [(100 + i, text(i, 25 + i % 9), "en", "tables", 0) for i in range(80)]
    rows += [(300, text(300, 80), "en", "plain", 0), (301, text(301, 30), "en", "tables", 0)]
    kept = {r["doc_id"] for r in quality_rules.judge(data.frame(spark, rows)).filter("kept").collect()}
    assert set(range(80)) <= kept and 300 not in kept and {100, 150, 301} <= kept


def test_decontamination(spark, docs):
    base = data.prose(1, 300).split()
    items = [(1, " ".join(base[20:50])), (2, " ".join(base[40:52])), (3, "word"), (4, None), (5, "..."), (10, " ".join(base[20:50])), (11, "x x x")]
    frame = data.clashing(spark.createDataFrame(items, "item_id long, text string"), "words", "window", "doc_id", "k", "hash")
    got = by_id(decontaminate.contamination(docs, frame))
    want = brute.contamination([(i, t) for i, t, *_ in data.documents()], items)
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert {i: tuple(r[f] for f in fields) for i, r in got.items()} == want
    assert sum(r["contaminated"] for r in got.values()) > 10
    none = decontaminate.contamination(docs, frame.limit(0)).agg(F.max("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(want))
    assert decontaminate.contamination(docs.limit(0), frame).collect() == []
    assert decontaminate.contamination(docs.union(docs), frame.union(frame)).exceptAll(decontaminate.contamination(docs, frame)).isEmpty()


def test_decontamination_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "one two three"), (1, "zero one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {None: (3, 1), 1: (3, 1)}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = language_id.fit(docs.filter("not held"))
    got = language_id.identify(docs.filter("held"), model, keep=("doc_id", "lang"))
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 and n > 100
    assert got.filter("not score between 0 and 1").isEmpty()


def test_language_mixtures_and_odd_rows(spark, docs):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(train)
    texts = {r["lang"]: r["text"] for r in train.filter("n_chars between 2000 and 6000").orderBy("doc_id").collect()}
    rows = [(0, texts["en"] + " " + texts["fr"]), (1, texts["de"]), (2, None), (3, " 12 !! "), (4, "")]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model))
    assert {x.split(":")[0] for x in got[0]["languages"].split(",")} == {"en", "fr"} and got[0]["score"] < 0.9
    assert got[1]["lang_pred"] == "de" and [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[2]["score"] == 0.0
    odd = language_id.identify(docs, model)
    assert odd.count() == docs.count()
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li>Home<li>About</ul></nav><div class="ad-box">Buy</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>
text<br>next &lt;tag&gt;<p>Second&nbsp;one<script>var a = "</p>";</script><aside>See also</aside><ul><li>one<li>two</ul>
<form><input>Mail</form><section class="comments"><article><p>Reader says a lot of things here</article></section></article>
<div id="sidebar">Side</div><footer>&copy;</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst bold text next <tag>\n\nSecond one\n\none\n\ntwo"


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b</p></div></p>c", "a\n\nb\n\nc"),
        ("<![if IE]><p>x<![endif]><!-- no --><!foo><?pi?>y", "xy"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<div>" * 300 + "<p>s<script>var a;</script><nav>Home<div>x</div></nav><p>t</p>" + "</div>" * 300 + "<footer>f</footer><p>u</p>", "s\n\nt\n\nu"),
        ("<p>out</p>" + "<div>" * 300 + "<article><p>one</p><div class='ad'>Buy</div>two</article>" + "</div>" * 300, "one\n\ntwo"),
        ("<ul><li>" * 200 + "deep<li>er" + "</ul>" * 200, "deep\n\ner"),
        ("<article><table class='notice-period'><tr><td>a</table><p>b</p><div class='notice'>n</div></article>", "a\n\nb"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<p>a <b>b</p><p>c</b> d", "a b\n\nc d"),
    ],
)
def test_main_text_of_odd_pages(html, text):
    got = html_extract.main_text(html)
    assert got == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<main><div><p>a long story of many words</p></div></main><article>card</article>", "a long story of many words"),
        ("<main><div><p>a long story of many words</p><article>card</article></div></main>", "a long story of many words\n\ncard"),
        ("<main><article><p>first part</p></article><p>x</p><article><p>2nd</p></article></main>", "first part\n\n2nd"),
        ("<div class='layout with-sidebar'><article><p>story</p></article><div class='sidebar'>side</div></div>", "story"),
        ("<article class='post has-comments'><p>story</p><div class='comments'>a reader says far more than that</div></article>", "story"),
        ("<article class='post has-comments'><p>one</p></article><article class='post has-comments'><p>two</p></article>", "one\n\ntwo"),
        ("<article><div class='entry-header'><h1>head</h1></div><p>story</p></article>", "head\n\nstory"),
        ("<div class='page no-sidebar'><p>all of the story</p></div><p>end</p>", "all of the story\n\nend"),
        ("<article><p>story</p></article><div class='comments'><article>a reader says far more</article></div>", "story"),
        ("<div><p>a long story of many words</p></div><div class='related-posts'><article>card</article></div>", "a long story of many words"),
        ("<div class='widget'><article class='notice'><p>story</p></article></div><footer>foot</footer>", "story"),
    ],
)
def test_whole_main_part(html, text):
    assert html_extract.main_text(html) == text


def test_simple_tree_matching():
    a = dom.skeleton(dom.parse("<div><p>1</p><ul><li>2</ul><p>3</p></div>"))
    b = dom.skeleton(dom.parse("<div><ul><li>2<li>3</ul><p>4</p></div>"))
    assert dom.tree_match(a, b)[0] == 5  # html, div, ul, li, p
    assert dom.tree_match(a, a)[0] == 6


def test_constant_nodes_become_template(spark):
    def page(i, host):
        return f"<body><article><p class='lead'>Read this every day on {host}</p><p>{data.prose(i, 20)}</p></article></body>"

    rows = [(i, f"http://{h}/{i}", page(i, h)) for h in ("a.example", "b.example") for i in range(8)]
    rows += [(20, "http://c.example/1", page(1, "c.example")), (21, None, None), (22, "http://a.example/copy", page(0, "a.example"))]
    rows += [(23 + i, "http://d.example/x", "<p>all the same</p>") for i in range(9)]
    pages = data.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "host", "template", "rank")
    got = {(r["page_id"], r["url"]): r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows[:16]:
        assert got[i, url]["text"] == data.prose(i, 20) and got[i, url]["n_chars"] == len(data.prose(i, 20))
    assert got[20, "http://c.example/1"]["text"].startswith("Read this")  # one page shows nothing constant
    assert got[21, None]["text"] == "" and got[23, "http://d.example/x"]["text"] == "all the same"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_template_of_numbered_elements_and_of_each_layout():
    numbered = [f"<article id='post-{i}' class='post p{i}'><p>Read this every day</p><p>{data.prose(i, 20)}</p></article>" for i in range(8)]
    plain = [f"<main><p>Other notice</p><p>{data.prose(50 + i, 20)}</p></main>" for i in range(8)]
    template = frozenset(html_extract.template_texts(numbered + plain))
    assert {t.split("\t")[1] for t in template} == {"Read this every day", "Other notice"}
    assert [html_extract.main_text(h, template) for h in (numbered[3], plain[3])] == [data.prose(3, 20), data.prose(53, 20)]


def test_rare_layout_of_a_large_host_is_learnt(spark):
    def page(i):
        if i % 50 == 0:  # six pages of three hundred
            return f"<main class='rare'><p>Seldom seen notice</p><div><p>{data.prose(i, 20)}</p></div></main>"
        tail = "<ul><li>x</ul><p>Only here, but always</p>" if i % 10 == 1 else ""
        return f"<article><p>{data.prose(i, 20)}</p>{tail}<section>Read this every day</section></article>"

    htmls = [page(i) for i in range(300)]
    rows = [(i, f"http://hot.example/{i}", h) for i, h in enumerate(htmls)] + [(1000 + i, "http://hot.example/copy", htmls[2]) for i in range(900)]
    rows += [(None, "http://hot.example/none", None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    template = frozenset(html_extract.template_texts(htmls))
    assert {t.split("\t")[1] for t in template} == {"Seldom seen notice", "Only here, but always", "x", "Read this every day"}
    want = sorted((str(i), html_extract.main_text(h or "", template)) for i, _, h in rows)
    got = html_extract.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == want
    assert got[0]["n_chars"] == len(got[0]["text"])
    assert ("0", data.prose(0, 20)) in want and ("1", data.prose(1, 20)) in want
