"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import hnsw, html, licenses, media, mixing, packing, quality, simhash, tokencount, tokenfiles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, copy string, row long, path string, fp long"
LONG = " ".join(f"word{i % 977} and {i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, " \t\n ", "en", "b", 4),
    (None, "No id here, but words.", "en", "b", 20),
    (5, LONG, "en", "b", len(LONG)),
    (6, "naïve “quotes” – 日本語 Ωmega 'S don't <|endoftext|> \U0001f600", "xx", "c", 40),
    (7, "Licensed under the Apache License, Version 2.0.", "en", "c", 47),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, "x", 9, "a/b", 1) for r in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids(df, col="doc_id"):
    return sorted((r[col] for r in df.select(col).collect()), key=lambda x: (x is not None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_token_files(docs, empty, tmp_path):
    folder = f"file://{tmp_path}/x"
    got = tokenfiles.read(tokenfiles.write(docs, folder), folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    folder = f"file://{tmp_path}/y"
    assert tokenfiles.read(tokenfiles.write(empty, folder), folder).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=512).toPandas()
    assert len(set(got.doc_id.dropna())) == 7 and (got.length <= 512).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.iloc[0] == 0 and (s.offset + s.length).iloc[:-1].tolist() == s.offset.iloc[1:].tolist() and s.length.sum() <= 512
    assert got.sequence_id.nunique() == -(-got.length.sum() // 512)
    assert packing.pack(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id) for r in got)) == [(x is not None, x) for x in ALL]
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert ids(kept) == [None, 1, 2, 5, 6, 7] and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (7, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.predictions(docs, labels)
    assert ids(got) == ALL and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.predictions(docs, labels.limit(0)).where("score <> 0.5 or predicted <> 1").count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.predictions(empty, labels).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs)
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["n_copies", "copy", "mix_key"]
    assert got.groupBy("doc_id", "n_copies", "text").agg(F.count("*").alias("n")).where("n % n_copies <> 0").count() == 0
    assert mixing.mix(docs, weights={"a": 1.0}).where("source is null or source <> 'a'").count() == 0
    assert mixing.mix(empty).count() == 0


def test_token_counts(docs, empty):
    got = {r.doc_id: r for r in tokencount.token_counts(docs).collect()}
    assert got[2].n_tokens == got[3].n_tokens == got[4].n_tokens == 0 and got[5].n_pretokens == 90_000
    assert tokencount.token_counts(empty).count() == 0


def test_licenses(docs, empty):
    got = licenses.scan(docs)
    assert ids(got, "row") == ALL and {r.license for r in got.where("row = 7").collect()} == {"Apache-2.0"}
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs.withColumn("path", F.lit(None).cast("string"))).count() == len(ROWS)


def test_media(docs, empty):
    back = media.decode_column(media.encode_column(docs)).collect()
    assert len(back) == len(ROWS)
    for r in back:
        assert any(media.payload(x[1])[0] == r.payload for x in ROWS if x[0] == r.doc_id) and len(r.rgb) == r.width * r.height * 3
    assert media.encode_column(empty).count() == 0


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, [1.0, 1.0]), (6, None), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit(1)).withColumn("key", F.lit("k"))
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.vec_id) for r in got if r.query_id == 0] == [(1, 1), (2, 2), (3, 50), (4, 3)]
    assert [r.rank for r in got if r.query_id == 50] == [1, 2, 3, 4]
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0
    rows = [(0, [1.0, 1e-60]), (1, [1e-60, 0.0]), (1, [1e-60, 0.0]), (1, [0.0, 1e-60]), (2, [1e200, 1e200]), (3, [1.0, 0.0, 0.0]), (4, [-1e-300, 0.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(odd, odd.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in got] == [(1, 1.0), (2, round(0.5**0.5, 9)), (4, -1.0)]
    assert hnsw.nearest(df, df.limit(0)).count() == 0


def test_html(spark):
    schema = "page_id long, url string, html string, text string, path string, host string"
    page = "<html><body><nav><a href=x>menu</a></nav><div class='post-1'><p>First &amp; long enough paragraph of words.<p>Second\n  paragraph.<br>More</div><footer>foot</footer></body></html>"
    rows = [(1, "http://a.example/x", page), (1, "http://a.example/x", page), (2, None, None), (3, "not a url", ""), (None, "http://a.example/y", "plain &lt;text&gt;"), (4, "http://a.example/z", "<div class='post-2'><p>Other words stand here.</p><!-- cut <p>x")]
    df = spark.createDataFrame([(*r, "t", "p", "h") for r in rows], schema)
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "First & long enough paragraph of words.\nSecond paragraph. More"
    assert text[2] == text[3] == "" and text[None] == "plain <text>" and text[4] == "Other words stand here."
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.limit(0)).count() == 0


def test_simhash_keeps_one_of_each_group_whatever_the_id(spark):
    rows = [(None, "one text with no id at all"), (None, "some other words without any id"), (8, "a first text under eight"), (8, "quite a different second one here"), (8, "a first text under eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similar in (None, 0.8):
        kept = simhash.keep_one(docs, similar=similar).collect()
        assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_html_of_odd_tags_loses_no_text():
    page = lambda x: html.Page(x).text(None)
    assert page("<p title=don't>Hello there it's me</p><p>Second") == "Hello there it's me\nSecond"
    assert page("<div><p data-x='a>b' title = \"c>d\">One &lt; two</p><p>3 < 4 <b>and</b> so on</div>") == "One < two\n3 < 4 and so on"
    assert page("<p>kept</p>&#" + "9" * 6000 + "; &#0000000000000065;<a href=") == "kept\n� A"
    assert page("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == "one\ntwo\nx\ny"


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<a>x", "<b><i>", "</p>", "<ul></x>", "<!--", "<li></ul>", "<p class='"])
def test_html_takes_time_in_proportion_to_the_page(piece):
    import time

    page = "<div>" * 2000 + piece * (200_000 // len(piece))
    began = time.perf_counter()
    found = html.Page(page)
    found.text(None)
    assert time.perf_counter() - began < 3  # quadratic forms take minutes


def test_columns_of_the_documents_stay_as_they_are(spark):
    """Whatever their names: values are compared, not names."""
    rows = [(k, f"{w} " * 30, "a", 9.5 - k, f"c{k}", k, "m", "s", k, "r", 1.5) for k, w in enumerate(("one two three", "four five six", "seven eight nine"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double, copy string, n_copies int, mix_key string, _source string, _kept long, mark string, none double")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    want = {tuple(r) for r in docs.collect()}
    for got in (quality.keep_good(docs, labels), simhash.keep_one(docs), mixing.mix(docs, weights={"a": 1.0}, total=2000, extra=False)):
        found = [tuple(r) for r in got.collect()]
        assert got.columns == docs.columns and found and set(found) <= want
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} == want
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "score", "_source", "_kept", "mark", "none", "n_copies", "copy", "mix_key"]


def test_rates_over_the_largest_are_drawn_as_in_the_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(0, "x", "en", "tiny", 1), (1, "y" * 900_000, "en", "big", 900_000), (2, "z" * 900_000, "en", "big", 900_000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, n_copies, count(*) from ({mixing.SQL}) group by all order by 1").fetchall()
    got = mixing.op5_mix_sources(spark, str(tmp_path)).groupBy("doc_id", "n_copies").count().orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and want[0][1] > 500


def test_class_words_of_layouts_lose_no_page():
    """Words like sidebar in the class of what surrounds the whole page; what is really named so goes."""
    page = lambda x: html.Page(x).text(None)
    story = "<h1>Title</h1><p>First paragraph, long enough to be one.</p><p>And a second paragraph.</p>"
    want = "Title\nFirst paragraph, long enough to be one.\nAnd a second paragraph."
    side = '<div class="sidebar"><p>Weather and such things.</p></div>'
    for name in ("has-sidebar", "layout with-sidebar", "no-sidebar", "ad-free", "col-social-studies", "hasSidebar", "search results", "site-header-wrap social"):
        for inner in (f"<main>{story}</main>", f"<article>{story}</article>", f"<div>{story}</div>"):
            assert page(f'<body><div class="{name}">{inner}{side}</div><footer>f</footer></body>') == want, (name, inner)
    assert page(f'<body><form id="aspnetForm" action="/x"><input name="v"><div>{story}</div>{side}</form></body>') == want
    assert page(f'<body><article class="post has-comments">{story}</article><div class="related"><article>Another story of today.</article></div></body>') == want
    many = "<p>I think so, too, and say it at length.</p>" * 30
    assert page(f'<body><article>{story}</article><div class="comments"><h3>Replies</h3>{many}</div><form>Your name</form></body>') == want
    assert page(f'<body><article>{story}<article class="comment">{many}</article></article></body>') == want
    assert page(f'<body><div class="cookie-notice"><p>{"We use cookies. " * 20}</p></div><div>{story}</div></body>') == want
    assert page('<body><div class="menu"><a href="/">Home</a></div></body>') == ""
    assert page('<body><div class="comments"><p>Only comments here.</p></div></body>') == "Only comments here."


def test_licence_files_of_equal_score_name_their_own_license(spark):
    """Of several in a folder the best counts, equal up to rounding by path; license and file are of the same one."""
    rows = [(1, "a/LICENSE", "MIT", 0.9999999999999998), (2, "a/COPYING", "Apache-2.0", 1.0), (3, "a/b/x.py", None, 0.0), (4, "c/NOTICE", "MIT", 0.8), (5, "c/COPYING", "GPL-3.0", 0.7), (6, "c/y", None, 0.0)]
    found = spark.createDataFrame([(*r, 0) for r in rows], "row long, path string, license string, score double, line int")
    got = {r.row: (r.license, r.from_path) for r in licenses.inherit(found).collect()}
    assert got[3] == ("Apache-2.0", "a/COPYING") and got[6] == ("MIT", "c/NOTICE")
