"""Registered sources, channels and SQL functions, and pages that can't be read."""

import pytest
from pyspark.sql import functions as F

from rentflow import extend
from rentflow.operators import pages
from rentflow.plans import page_queries

HTML = '<body><ul class="a"><li><a href="/x/1">One two</a></li><li><a href="http://o.test">Far</a></li></ul><p>said</p></body>'


def rows(df):
    return sorted((tuple(tuple(sorted(x.items())) if isinstance(x, dict) else x for x in r) for r in df.collect()), key=repr)


def test_table_function_gives_the_operators_rows(spark, sf_dir):
    want = rows(page_queries.QUERIES["page_links"](spark, sf_dir).select("page_id", "ordinal", "fields", "error"))
    assert rows(page_queries.QUERIES["page_links_sql"](spark, sf_dir).select("page_id", "ordinal", "fields", "error")) == want and len(want) > 100


def test_functions_in_sql_text(spark):
    extend.register_functions(spark)
    some = spark.createDataFrame([(1, HTML, '{"a":{"b":[1,2]},"c":null}'), (2, None, "no")], "id int, html string, j string")
    some.createOrReplaceTempView("some_pages")
    got = {r.id: r for r in spark.sql("SELECT id, page_fingerprint(html, 'body') AS f, page_reduced(html) AS r, json_layout(j) AS j FROM some_pages").collect()}
    want = {r.id: r.fingerprint for r in pages.layout(some, "id", "html").collect()}
    assert {i: r.f for i, r in got.items()} == want
    assert {i: r.r for i, r in got.items()} == {r.id: r.reduced for r in pages.reduce_html(some, "id", "html").collect()}
    assert (got[1].j, got[2].j) == ("a.b[]:int|c:NoneType", "unparseable")
    bad = spark.sql("SELECT x.* FROM some_pages, LATERAL page_items(html, 'li', 'no rules') AS x").collect()
    assert all(r.fields == {} and r.error.startswith("JSONDecodeError") for r in bad) and len(bad) == 2


def test_one_parse_gives_all_and_bad_pages_are_rows(spark, monkeypatch):
    rules = {"href": {"sel": "a", "attr": "href"}}
    broken = "<ul><li>" + '<a href="x">' * 5000 + "</ul>"  # deeper than the signature of every level can go
    some = spark.createDataFrame([(1, HTML), (2, broken), (3, None), (4, "")], "id int, html string")
    got = {r.id: r for r in pages.read_pages(some, "id", "html", item="li", rules=rules, layout_item="body", text_limit=3).collect()}
    assert got[1].items == [{"href": "/x/1"}, {"href": "http://o.test"}] and got[1].reduced.urls_dropped == 2 and got[1].error is None
    assert got[3][1:] == got[4][1:] and got[3].layout.signature == "dom:no-match"
    one = {r.id: r for r in pages.layout(some, "id", "html").collect()}
    assert {i: (r.layout.fingerprint, r.layout.signature) for i, r in got.items()} == {i: (r.fingerprint, r.signature) for i, r in one.items()}

    wrong = {"href": {"sel": "a", "regex": "("}}  # fails on pages with such an element only
    mixed = pages.read_pages(some, "id", "html", item="li", rules=wrong, layout_item="body", text_limit=3).collect()
    assert {r.id: r.error is not None for r in mixed} == {1: True, 2: True, 3: False, 4: False}
    told = pages.extract(some, "id", "html", "li", wrong).collect()
    assert sorted((r.id, r.ordinal, r.fields, r.error is not None) for r in told) == [(1, 0, {}, True), (2, 0, {}, True)]


def test_sources_are_normalised_in_one_plan(spark):
    raw = spark.createDataFrame([("x", "1", "100"), ("y", "2", "7"), ("x", "3", None)], "source_key string, external_id string, price string")
    known = {}
    for s in (
        extend.Source("x", lambda df: df.select("source_key", "external_id", F.col("price").cast("int").alias("price_pcm"))),
        extend.Source("y", lambda df: df.select("source_key", "external_id", (F.col("price").cast("int") * 52 / 12).cast("int").alias("price_pcm"), F.lit("y only").alias("note"))),
    ):
        known[s.name] = s
    got = extend.normalised(raw, known)
    assert rows(got.select("source_key", "external_id", "price_pcm", "note")) == sorted([("x", "1", 100, None), ("x", "3", None, None), ("y", "2", 30, "y only")], key=repr)
    with pytest.raises(Exception, match="source without normaliser: y"):
        extend.normalised(raw, {"x": known["x"]}).collect()
    with pytest.raises(ValueError, match="no source"):
        extend.normalised(raw, {})


def test_registered_rules_reach_their_pages(spark, monkeypatch):
    monkeypatch.setattr(extend, "SOURCES", {})
    extend.register_source("x", lambda df: df, {"detail": ("li", {"href": {"sel": "a", "attr": "href"}})})
    extend.register_source("y", lambda df: df, {"detail": ("p", {"text": {"sel": "self"}})})
    bodies = spark.createDataFrame([("x", 1, HTML), ("y", 2, HTML), ("z", 3, HTML)], "source_key string, id int, html string")
    got = rows(extend.source_items(bodies, "id", "html", "detail"))
    assert got == sorted([("x", 1, 0, (("href", "/x/1"),), None), ("x", 1, 1, (("href", "http://o.test"),), None), ("y", 2, 0, (("text", "said"),), None)], key=repr)
    with pytest.raises(ValueError, match="exactly one"):
        extend.register_source("bad", lambda df: df, {"detail": ("li", {"a": {"sel": "a", "const": "b"}})})
    with pytest.raises(ValueError, match="no source has rules"):
        extend.source_items(bodies, "id", "html", "search")


def test_channels_render_their_messages(spark):
    known = {"a": extend.Channel("a", lambda: F.concat(F.lit("to a: "), "title")), "b": extend.Channel("b", lambda: F.col("title"), implemented=False)}
    got = extend.rendered(spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("a", None)], "channel string, title string"), known)
    assert [r.text for r in got.collect()] == ["to a: t", None, None, None]
