"""Rules, layouts, result cards and deep pages."""

from pyspark.sql import functions as F

from rentflow.operators import pages, rules


def test_deep_page_goes_through(spark):
    deep = "<html><body>" + "<p>" * 5000 + "end" + "<table><tr><td>Deposit</td><td>£1<wbr>200</td></tr></table>"
    df = spark.createDataFrame([(1, deep), (2, None)], "page_id int, html string")
    got = pages.extract(df, "page_id", "html", "body", {"deposit": {"label": "Deposit"}}).collect()
    assert [(r.page_id, r.fields["deposit"], r.error) for r in got] == [(1, "£1 200", None)]
    assert pages.layout(df, "page_id", "html").count() == pages.reduce_html(df, "page_id", "html").count() == 2


def test_result_cards(spark):
    html = '<div class="card"><a id="prop77"></a><address>Rope Street, SE16</address></div><div class="card"><a id="prop78"></a><address>Far away, RG30</address></div><div class="card"><a id="x"></a></div>'
    cards = pages.extract(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id", "html", ".card", pages.CARD_RULES)
    cards = cards.select(F.col("fields")["external_id"].alias("external_id"), F.col("fields")["address_raw"].alias("address_raw"))
    known = spark.createDataFrame([("1",)], "external_id string")
    assert [tuple(r) for r in pages.card_tasks(cards, known, ["SE16"], "https://portal.test").collect()] == [("77", "https://portal.test/properties/77")]


def test_sitemap_plan_and_children(spark):
    plan = pages.sitemap_plan("https://portal.test/sitemap.xml", ["https://portal.test/listings-1.xml"], "sweep", spark)
    assert plan.count() == 2 and pages.sitemap_plan("x", ["y"], "hot", spark).count() == 1
    bodies = spark.createDataFrame([("https://portal.test/listings-1.xml", "<loc>https://portal.test/property-to-rent/town/flat/55</loc>"), ("other.xml", "<loc>z</loc>")], "url string, body string")
    assert [(r.kind, r.external_id) for r in pages.follow_children(plan, bodies, "body").collect()] == [("listing", "55")]


def test_json_layout(spark):
    texts = ['{"b": [{"x": 1.5}], "a": {"c": {"d": {"e": 1}}}}', "[]", "nope", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.p for r in df.select("i", rules.json_layout(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == ["a.c.d.e:…|b[].x:float", "[]:empty", "unparseable", None, ":{}"]
