"""Page extraction on a small fixture: rules, tri-state icons, layouts, reduction."""

from rentflow.operators import pages as P

HTML = """<body><ul class="cards mt-2"><li data-id="1"><a href="/a/1">First  card</a><i class="yes"></i></li>
<li data-id="2"><a href="https://x.test/2">Second</a><i class="no"></i></li></ul>
<table><tr><td>Deposit held</td><td>x</td><td>£900</td></tr></table><script>track()</script></body>"""
RULES = {
    "title": {"sel": "a"}, "href": {"sel": "a", "attr": "href"}, "digits": {"sel": "a", "attr": "href", "regex": r"(\d+)$"},
    "flag": {"sel": "self", "true_if": "i.yes", "false_if": "i.no"}, "kind": {"const": "card"}, "none": {"sel": "b"},
}


def frame(spark):
    return spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")


def test_extract(spark):
    got = {(r.page_id, r.ordinal): r.fields for r in P.extract(frame(spark), "page_id", "html", "li", RULES).collect()}
    assert got == {
        (1, 0): {"title": "First card", "href": "/a/1", "digits": "1", "flag": "true", "kind": "card"},
        (1, 1): {"title": "Second", "href": "https://x.test/2", "digits": "2", "flag": "false", "kind": "card"},
    }


def test_label_takes_the_last_cell(spark):
    got = P.extract(frame(spark), "page_id", "html", "table", {"deposit": {"label": "deposit"}}).collect()
    assert [r.fields for r in got] == [{"deposit": "£900"}]


def test_layout_is_blind_to_text_and_spacing(spark):
    other = HTML.replace("mt-2", "mt-5").replace("Second", "Third")
    df = spark.createDataFrame([(1, HTML), (2, other), (3, HTML.replace("cards", "rows")), (4, None)], "page_id long, html string")
    got = {r.page_id: r.fingerprint for r in P.layout(df, "page_id", "html").collect()}
    assert got[1] == got[2] != got[3] and len(got) == 4


def test_reduce(spark):
    got = {r.page_id: r for r in P.reduce_html(frame(spark), "page_id", "html", text_limit=8).collect()}
    assert got[1].urls_dropped == 2 and got[1].text_dropped == 2 and "script" not in got[1].reduced
    assert got[2].in_chars == 0 and got[3].text_dropped == 0
