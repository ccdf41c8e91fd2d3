"""Streaks by segments, rules found by their beginnings, JSON paths, and contracts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rentflow.operators import listings, pages, permissions, reliability, rules
from rentflow.sources import contracts


def plain_streaks(rows):
    """(id, streak) of rows (source, day, id, bad) in order."""
    out, now = {}, {}
    for source, _, i, bad in sorted(rows, key=lambda r: (r[1], r[2])):
        now[source] = now.get(source, 0) + 1 if bad else 0
        out[i] = now[source]
    return out


@pytest.mark.parametrize("sources", [1, 3])
def test_streaks_run_through_segments(spark, sources):
    rng = random.Random(sources)
    rows = []
    for day in range(30):
        often = rng.choice([0.0, 0.5, 0.95, 1.0, 1.0])
        rows += [(f"s{rng.randrange(sources)}", f"2024-01-{day + 1:02d}", 1000 * day + i, rng.random() < often if rng.random() < 0.95 else None) for i in range(rng.choice([0, 1, 12]))]
    df = spark.createDataFrame(rows, "source string, day string, id int, bad boolean").withColumn("ts", F.to_timestamp("day"))
    got = reliability.streaks(df, ["source"], ["ts", "id"], F.col("bad"))
    assert got.columns == [*df.columns, "streak"]
    assert {r.id: r.streak for r in got.collect()} == plain_streaks(rows) and max(plain_streaks(rows).values()) > 12
    windows = re.findall(r"windowspecdefinition\(([^)]*)", got._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("__segment" in w for w in windows)  # no source is one task


def test_streaks_of_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, True), (None, 2, True), ("a", 1, True)], "source string, id int, bad boolean")
    got = reliability.streaks(df, ["source"], ["id"], F.col("bad"), segment=F.col("id"))
    assert sorted((str(r.source), r.id, r.streak) for r in got.collect()) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]
    assert reliability.streaks(df.limit(0), ["source"], ["id"], F.col("bad"), segment=F.col("id")).count() == 0


PATTERNS = ["/", "/a", "/a/b*", "/*x$", "/a/*/c", "*", "/abcdefgh/ijklmnop/q", "/abcdefgh/ijklmnop/q$", "$", "/a?b=1", "/é/*"]
PATHS = ["/", "/a", "/a/b", "/a/bc?x", "/a/q/c", "/z/x", "/abcdefgh/ijklmnop/q", "/abcdefgh/ijklmnop/qr", "/a?b=1&c", "/é/1", ""]


def rule_rows(spark, hosts):
    return permissions.rules(spark.createDataFrame([(h, "User-agent: *\n" + "\n".join(f"{'Allow' if i % 2 else 'Disallow'}: {p}" for i, p in enumerate(PATTERNS))) for h in hosts], "host string, body string"))


def test_rules_found_by_beginnings_are_those_of_every_rule(spark):
    def fits(pattern, path):
        body = "".join(".*" if c == "*" else re.escape(c) for c in pattern.rstrip("$"))
        return re.match(body + (r"\Z" if pattern.endswith("$") else ""), path or "/", re.S)

    urls = spark.createDataFrame([("h.test", f"https://h.test{p}") for p in PATHS] + [("other.test", "https://other.test/a")], "host string, url string")
    got = {r.url: (r.allowed, r.winning_rule) for r in permissions.audit(rule_rows(spark, ["h.test"]), urls, "me/1").collect()}
    for p in PATHS:
        path = p or "/"
        best = max(((len(x), i % 2 == 1, x) for i, x in enumerate(PATTERNS) if fits(x, path)), default=None)
        assert got[f"https://h.test{p}"] == ((best[1], best[2]) if best else (True, None)), p
    assert got["https://other.test/a"] == (True, None)


def test_a_hot_host_is_many_keys(spark):
    """A third of all urls on one host: no join key holds much more than a task's share."""
    parts = 16
    urls = [("hot.test", f"https://hot.test/a/{i}") for i in range(1500)] + [(f"h{i}.test", f"https://h{i}.test/a") for i in range(3000)]
    paths = spark.createDataFrame(urls, "host string, url string").withColumn("path", F.regexp_extract("url", "test(/.*)", 1))
    hot = permissions.hot_hosts(paths, parts).collect()
    assert [(r.host, r.salts) for r in hot] == [("hot.test", 6)]
    mine = rule_rows(spark, ["hot.test", "h1.test"]).where("field IN ('allow', 'disallow')").select("host", permissions.pattern_regex(F.col("value")).alias("regex"), F.struct(F.length("value").alias("size"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern")).alias("rule"))
    found = permissions.candidates(mine, paths, parts)
    assert found.where("host = 'hot.test'").select("url").distinct().count() == 1500
    keys = paths.join(permissions.hot_hosts(paths, parts), "host").groupBy(F.pmod(F.xxhash64("url"), F.col("salts"))).count().collect()
    assert len(keys) == 6 and max(r[1] for r in keys) < 2 * len(urls) / parts


def test_json_paths(spark):
    body = '{"a": [{"b": [1, 2]}, {"b": 3}, {"c": null}, {"b": [[4], 5]}], "d": {"e f": true}, "n": null}'
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, None), (4, "[]"), (5, '{"a": 7}')], "id int, body string")

    def values(root, path="$"):
        return [(r.id, r.v) for r in pages.json_rows(df, "body", "api_json", root, {"v": path}, ["id"]).orderBy("id").collect()]

    assert values("$.a[*].b") == [(1, "1"), (1, "2"), (1, "3"), (1, None), (1, "5")]  # lists flatten by one level, [4] is no scalar
    assert values("$.a[3].b[0][*]") == [(1, "4")]
    assert values("$.d['e f']") == [(1, "true")] and values("$.d") == [(1, None)]
    assert values("$.a[*]", "$.b[*]") == [(1, "1"), (1, "3"), (1, None), (1, None), (5, None)]
    assert values("$.n") == [(1, None)] and values("$.missing[*]") == []
    for wrong in ("a.b", "$..a", "$.a[?(@.b)]", "$.a["):
        with pytest.raises(ValueError, match="path"):
            pages.path_steps(wrong)


def test_contracts_of_two_sources(spark):
    rows = spark.createDataFrame([("x", 1, "a", None), ("x", 2, " ", "b"), ("y", 3, None, "c")], "source_key string, external_id int, title string, extra string")
    told = contracts.contracts(spark, {"x": (("external_id", True, "int"), ("title", True, "str"), ("gone", False, "str")), "y": (("extra", True, "str"),)})
    got = {(r.source_key, r.field): r.fill for r in listings.fills(rows, ["source_key"], told).collect()}
    assert got == {("x", "external_id"): 1.0, ("x", "title"): 0.5, ("x", "gone"): 0.0, ("y", "extra"): 1.0}
    plain = rows.withColumns({"price_pcm": F.lit(500), "bedrooms": F.lit(1)})
    verdicts = {r.source_key: (r.verdict, r.low_fields) for r in listings.health_by_contract(plain, ["source_key"], told, 1).collect()}
    assert verdicts == {"x": ("broken", "title"), "y": ("ok", "")}
    assert rules.problems(contracts.rule_table(spark)).where("problem IS NOT NULL").count() == 0
