"""Robots rules (RFC 9309) as a table, and an audit of urls against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import url_path


def rules(texts: DataFrame) -> DataFrame:
    """(host, group_no, token, field, value, line) of texts (host, body). Agent lines in a row share a group; a rule before
    any agent, and an empty Disallow, say nothing; what follows ``#`` is a comment."""
    lines = texts.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
    said = F.trim(F.split("raw", "#", 2)[0])
    lines = lines.withColumn("said", said).where(F.col("said").contains(":"))
    lines = lines.select("host", "line", F.lower(F.trim(F.split("said", ":", 2)[0])).alias("field"), F.trim(F.split("said", ":", 2)[1]).alias("value"))
    w = Window.partitionBy("host").orderBy("line")
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag("field").over(w) == "user-agent", F.lit(False))
    lines = lines.withColumn("group_no", F.sum(starts.cast("int")).over(w))
    agents = lines.where(agent & (F.col("group_no") > 0)).select("host", "group_no", F.lower("value").alias("token"))
    kept = lines.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "") & (F.col("group_no") > 0) | F.col("field").isin("crawl-delay", "sitemap"))
    return kept.join(agents, ["host", "group_no"], "left")


def product_token(agent: Column) -> Column:
    head = F.trim(F.split(agent, "/", 2)[0])
    return F.lower(F.when(head == "", agent).otherwise(F.split(head, r"\s+")[0]))


def groups(table: DataFrame, agent: str) -> DataFrame:
    """The group of each host that speaks to the agent: longest token in its product token, first on ties, else ``*``."""
    token = product_token(F.lit(agent))
    fits = table.where(F.col("token").isNotNull()).select("host", "group_no", "token").distinct().where((F.col("token") == "*") | ((F.col("token") != "") & token.contains(F.col("token"))))
    rank = F.when(F.col("token") == "*", 0).otherwise(F.length("token"))
    return fits.groupBy("host").agg(F.min_by("group_no", F.struct((-rank).alias("r"), "group_no")).alias("group_no"))


def pattern_regex(pattern: Column) -> Column:
    """An anchored regular expression: ``*`` is anything, a final ``$`` the end."""
    bare = F.regexp_replace(pattern, r"\$+$", "")
    body = F.replace(F.regexp_replace(bare, r"([^A-Za-z0-9*/_-])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), body, F.when(pattern.endswith("$"), r"\z").otherwise(""))


#: Lengths of the path prefixes by which rules are found.
PREFIXES = (0, 1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def literal(pattern: Column) -> Column:
    """What every path that fits the pattern begins with: the pattern up to its first ``*`` or its end mark."""
    return F.split(F.regexp_replace(pattern, r"\$+$", ""), r"\*", 2)[0]


def hot_hosts(paths: DataFrame, parts: int) -> DataFrame:
    """(host, salts): hosts with more than a ``parts``-th of all rows, at most ``parts`` of them, and their shares."""
    counts = paths.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).where(F.col("n") * parts > F.col("total")).select("host", F.ceil(F.col("n") * parts / F.col("total")).cast("int").alias("salts"))


def candidates(rules_: DataFrame, paths: DataFrame, parts: int) -> DataFrame:
    """(host, url, path, regex, rule): the rules of a url's host whose literal beginning the path has, by an equi-join.

    A rule is filed under the longest of PREFIXES that its beginning fills, a path looks under each that it fills. Of hot
    hosts the rules are repeated and the urls dealt out, so no key has much more than a ``parts``-th of the urls.
    """
    hot = F.broadcast(hot_hosts(paths, parts))
    start = literal(F.col("rule.pattern"))
    longest = F.array_max(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length(start)))
    filed = rules_.join(hot, "host", "left").withColumns({"start": start, "size": longest, "salt": F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))})
    filed = filed.select("host", "size", F.expr("substring(start, 1, size)").alias("prefix"), "salt", "regex", "rule")
    salt = F.pmod(F.xxhash64("url"), F.coalesce("salts", F.lit(1))).cast("int")
    asked = paths.join(hot, "host", "left").select("host", "url", "path", salt.alias("salt"), F.explode(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length("path"))).alias("size"))
    asked = asked.withColumn("prefix", F.expr("substring(path, 1, size)"))
    return asked.join(filed, ["host", "size", "prefix", "salt"]).select("host", "url", "path", "regex", "rule")


def audit(table: DataFrame, urls: DataFrame, agent: str) -> DataFrame:
    """``urls`` (host, url, ...) with allowed and winning_rule: the longest pattern that fits, allow on ties, else allowed.

    Rules are found by host and literal beginning, only those found are tried as regular expressions. The best rule is a max
    over a struct, so it is combined before the shuffle."""
    mine = table.where(F.col("field").isin("allow", "disallow")).join(groups(table, agent), ["host", "group_no"], "left_semi")
    mine = mine.select("host", pattern_regex(F.col("value")).alias("regex"), F.struct(F.length("value").alias("size"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern")).alias("rule")).distinct()
    paths = urls.select("host", "url").distinct().withColumn("path", url_path(F.col("url")))
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = candidates(mine, paths, parts).where(F.expr("path rlike regex")).groupBy("host", "url").agg(F.max("rule").alias("rule"))
    return urls.join(best, ["host", "url"], "left").select(*urls.columns, F.coalesce("rule.allow", F.lit(True)).alias("allowed"), F.col("rule.pattern").alias("winning_rule"))


def policy(table: DataFrame, agent: str) -> DataFrame:
    """Each host's rule count, crawl delay and sitemaps for the agent."""
    mine = table.join(groups(table, agent), ["host", "group_no"], "left_semi")
    rule = F.col("field").isin("allow", "disallow")
    own = mine.groupBy("host").agg(F.count_distinct(F.when(rule, F.struct("field", "value"))).alias("n_rules"), F.max(F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double"))).alias("delay"))
    maps = table.groupBy("host").agg(F.count_distinct(F.when(F.col("field") == "sitemap", F.col("value"))).alias("n_sitemaps"))
    return maps.join(own, "host", "left").select("host", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "delay", "n_sitemaps")


def sitemaps(table: DataFrame) -> DataFrame:
    """(host, url) of every sitemap that a host's rules name, whoever they speak to."""
    return table.where(F.col("field") == "sitemap").select("host", F.col("value").alias("url")).distinct()


def summary(texts: DataFrame, agent: str) -> DataFrame:
    """(host, group_tokens, n_rules, delay, n_sitemaps, blanket, unreadable) of answers (host, status, body): what their rules say
    to the agent. An answer other than 200, or an empty one, is unreadable, and nothing there counts as permitted."""
    read = (F.col("status") == 200) & (F.coalesce("body", F.lit("")) != "")
    table = rules(texts.where(read))
    spoken = table.join(groups(table, agent), ["host", "group_no"], "left_semi").groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("token")), "/").alias("group_tokens"))  # tokens of one group
    readable = texts.where(read).select("host").distinct()
    roots = readable.withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/")))
    blanket = audit(table, roots, agent).select("host", (~F.col("allowed")).alias("blanket"))
    told = readable.join(spoken, "host", "left").join(policy(table, agent), "host", "left").join(blanket, "host", "left")
    told = told.select("host", "group_tokens", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "delay", F.coalesce("n_sitemaps", F.lit(0)).alias("n_sitemaps"), "blanket", F.lit(False).alias("unreadable"))
    shut = texts.where(~F.coalesce(read, F.lit(False))).select("host").distinct().join(readable, "host", "left_anti")
    return told.unionByName(shut.select("host", F.lit(None).cast("string").alias("group_tokens"), F.lit(0).alias("n_rules"), F.lit(None).cast("double").alias("delay"), F.lit(0).alias("n_sitemaps"), F.lit(True).alias("blanket"), F.lit(True).alias("unreadable")))


def shut_out(table: DataFrame, agent: str) -> DataFrame:
    """(host, blanket): whether the agent may not even read ``/``."""
    roots = table.select("host").distinct().withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/")))
    return audit(table, roots, agent).select("host", (~F.col("allowed")).alias("blanket"))
