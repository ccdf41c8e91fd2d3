"""The registered queries of this package and, where SQL can express them, the same rows in DuckDB's SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, quality_rules, toxicity, urls
from .collocations import collocations
from .common import read
from .decontaminate import contained
from .jaccard import near_duplicates
from .langid import identify
from .neighbours import search
from .pieces import encode
from .sharding import shard
from .spelling import variants
from .suffixes import digest
from .urls import judge

#: Vocabulary file of the public tokenizers; a parameter of the operator.
PIECES = os.environ.get("RENTFLOW_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), "doc_id", "text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), "doc_id", "text", shards=8)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the nearest examples as evidence; labels of held-out rows, and every other column, stay unread."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, "doc_id", "text", read(spark, sf_dir, "labels"), "toxic")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, "vec_id", "embedding", vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", PIECES, check_col="lossless")
    return coded.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "lossless")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, "doc_id", "text", "lang", "source", read(spark, sf_dir, "labels"), "quality")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), "text", "lang")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"), "doc_id", "text").select("word", "form", "root", "n", "n_near", "form_n")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoffs by language, from the quality labels."""
    return quality_rules.judge(read(spark, sf_dir, "documents"), "doc_id", "text", "lang", read(spark, sf_dir, "labels"), "quality")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_url_filters": op6_url_filters,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_decontamination": op8_decontamination,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_id": op10_language_id,
        "op11_collocations": op11_collocations,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_quality_rules": op13_quality_rules,
    }


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, rhost, rpath, rverdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
hp AS (SELECT DISTINCT host, path FROM p),
fit AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(rverdict, length(rule)) AS rverdict
  FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
j AS (
  SELECT p.*, fit.rule, fit.rverdict, regexp_replace(p.path, '[0-9]+', '{n}', 'g') AS shape FROM p LEFT JOIN fit USING (host, path)),
leaves AS (
  SELECT host, shape, count(*) AS n, count(rule) AS labelled, sum(CASE WHEN rverdict = 'block' THEN 1 ELSE 0 END) AS blocked FROM j GROUP BY host, shape),
t0 AS (SELECT *, CASE WHEN length(shape) = 0 THEN [''] ELSE string_split(substr(shape, 2), '/') END AS raw, '' AS template FROM leaves),
s0 AS (SELECT * EXCLUDE (raw), CASE WHEN len(raw) > {depth} THEN raw[1:{depth} - 1] || [array_to_string(raw[{depth}:], '/')] ELSE raw END AS parts FROM t0),
%s
node AS (
  SELECT host, template, (sum(blocked) + 2.0 * (SELECT sum(blocked)::DOUBLE / sum(n) FROM leaves)) / (sum(labelled) + 2.0) AS purity
  FROM s{depth} GROUP BY host, template)
SELECT page_id, j.host, path, rule, coalesce(rverdict, CASE WHEN j.host <> '' AND purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM j JOIN (SELECT host, shape, template FROM s{depth}) USING (host, shape) JOIN node USING (host, template)
"""

OP6_LEVEL = r"""
b{0} AS (
  SELECT host, template, parts[{0}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM s{1} WHERE len(parts) >= {0} GROUP BY host, template, parts[{0}]),
w{0} AS (
  SELECT *, count(*) OVER s AS children, sum(n) OVER s AS all_n, sum(labelled) OVER s AS al, sum(blocked) OVER s AS ab FROM b{0} WINDOW s AS (PARTITION BY host, template)),
l{0} AS (
  SELECT host, template, segment, CASE WHEN children > 20 AND all_n < children * 5 THEN '*'
    WHEN labelled > 0 AND al - labelled > 0 AND abs(blocked::DOUBLE / labelled - (ab - blocked)::DOUBLE / (al - labelled))
      <= 1.96 * sqrt((ab::DOUBLE / al) * (1 - ab::DOUBLE / al) * (1.0::DOUBLE / labelled + 1.0::DOUBLE / (al - labelled))) THEN '*' ELSE segment END AS label FROM w{0}),
s{0} AS (
  SELECT s{1}.* EXCLUDE (template), CASE WHEN l{0}.label IS NULL THEN s{1}.template ELSE s{1}.template || '/' || l{0}.label END AS template
  FROM s{1} LEFT JOIN l{0} ON s{1}.host = l{0}.host AND s{1}.template = l{0}.template AND s{1}.parts[{0}] = l{0}.segment),
"""

OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ix AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM iw WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM ix),
q AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
dx AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM dw WHERE len(w) > 0),
doc AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dx),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared::DOUBLE / n_item, 9) AS containment
FROM hits JOIN q USING (item_id) WHERE n_shared * 10 >= n_item * 8
"""


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c * 100 >= 80 * (na.n + nb.n - c)),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(root) AS root FROM r GROUP BY id),
l AS (SELECT a, count(*) AS l FROM e GROUP BY a)
SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(l, 0) AS n_links FROM documents LEFT JOIN k ON k.id = doc_id LEFT JOIN l ON l.a = doc_id
"""


OP11_SQL = r"""
WITH cut_up AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
piece AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut_up),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
phrases AS (
  SELECT lang, w[i] AS phrase FROM spot UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] FROM spot WHERE i < len(w)
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spot WHERE i + 1 < len(w)),
f AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS p, count(*) AS a FROM phrases GROUP BY lang, phrase HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
c AS (SELECT lang, phrase, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, len(c.p) AS words, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:k], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, q, max(a) AS a FROM (SELECT lang, p[1] || ' ' || p[2] AS q, a FROM f WHERE len(p) = 3 UNION ALL SELECT lang, p[2] || ' ' || p[3], a FROM f WHERE len(p) = 3) GROUP BY lang, q),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.q = low.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

#: crc32 of a text in SQL: the table by its rule, then a fold over the bytes.
CRC_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
CRC = "xor(list_reduce([4294967295] || list_transform(range(octet_length(encode({0}))), lambda j: ('0x' || substr(hex(encode({0})), 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (%s),
run AS (
  SELECT doc, run, count(*) AS n FROM (
    SELECT doc_id::VARCHAR AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc, run),
hashed AS (SELECT run, n, %s AS h FROM (SELECT *, coalesce(doc, '') || ':' || run AS x FROM run), crc),
slip AS (SELECT CASE WHEN h %% 31 = 0 THEN substr(run, 1, h %% length(run)) || substr(run, h %% length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slip WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
spot AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
del AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM spot),
near AS (
  SELECT a.word, b.word AS other FROM del AS a JOIN del AS b ON a.i = b.i AND a.d = b.d WHERE a.word <> b.word
  UNION SELECT del.word, v.word FROM del JOIN v ON v.word = d UNION SELECT v.word, del.word FROM del JOIN v ON v.word = d),
best AS (
  SELECT near.word, count(*) AS n_near, max(v.n) AS most, min(encode(other)) FILTER (v.n = m) AS first
  FROM (SELECT near.*, max(v.n) OVER (PARTITION BY near.word) AS m FROM near JOIN v ON v.word = other) AS near JOIN v ON v.word = other GROUP BY near.word),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN decode(first) END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS goal, 1 AS d FROM f WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form, d + 1 FROM chain JOIN f ON f.word = chain.goal WHERE f.form IS NOT NULL),
root AS (SELECT word, max_by(goal, d) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (word)
""" % (CRC_TABLE, CRC.format("x"))

OP13_RULES = {"symbols": "n_symbols * 1000 // n_words", "repeated_lines": "n_dup_lines * 1000 // n_lines", "repeated_words": "n_repeat_words * 1000 // n_words", "capitals": "n_capitals * 1000 // word_chars", "long_words": "word_chars * 100 // n_words"}
OP13_SQL = r"""
WITH crc AS MATERIALIZED ({crc_table}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
spot AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS x, unnest(w[2:len(w) - 1]) AS y, unnest(w[3:]) AS z FROM w WHERE len(w) > 2),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM spot),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r),
m AS (
  SELECT r, doc_id, stratum, md5(text) AS digest, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN rep USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {values} FROM m),
mark AS (SELECT doc_id, min(quality) AS mark FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
one AS (SELECT b.*, mark FROM b JOIN mark USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY stratum, digest ORDER BY doc_id) = 1),
k AS MATERIALIZED (SELECT *, mark = 1 AS good, {crc} % 5 IN ({selecting}) AS selecting FROM (SELECT *, doc_id::VARCHAR AS x FROM one), crc),
long AS ({long}),
counts AS (SELECT stratum, rule, value, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM long GROUP BY ALL),
told AS (
  SELECT stratum, rule, value, sum(good) OVER w AS all_good, sum(bad) OVER w AS all_bad, coalesce(sum(good) OVER up, 0) AS good_above, coalesce(sum(bad) OVER up, 0) AS bad_above
  FROM counts WINDOW w AS (PARTITION BY stratum, rule), up AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (
  SELECT stratum, level, rule, CASE WHEN bad_above * all_good > good_above * all_bad THEN value END AS cutoff
  FROM told, (VALUES {levels}) AS l(level, allowed) WHERE all_good > 0 AND 1000 * good_above <= allowed * all_good QUALIFY row_number() OVER (PARTITION BY stratum, level, rule ORDER BY value) = 1),
policy AS MATERIALIZED (SELECT stratum, level, {pivot} FROM cuts GROUP BY stratum, level),
hit AS (SELECT k.stratum, level, good, selecting, {above} AS hit FROM k JOIN policy AS p ON p.stratum = k.stratum),
sums AS (
  SELECT stratum, level, count(*) FILTER (good AND NOT selecting) AS n, count(*) FILTER (good AND NOT selecting AND hit) AS k, count(*) FILTER (good AND selecting) AS sg,
    count(*) FILTER (good AND selecting AND hit) AS xg, count(*) FILTER (NOT good AND selecting) AS sb, count(*) FILTER (NOT good AND selecting AND hit) AS xb FROM hit GROUP BY stratum, level),
tested AS (
  SELECT *, CASE WHEN k >= n * {rate} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) END
    <= {risk} / (SELECT count(DISTINCT stratum) FROM sums) AS passed FROM sums),
certified AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum ORDER BY level) AS certified FROM tested),
best AS (
  SELECT stratum, level FROM certified WHERE certified
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY round(CASE WHEN sb > 0 THEN xb::DOUBLE / sb ELSE 0 END - xg::DOUBLE / sg, 9) DESC, level) = 1),
cut AS (SELECT policy.* FROM policy JOIN best USING (stratum, level))
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by, stratum_certified
FROM (SELECT k.*, p.stratum IS NOT NULL AS stratum_certified, concat_ws(',', {named}) AS rejected_by FROM b AS k LEFT JOIN cut AS p ON p.stratum = k.stratum)
"""


def _op13_sql() -> str:
    rules = list(OP13_RULES)
    over = [f"k.{r} > p.{r}" for r in rules]
    return OP13_SQL.format(
        crc_table=CRC_TABLE, crc=CRC.format("x"), values=", ".join(f"CASE WHEN NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) THEN {e} END AS {r}" for r, e in OP13_RULES.items()),
        selecting=", ".join(map(str, quality_rules.SELECTING)), long=" UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {r} AS value FROM k WHERE selecting" for r in rules),
        levels=", ".join(f"({i}, {x})" for i, x in enumerate(quality_rules.LEVELS)), pivot=", ".join(f"max(cutoff) FILTER (rule = '{r}') AS {r}" for r in rules),
        above=" OR ".join(f"coalesce({o}, false)" for o in over), named=", ".join(f"CASE WHEN {o} THEN '{r}' END" for r, o in zip(rules, over, strict=True)), rate=quality_rules.RATE, risk=quality_rules.RISK,
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": OP5_SQL,
        "op6_url_filters": (OP6_SQL % "".join(OP6_LEVEL.format(i, i - 1) for i in range(1, urls.DEPTH + 1))).replace("{depth}", str(urls.DEPTH)),
        "op8_decontamination": OP8_SQL,
        "op11_collocations": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_quality_rules": _op13_sql(),
    }
