"""Corpus operators against brute force on whole small tables, and on awkward rows."""

import hashlib
import itertools
import re
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from rentflow.llm import neighbours, pieces, queries, sharding, suffixes, toxicity, urls
from rentflow.llm.common import read, words
from rentflow.llm.decontaminate import contained
from rentflow.llm.jaccard import near_duplicates
from rentflow.llm.langid import identify


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, sf_dir, name):
    assert compare.spark_rows(queries.queries()[name](spark, sf_dir)) == compare.oracle(queries.oracle_sql()[name], sf_dir)


def repeats(texts: dict[int, str | None]) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            piece = data[at : at + 100]
            if piece in seen:
                gone[at : at + 100] = True
            seen.add(piece)
        spans = sum(k for k, _ in itertools.groupby(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_op1_whole_table(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == repeats(docs)


def test_op1_awkward(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(150))
    texts = {1: None, 2: "", 3: "x" * 99, 4: "x" * 100, 5: "x" * 1000, 6: long, 7: "é" + long + "ü", 8: long + long, 9: "ab" * 400, 10: long[:99]}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(df, "doc_id", "text").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == repeats(texts)


def test_op2(spark, sf_dir, docs):
    found = queries.op2_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    laws = {r.law for r in found}
    assert len(laws) == 1
    by = {}
    for r in found:
        data = (docs[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(8))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    if laws == {"bytes"}:
        sizes = [sum(r["size"] for r in by.get(i, [])) for i in range(8)]
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)
    if laws == {"rows"}:
        counts = [len(by.get(i, [])) for i in range(8)]
        assert max(counts) - min(counts) <= 1


def test_op2_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", shards=8).count() == 0


def test_op3_held_out(spark, sf_dir):
    got = queries.op3_toxicity(spark, sf_dir.replace("0.001", "0.01")).select("doc_id", "held_out", "score", "predicted").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op3_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert toxicity.score(few, "doc_id", "text", labels, "toxic").count() == 3
    assert toxicity.score(few.limit(0), "doc_id", "text", labels, "toxic").count() == 0


def exact_nearest(vectors: dict, query, k: int) -> list:
    return sorted((float(np.sqrt(((np.array(v) - np.array(vectors[query])) ** 2).sum())), i) for i, v in vectors.items() if i != query)[:k]


def test_op4_recall(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in read(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    got = {}
    for r in queries.op4_nearest_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        want = exact_nearest(vectors, q, 10)
        hits += len({r.vec_id for r in rows} & {i for _, i in want})
        total += len(want)
    assert set(got) == {i for i in vectors if i % 100 == 0}
    assert hits >= 0.9 * total


def test_op4_awkward(spark):
    rows = [(0, [1.0, 0.0]), (100, None), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [None, 1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, "vec_id", "embedding", df.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 4), (0, 3, 6)]


def test_op5_awkward(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, base), (4, base), (5, base + " more"), (6, "one two"), (7, "one two"), (8, "!!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r.doc_id: r.class_id for r in near_duplicates(df, "doc_id", "text").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8}


def test_op6_awkward(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no host"), (4, "http://A.Example.COM/en/7?x"), (5, "http://example.com/en/8"), (6, "x://net/de/#f")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(df, "page_id", "url", queries.URL_RULES).collect()}
    assert got == {1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("a.example.com", "/en/7", "example.com/en/7"), 5: ("example.com", "/en/8", "com/en/"), 6: ("net", "/de/", "net/de/")}


def test_op7_against_public_library(spark, sf_dir, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for r in queries.op7_sentencepiece(spark, sf_dir).collect():
        text = docs[r.doc_id]
        assert r.lossless
        if text and "▁" not in text:
            assert list(r.piece_ids) == model.encode(text), r.doc_id


def test_op7_round_trip(spark):
    texts = [None, "", " ", "  a  b ", "\n\n x\t", "▁mark ▁", "日本語テキスト", "😀" * 50, "a" * 5000, "é e\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    coded = pieces.encode(df, "text", queries.PIECES)
    assert [r.decoded for r in pieces.decode(coded, "piece_ids", queries.PIECES).orderBy("doc_id").collect()] == texts
    assert pieces.encode(df.limit(0), "text", queries.PIECES).count() == 0


def test_op8_awkward(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (3, "x " * 3000 + item + " y" * 3000), (4, item), (5, item.upper()), (6, "alpha beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, item), (11, None), (12, "short one")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contained(df, "doc_id", "text", items, "item_id", "text").collect()) == [(3, 10), (4, 10), (5, 10)]


def test_op9(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in read(spark, sf_dir.replace("0.001", "0.01"), "labels").collect()}
    got = queries.op9_quality_classifier(spark, sf_dir.replace("0.001", "0.01")).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and labels.get(r.doc_id) is not None]
    assert len(got) == read(spark, sf_dir.replace("0.001", "0.01"), "documents").count()
    assert held and all(0 <= r.score <= 1 for r in held)


def test_op10(spark, sf_dir):
    docs = {r.doc_id: r for r in read(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()}
    right = total = 0
    for r in queries.op10_language_id(spark, sf_dir).select("doc_id", "held_out", "lang_pred", "score").collect():
        d = docs[r.doc_id]
        assert 0 <= r.score <= 1
        if not d.text or not re.search(r"[^\W\d_]", d.text):
            assert r.lang_pred == "und"
        elif r.held_out and d.lang is not None:
            right, total = right + (r.lang_pred == d.lang), total + 1
    assert right >= 0.85 * total


def test_op10_empty(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "123", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(df, "doc_id", "text", "lang").collect()} == {"und"}
    assert identify(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_words_of_nothing(spark):
    assert spark.range(1).select(words(F.lit(None).cast("string")).alias("w")).first().w == []


def test_op1_null_ids_repeated_rows_and_no_rows(spark):
    line = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(3))[:150]
    rows = [(1, "A" + line + "x"), (2, "B" + line + "y"), (2, "B" + line + "y"), (None, line), (None, line), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS body", "1 AS ranges")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digest(df, "doc_id", "text").collect())
    assert got == [(0, 150, 0, 0), (0, 150, 0, 0), (1, 152, 0, 0), (2, 152, 150, 1), (2, 152, 150, 1), (3, 0, 0, 0), (4, 0, 0, 0)]
    assert suffixes.digest(df.limit(0), "doc_id", "text").count() == 0
