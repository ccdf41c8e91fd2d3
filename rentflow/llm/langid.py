"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 3 with frozen counts. A byte costs -log2 of its probability in the longest
context that the language has seen; where that context hasn't seen the byte, its escape probability (method C: distinct
successors against all) is paid and the next shorter context asked, down to the uniform order -1. A text goes to the
language of the shortest code. The trees are flattened into one table, row = longest known context, column = byte class,
so that a whole text is scored by two array look-ups a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialise

ORDER = 3
#: Labelled texts a language that the trees are fitted on, at most.
TEXTS_PER_LANGUAGE = 400
START = b"\n" * ORDER
LETTER = re.compile(r"[^\W\d_]")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (language, four bytes as a number) of each batch."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            b = [np.frombuffer(START + t.encode(), np.uint8).astype(np.int64) for t in texts]
            g, n = np.unique(np.concatenate([((x[:-3] * 256 + x[1:-2]) * 256 + x[2:-1]) * 256 + x[3:] for x in b]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": g, "n": n})


class Trees:
    """The flattened trees: ``known`` maps three byte classes to a row, ``cost`` has bits by (row, class) and language."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.languages = languages
        seen = np.unique(np.concatenate([gram >> s & 255 for s in (0, 8, 16, 24)])) if len(gram) else np.zeros(0, np.int64)
        self.classes = np.zeros(256, np.int64)  # 0: a byte that no training text has
        self.classes[seen] = np.arange(1, len(seen) + 1)
        k, m = len(seen) + 1, len(languages)
        self.k = k
        c = [self.classes[gram >> s & 255] for s in (24, 16, 8, 0)]
        cost = np.full((1, k, m), 8.0)  # order -1
        self.known = np.zeros(k**ORDER, np.int32)
        where = np.zeros(1, np.int32)  # row of each context of the order before
        for order in range(ORDER + 1):
            context = np.zeros(len(gram), np.int64)
            for x in c[ORDER - order : ORDER]:
                context = context * k + x
            total = np.bincount(context, n, minlength=k**order)
            rows = np.flatnonzero(total)
            base = where[rows % max(1, k ** (order - 1))] if order else np.zeros(len(rows), np.int32)
            own = cost[base]
            new = np.full(k**order, -1, np.int64)
            new[rows] = np.arange(len(rows))
            for i in range(m):
                mine = (lang == i) & (new[context] >= 0)
                count = np.bincount(new[context[mine]] * k + c[ORDER][mine], n[mine], minlength=len(rows) * k).reshape(len(rows), k)
                distinct, all_n = (count > 0).sum(1), count.sum(1)
                has = all_n > 0
                with np.errstate(divide="ignore"):
                    seen_cost = -np.log2(count / np.maximum(1, all_n + distinct)[:, None])
                    escape = -np.log2(distinct / np.maximum(1, all_n + distinct))
                own[:, :, i] = np.where(count > 0, seen_cost, own[:, :, i] + np.where(has, escape, 0)[:, None])
            here = where[np.arange(k**order) % max(1, k ** (order - 1))].copy() if order else np.zeros(1, np.int32)
            here[rows] = len(cost) + np.arange(len(rows))
            cost = np.concatenate([cost, own])
            where = here
        self.known = where.astype(np.int32)
        self.cost = np.ascontiguousarray(cost.reshape(len(cost) * k, m), np.float32)

    def bits(self, text: str) -> np.ndarray:
        """Code length of the text in each language."""
        c = self.classes[np.frombuffer(START + text.encode(), np.uint8)]
        row = self.known[(c[:-3] * self.k + c[1:-2]) * self.k + c[2:-1]]
        return self.cost[row * np.int64(self.k) + c[3:]].sum(0, dtype=np.float64)

    def best(self, text: str | None) -> tuple[str, float]:
        """(language, posterior with equal priors); ties go to the first name."""
        if not self.languages or not text or not LETTER.search(text):
            return "und", 0.0
        bits = self.bits(text)
        i = int(bits.argmin())
        return self.languages[i], float(1 / np.exp2(np.maximum(bits[i] - bits, -1000.0)).sum())


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TEXTS_PER_LANGUAGE) -> Trees:
    """Trees from at most ``per_language`` whole labelled texts of each language, those of the smallest id hashes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where((fold("id") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "langs")  # a row a language
    some = rows.join(F.broadcast(counts), "lang").withColumn("draw", draw).where(F.col("draw") * F.col("of") < 2 * per_language)
    taken = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text")))).where(F.col("nth") <= per_language)
    grams = taken.select("lang", "text").mapInPandas(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(grams["lang"].unique())
    return Trees(languages, grams["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64))


def identify(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """Every row's (``id_col``, held_out, lang_pred, score).

    Learns from rows of folds 1 to 4 only; the prediction reads the text alone. A null or letterless text, or a table
    without labels, gives ``und`` with score 0. A null id is not held out and not learned from. Repeated rows get the same
    answer, an empty table none. Other columns are ignored.
    """
    spark = docs.sparkSession
    trees = spark.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, per_language))  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trees.value.best(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(score, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
