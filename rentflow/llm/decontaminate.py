"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification. DataFrame operations only.

A document holds an item if at least 0.8 of the item's distinct five-word shingles occur in it. Items are short and
documents may be long, so a signature of the whole document would say nothing about one item. The sketch is therefore
taken of the item: its bottom-k MinHash values, with k by the item's size. With q shingles, of which ceil(0.8 q) must
occur, any q - ceil(0.8 q) + 1 of them include one that occurs, so this k loses no document. Items are partitioned by
size (powers of two), and a document meets only partitions whose items it is long enough to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, materialise, words

#: Rows up to which a counted side is broadcast (about 50 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def _shingles(df: DataFrame, keep: list[str], text_col: str, strings: bool) -> DataFrame:
    """A row for each shingle, repeated ones too: kept columns, doc_n (an upper bound of the distinct ones), h[, shingle]."""
    w = df.select(*keep, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    many = F.greatest(F.size("hw") - SHINGLE_WORDS + 1, F.lit(1))
    w = w.select(*keep, *(["w"] if strings else []), "hw", F.explode(F.sequence(F.lit(0), many - 1)).alias("i"))
    at = [F.get("hw", F.col("i") + j) for j in range(SHINGLE_WORDS)]  # null beyond the end of a shorter text
    said = [F.array_join(F.slice("w", F.col("i") + 1, SHINGLE_WORDS), " ").alias("shingle")] if strings else []
    return w.select(*keep, many.alias("doc_n"), F.xxhash64(*at).alias("h"), *said)


def _need(q: Column) -> Column:
    """Shingles of an item of q that a document must hold; the products are exact in decimals."""
    return F.ceil(q.cast("decimal(18,0)") * F.lit(NEAR).cast("decimal(3,2)"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contained(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Pairs (``doc_id``, ``item_id``, n_item, n_shared, containment) with containment >= 0.8, each once.

    Null, empty and wordless texts hold and match nothing; a text of one to four words is one shingle. Rows with a null id
    take no part. Rows that repeat an id count as one text with the shingles of all of them. Empty tables give no rows. Only the
    named columns are read.
    """
    item = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull())
    item = _shingles(item, ["item"], "text", strings=True).select("item", "h", "shingle").distinct()
    item = item.withColumns({"q": F.count(F.lit(1)).over(Window.partitionBy("item")), "place": F.row_number().over(Window.partitionBy("item").orderBy("h", "shingle"))})
    item = materialise(item, "items")
    sketch = item.where(F.col("place") <= F.col("q") - _need(F.col("q")) + 1)
    sketch = sketch.select("item", "h", _need(F.pow(F.lit(2), F.floor(F.log2("q")))).alias("part_need"))  # of the partition's smallest item

    doc = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull())
    met = _shingles(doc, ["doc"], "text", strings=False).join(_small(sketch), "h")
    candidates = materialise(met.where(F.col("doc_n") >= F.col("part_need")).select("doc", "item").distinct(), "candidates")

    found = doc.join(_small(candidates.select("doc").distinct()), "doc", "left_semi")
    said = _shingles(found, ["doc"], "text", strings=True).select("doc", "h", "shingle").distinct()
    # Only the shingles of a document's own candidates meet the document.
    asked = candidates.join(_small(item.select("item", "q", "h", "shingle")), "item")
    shared = said.join(asked, ["doc", "h", "shingle"]).groupBy("doc", "item", "q").agg(F.count(F.lit(1)).alias("n_shared"))
    exact = shared.where(F.col("n_shared") >= _need(F.col("q")))
    return exact.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("q").alias("n_item"), "n_shared", F.round(F.col("n_shared") / F.col("q"), 9).alias("containment"))
