"""Training-data pipeline over ``documents``: STAGES in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentflow.llm import toxicity
from rentflow.llm.common import materialise, read
from rentflow.llm.decontaminate import contained
from rentflow.llm.jaccard import near_duplicates
from rentflow.llm.pieces import encode
from rentflow.llm.queries import PIECES
from rentflow.llm.suffixes import strip

#: Rows of decisions up to which they are broadcast to the documents; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id isn't in ``gone``. A null id names no document, so its rows stay."""
    gone = materialise(gone.select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    scored = toxicity.score(docs, "doc_id", "text", read(spark, sf_dir, "labels"), "toxic")
    return _without(docs, scored.where(F.col("predicted") == 1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, Jaccard 0.8 or more) the document of the smallest id."""
    found = near_duplicates(docs, "doc_id", "text")
    return _without(docs, found.where(F.col("doc_id") != F.col("class_id")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes or more that an earlier one, or itself earlier, has."""
    return strip(docs, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 or more of its five-word shingles)."""
    return _without(docs, contained(docs, "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text that is left."""
    coded = encode(docs.select("doc_id", "text"), "text", PIECES)
    return coded.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: SQL expresses neither the learned first stage nor the pieces of the last; tests check run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written as Parquet and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
