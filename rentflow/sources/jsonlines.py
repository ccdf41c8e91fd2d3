"""JSON-lines logs and bot updates: nulls are left out on writing, unknown fields ignored on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOT_UPDATE = "struct<update_id: long, message: struct<chat: struct<id: long>, `from`: struct<id: long>, text: string>>"


def line(rows: DataFrame) -> Column:
    """A row as one JSON object without its null fields."""
    return F.to_json(F.struct(*rows.columns))


def write(rows: DataFrame, path: str) -> None:
    rows.select(line(rows).alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log; a line that isn't JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def bot_update(body: Column) -> Column:
    """An update as a struct; without a chat or a text these are null."""
    return F.from_json(body, BOT_UPDATE)
