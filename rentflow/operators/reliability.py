"""Sources and jobs over time: refusal streaks, cool-downs, run status, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE_SECONDS, MAX_SECONDS = 1800, 43_200


def streaks(history: DataFrame, by: list[str], order: list[str], bad: Column, segment: Column | None = None) -> DataFrame:
    """``streak``: bad rows in a row up to this one, 0 at a clean one (null counts as clean).

    A segmented scan: rows are numbered inside segments (of ``by`` and a ``segment`` that never falls in ``order``; the day of
    its first column unless given), so a source of any size is many tasks. Of each segment its length, trailing bad rows and
    whether all are bad go on, and give the bad rows that it begins with; a source's segments are as few as days.
    """
    part = "__segment"
    rows = history.withColumns({part: F.to_date(order[0]) if segment is None else segment, "__bad": F.coalesce(bad, F.lit(False))})
    w = Window.partitionBy(*by, part).orderBy(*order)
    islands = rows.withColumn("__island", F.sum((~F.col("__bad")).cast("int")).over(w))
    inside = Window.partitionBy(*by, part, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = islands.withColumn("__run", F.sum(F.col("__bad").cast("int")).over(inside))
    ends = runs.groupBy(*by, part).agg(F.max_by("__run", F.struct(*order)).alias("tail"), F.min("__bad").alias("all_bad"))
    listed = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(part, "tail", "all_bad"))).alias("segments"))
    start = F.struct(F.lit(0).cast("long").alias("now"), F.array().cast("array<bigint>").alias("before"))
    step = lambda acc, x: F.struct((x["tail"] + F.when(x["all_bad"], acc["now"]).otherwise(0)).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before"))
    carried = listed.select(*by, F.explode(F.arrays_zip(F.col("segments"), F.aggregate("segments", start, step)["before"].alias("before"))).alias("s"))
    names = [f"__key{i}" for i in range(len(by) + 1)]
    carried = carried.select(*[F.col(c).alias(k) for c, k in zip([*by, f"s.segments.{part}"], names, strict=True)], F.col("s.before").alias("__before"))
    both = runs.join(carried, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*by, part], names, strict=True)], "left")
    first = F.col("__bad") & (F.col("__island") == 0)
    return both.select(*history.columns, (F.col("__run") + F.when(first, F.col("__before")).otherwise(0)).alias("streak"))


def cooldown(fails: Column) -> Column:
    """Seconds to stay away, doubling with each failure up to a limit."""
    return F.least(F.lit(MAX_SECONDS), F.lit(BASE_SECONDS) * F.pow(F.lit(2), F.least(fails, F.lit(10)))).cast("long")


def run_status(levels: Column) -> Column:
    """failed over degraded over ok, as the max of a rank."""
    rank = F.max(F.when(levels == "error", 2).when(levels == "warn", 1).otherwise(0))
    return F.when(rank == 2, "failed").when(rank == 1, "degraded").otherwise("ok")


def ledger(rows: DataFrame) -> DataFrame:
    """One record a run from its rows (run_id, ts, level, event_type)."""
    return rows.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), run_status(F.col("level")).alias("status"), F.count(F.lit(1)).alias("events"), F.min_by("event_type", F.struct("ts", "id")).alias("first_event"))


def counters(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """Sums by name, as one map a key."""
    sums = rows.groupBy(by, name).agg(F.sum(value).alias("total"))
    return sums.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "total")))).alias("counters"))  # names are few


def stages(rows: DataFrame) -> DataFrame:
    """One record a run and stage from its rows (run_id, stage, ts, id, level, message): times, status, the first error, and
    how many rows of each level there were."""
    level = F.col("level")
    return rows.groupBy("run_id", "stage").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), run_status(level).alias("status"),
        F.min_by(F.when(level == "error", F.col("message")), F.when(level == "error", F.struct("ts", "id"))).alias("error"),
        *[F.count_if(level == name).alias(f"n_{name}") for name in ("info", "warn", "error")],
    )
