"""Streaming forms against their batch twins; each stream reads files and ends with the available data."""

import datetime

from pyspark.sql import functions as F

from rentflow import streaming
from rentflow.operators import matching, reconcile
from rentflow.sources import jsonlines


def at(minute):
    return datetime.datetime(2024, 1, 1, 10, 0) + datetime.timedelta(minutes=minute)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def files(spark, tmp_path, rows, schema, parts=1):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_event_volume(spark, tmp_path):
    rows = [(f"src{i % 2}", "info" if i % 3 else "error", at(i)) for i in range(60)]
    stream = files(spark, tmp_path, rows, "source_key string, level string, ts timestamp")
    got = {tuple(r) for r in drained(spark, streaming.event_volume(stream, "10 minutes"), "volume", "complete").collect()}
    batch = streaming.event_volume(spark.createDataFrame(rows, "source_key string, level string, ts timestamp"), "10 minutes")
    assert got == {tuple(r) for r in batch.collect()} and len(got) > 4


def test_tasks_once_across_batches(spark, tmp_path):
    rows = [(str(i % 4) if i % 5 else None, f"u{i % 3}", at(i)) for i in range(20)]
    stream = files(spark, tmp_path, rows, "external_id string, url string, seen_at timestamp", parts=4)
    got = [r.task for r in drained(spark, streaming.new_tasks(stream), "tasks").collect()]
    assert sorted(got) == sorted({e or u for e, u, _ in rows})


def test_new_listings_meet_filters(spark, tmp_path):
    rows = [("a", str(i), 100 * i, at(i)) for i in range(20)]
    schema = "source_key string, external_id string, price_pcm int, first_seen_at timestamp"
    subs = spark.createDataFrame([(1, 1, 500), (2, 1, 1500)], "id int, user_id int, price_max int")
    got = drained(spark, streaming.match_new(files(spark, tmp_path, rows, schema, parts=3), subs), "pairs")
    key = lambda df: sorted((r.subscription_id, r.external_id) for r in df.collect())
    assert key(got) == key(matching.match(spark.createDataFrame(rows, schema), subs))


def listing_state(table):
    return {r.external_id: (r.status, r.miss_count, r.price_pcm, r.first_seen_at, r.last_seen_at) for r in table.rows().collect()}


def test_observations_reach_the_state(spark, tmp_path):
    schema = "external_id string, price_pcm int, seen_at timestamp"
    for rows in ([("1", 100, at(0)), ("2", 200, at(1)), ("1", 110, at(2))], [("2", 250, at(1500)), ("3", 300, at(1501)), ("1", None, at(1502))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.observe(stream, str(tmp_path / "state"), str(tmp_path / "check"), ["external_id"], ["price_pcm"], buckets=4).awaitTermination()
    table = streaming.StateTable(spark, str(tmp_path / "state"), ["external_id"], {"price_pcm": "int"}, buckets=4)
    assert listing_state(table) == {"1": ("active", 0, 110, at(2), at(1502)), "2": ("active", 0, 250, at(1), at(1500)), "3": ("active", 0, 300, at(1501), at(1501))}
    assert sorted((r.external_id, r.price_pcm, r.seen_at) for r in table.prices().collect()) == [("1", 100, at(0)), ("1", 110, at(2)), ("2", 200, at(1)), ("2", 250, at(1500)), ("3", 300, at(1501))]
    assert sorted((r.external_id, r.version) for r in table.new().collect()) == [("1", 0), ("2", 0), ("3", 1)]


def test_a_crash_between_sinks_changes_nothing(spark, tmp_path, monkeypatch):
    """A batch that dies after any of its writes and is run again leaves the tables of a run without a crash."""
    schema = "external_id string, price_pcm int, seen_at timestamp"
    first = spark.createDataFrame([(str(i), 100 + i, at(i)) for i in range(20)], schema)
    second = spark.createDataFrame([("3", 7, at(100)), ("3", 8, at(101)), ("99", 5, at(102))], schema)

    def state(name):
        return streaming.StateTable(spark, str(tmp_path / name), ["external_id"], {"price_pcm": "int"}, buckets=8)

    def content(t):
        return listing_state(t), sorted(map(tuple, t.prices().collect())), sorted(map(tuple, t.new().collect()))

    whole = state("whole")
    whole.apply(first, 0)
    whole.apply(second, 1)
    from pyspark.sql import DataFrameWriter

    real = DataFrameWriter.parquet
    for dies_after in (1, 2, 3):
        broken = state(f"broken{dies_after}")
        broken.apply(first, 0)
        left = [dies_after]

        def parquet(self, path, *a, left=left, **b):
            if not left[0]:
                raise OSError("crash")
            left[0] -= 1
            return real(self, path, *a, **b)

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        before = content(broken)
        try:
            broken.apply(second, 1)
        except OSError:
            pass
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        assert content(broken) == before  # nothing of the unfinished version is seen
        broken.apply(second, 1)
        assert content(broken) == content(whole)


def test_bytes_written_follow_the_batch(spark, tmp_path):
    schema = "external_id string, price_pcm int, seen_at timestamp"
    table = streaming.StateTable(spark, str(tmp_path / "t"), ["external_id"], {"price_pcm": "int"}, buckets=32)
    table.apply(spark.createDataFrame([(str(i), i, at(0)) for i in range(4000)], schema), 0)
    table.apply(spark.createDataFrame([("17", 1, at(1))], schema), 1)
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "t" / "state" / f"version={v}").rglob("*.parquet"))
    assert len(list((tmp_path / "t" / "state" / "version=1").glob("bucket=*"))) == 1
    assert size(1) < size(0) / 10 and table.rows().count() == 4000 and listing_state(table)["17"][2] == 1
    assert set(table.manifest().values()) == {0, 1}


def test_sweeps_count_absence(spark, tmp_path):
    schema = "external_id string, price_pcm int, seen_at timestamp"
    table = streaming.StateTable(spark, str(tmp_path / "t"), ["external_id"], {"price_pcm": "int"}, buckets=4)
    table.apply(spark.createDataFrame([("1", 1, at(0)), ("2", 2, at(0)), ("x3", 3, at(0))], schema), 0)
    again = spark.createDataFrame([("1", 1, at(10))], schema)
    for version in (1, 2):
        table.apply(again, version, "sweep", scope=~F.col("o.external_id").startswith("x"))
    got = {r.external_id: (r.status, r.miss_count, r.delisted_at) for r in table.rows().collect()}
    assert got == {"1": ("active", 0, None), "2": ("delisted", 2, at(10)), "x3": ("active", 0, None)}
    table.apply(spark.createDataFrame([("2", 5, at(20))], schema), 3)
    assert listing_state(table)["2"] == ("active", 0, 5, at(0), at(20))


PAIRS = "user_id long, subscription_id long, source_key string, external_id string, first_seen_at timestamp, cap int, at timestamp"


def folded(rows, sent=None, remember=None):
    """The caps in plain Python: runs in order of time, in each filters by id and listings by first sight."""
    import zoneinfo

    out, taken, tally = [], {}, dict(sent or {})
    for row in sorted(set(rows), key=lambda r: (r[6], r[1], r[4] is not None, r[4] or at(0), r[2], r[3])):
        user, sub, source, listing, _, cap, run = row
        day = run.replace(tzinfo=datetime.UTC).astimezone(zoneinfo.ZoneInfo("Europe/London")).date()
        if tally.get((user, day), 0) < cap and (user, source, listing) not in taken:
            taken[user, source, listing] = day
            tally[user, day] = tally.get((user, day), 0) + 1
            out.append((user, sub, source, listing, run, day))
    return sorted(out)


def run_caps(spark, tmp_path, rows, parts, name, **kw):
    # The last row only moves the watermark on.
    stream = files(spark, tmp_path, rows, PAIRS, parts)
    spark.createDataFrame([(0, 0, "z", "z", None, 1, at(60 * 24 * 400))], PAIRS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drained(spark, streaming.capped(stream, **kw), name)
    return sorted(tuple(r) for r in got.collect() if r.source_key != "z")


def test_caps_of_a_stream_in_pieces(spark, tmp_path):
    import random

    rng = random.Random(4)
    summer = lambda minute: at(minute + 60 * 24 * 180)  # noqa: E731 - London is an hour ahead then
    rows = [(rng.randrange(4), rng.randrange(5), "a", str(rng.randrange(30)), at(rng.randrange(40)) if rng.random() < 0.9 else None, rng.randrange(1, 6), summer(run)) for run in (0, 30, 60 * 12, 60 * 13 + 20, 60 * 37) for _ in range(60)]
    rows = list({(r[0], r[1], r[3], r[6]): r for r in rows}.values())  # one cap and sight a pair and run
    caps = {}
    rows = [(*r[:5], caps.setdefault(r[1], r[5]), r[6]) for r in rows]
    rng.shuffle(rows)
    got = run_caps(spark, tmp_path, rows, 3, "pieces", late="3 days")
    assert got == folded(rows) and len({r[5] for r in got}) >= 2


def test_one_run_in_pieces_is_the_fold_of_the_whole(spark, tmp_path):
    rows = [(u, 10 * u + s, "a", str((7 * i) % 23), at(i % 6), 2 + 3 * s, at(1000)) for u in (1, 2) for s in (0, 1) for i in range(20)]
    rows = list({(r[1], r[3]): r for r in rows}.values())
    got = run_caps(spark, tmp_path, rows, 4, "whole", late="2 days", sent=spark.createDataFrame([(2, at(1000).date(), 4)], "user_id long, day date, sent int"))
    whole = matching.fold_caps(spark.createDataFrame(rows, PAIRS).drop("at"), spark.createDataFrame([(2, 4)], "user_id long, sent long")).where("NOT stop")
    assert [r[:4] for r in got] == sorted(tuple(r)[:4] for r in whole.collect()) and len(got) == 6


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "info", None), (2, None, 2.5)], "run_id int, level string, value double")
    jsonlines.write(rows, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ['{"run_id":1,"level":"info"}', '{"run_id":2,"value":2.5}']
    assert sorted(map(tuple, jsonlines.read(spark, str(tmp_path / "log"), "run_id int, level string, value double").collect())) == [(1, "info", None), (2, None, 2.5)]


def test_changes_inside_a_batch(spark):
    seen = spark.createDataFrame([("1", 1, 100), ("1", 2, 120), ("1", 3, None), ("1", 4, 120), ("2", 1, 50)], "id string, n int, price_pcm int")
    state = spark.createDataFrame([("1", 90)], "id string, price_pcm int")
    got = reconcile.batch_changes(seen, state, ["id"], ["n"]).orderBy("n").collect()
    assert [(r.n, r.old, r.new) for r in got] == [(1, 90, 100), (2, 100, 120)]
    assert seen.where(F.lit(False)).count() == 0
