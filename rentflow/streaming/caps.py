"""Daily caps over a stream of matches, in event time: transformWithState with a user's tally, listings and waiting pairs."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.matching import Tally

ZONE = ZoneInfo("Europe/London")
DAY_MS = 24 * 3600 * 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, subscription_id long, source_key string, external_id string, at timestamp, day date"


def london_day(micros: int) -> int:
    """Days since 1970 of a time, on London's calendar."""
    at = datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=micros)
    return (at.astimezone(ZONE).date() - datetime.date(1970, 1, 1)).days


class Caps(StatefulProcessor):
    """A run's pairs wait until the watermark has passed the run's time; then they are folded as ``matching.fold_caps`` does:
    filters by id, listings by first sight, each while the user's tally of the London day is below the filter's cap, each
    listing once. So neither the order of arrival nor the cut into batches matters.

    Listings that went out are remembered for ``remember`` days, tallies for one day after theirs; timers clear them (state
    with a time to live of its own is for processing time only).
    """

    def __init__(self, remember: int) -> None:
        self.remember = remember

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, subscription_id long, first_seen long, source_key string, external_id string", "cap int")
        self.sent = handle.getMapState("sent", "day int", "sent int")
        self.taken = handle.getMapState("taken", "source_key string, external_id string", "day int")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        runs = set()
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64")
            first = pdf["first_seen_at"].astype("datetime64[us]")
            known = first.notna()
            first = first.astype("int64").where(known, -(2**62))
            for row in zip(at.tolist(), pdf["subscription_id"].tolist(), first.tolist(), pdf["source_key"], pdf["external_id"], pdf["cap"].tolist(), strict=True):
                self.waiting.updateValue(row[:5], (row[5],))
                runs.add(row[0] // 1000)
        for run in runs:
            self.handle.registerTimer(run)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((*k, v[0]) for k, v in self.waiting.iterator() if k[0] // 1000 <= now)
        tallies: dict[int, Tally] = {}
        out = []
        for at, sub, first, source, listing, cap in ready:
            day = london_day(at)
            if day not in tallies:
                tallies[day] = Tally(self.sent.getValue((day,))[0] if self.sent.containsKey((day,)) else 0)
            pair = (source, listing)
            if not self.taken.containsKey(pair) and tallies[day].take(pair, cap):
                self.taken.updateValue(pair, (day,))
                out.append((int(key[0]), sub, source, listing, pd.Timestamp(at, unit="us"), datetime.date(1970, 1, 1) + datetime.timedelta(days=day)))
            self.waiting.removeKey((at, sub, first, source, listing))
        for day, tally in tallies.items():
            self.sent.updateValue((day,), (tally.sent,))
        self.clear(now, bool(ready))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def clear(self, now: int, folded: bool) -> None:
        """Drops what is old. One timer is open as long as there is something to forget."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is not None and now >= due:
            today = london_day(now * 1000)
            for day in [k[0] for k, _ in self.sent.iterator() if k[0] < today - 1]:
                self.sent.removeKey((day,))
            for pair in [k for k, v in self.taken.iterator() if v[0] < today - self.remember]:
                self.taken.removeKey(pair)
            self.due.clear()
            due = None
            folded = folded or any(True for _ in self.taken.iterator()) or any(True for _ in self.sent.iterator())
        if due is None and folded:
            self.due.update((now + DAY_MS,))
            self.handle.registerTimer(now + DAY_MS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        for day, sent in zip(initialState["day"], initialState["sent"], strict=True):
            self.sent.updateValue(((pd.Timestamp(day).date() - datetime.date(1970, 1, 1)).days,), (int(sent),))

    def close(self) -> None:
        pass


def capped(pairs: DataFrame, late: str = "1 hour", remember: int = 90, sent: DataFrame | None = None) -> DataFrame:
    """Queued alerts (user_id, subscription_id, source_key, external_id, at, day) of a stream of eligible pairs (user_id,
    subscription_id, source_key, external_id, first_seen_at, cap, at), in append mode.

    ``at`` is the time of the run that found the pair; a run's pairs may arrive in any order until the watermark, ``late``
    behind, passes it, later ones are left out. Caps hold by filter against the user's tally of the London day of the run.
    ``sent`` (user_id, day, sent) are tallies at the start. Repeated pairs of a run count once.
    """
    spark = pairs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = pairs.select("user_id", "subscription_id", "source_key", "external_id", "first_seen_at", "cap", "at").withWatermark("at", late)
    rows = rows.withColumns({"user_id": rows["user_id"].cast("long"), "subscription_id": rows["subscription_id"].cast("long"), "cap": rows["cap"].cast("int")})
    start = sent.select(sent["user_id"].cast("long").alias("user_id"), "day", "sent").groupBy("user_id") if sent is not None else None
    return rows.groupBy("user_id").transformWithStateInPandas(Caps(remember), OUT, "append", "eventTime", initialState=start)
