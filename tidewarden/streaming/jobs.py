"""Streaming counterparts: label validation, bucket counts, sittings and pile-ons.

Each job writes to a folder and keeps its offsets and state in a checkpoint below the same
folder, so a run that lost executors or was stopped goes on where it was.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewarden.operators import validation
from tidewarden.session import remove

# The state function travels to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Every job takes a trigger as DataStreamWriter.trigger does: what is there (the default), or one
# that goes on, as {"processingTime": "1 minute"}.
AVAILABLE: Mapping = MappingProxyType({"availableNow": True})


def stream_validate(
    labels: DataFrame, json_column: str, out: str, trigger: Mapping = AVAILABLE
) -> StreamingQuery:
    """Label lines -> `out/valid` and `out/quarantine`, split batch by batch.

    A batch overwrites its own folder, so one that is tried again leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validation.parse_judgment(batch, json_column).persist()
        valid, quarantine = validation.split_valid(checked)
        valid.write.mode("overwrite").parquet(f"{out}/valid/batch={batch_id}")
        quarantine.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        checked.unpersist()

    return (
        labels.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(**trigger)
        .start()
    )


COUNTS = "bucket string, n_rows bigint, n_flagged bigint"


def stream_bucket_counts(
    rows: DataFrame, bucket: str, violates: str, out: str, trigger: Mapping = AVAILABLE
) -> StreamingQuery:
    """Rows and flagged rows per bucket so far, in `out/counts`.

    Each batch adds its counts to the table of the batch before and writes the sum as its own
    table, `batch=n`; the tables of the last two batches stay. So the folder does not grow with the
    stream, and a batch that is tried again starts from the same table as the first time.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.col(bucket).cast("string").alias("bucket")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(violates)).alias("n_flagged")
        )
        if batch_id > 0:
            before = spark.read.schema(COUNTS).parquet(f"{out}/counts/batch={batch_id - 1}")
            counts = before.unionByName(counts).groupBy("bucket").agg(
                F.sum("n_rows").alias("n_rows"), F.sum("n_flagged").alias("n_flagged")
            )
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        remove(spark, f"{out}/counts/batch={batch_id - 2}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(**trigger)
        .start()
    )


def latest_counts(tables: DataFrame) -> DataFrame:
    """The counts after the last batch, from the folder `counts`."""
    last = tables.agg(F.max("batch").alias("b")).scalar()
    return tables.where(F.col("batch") == last).drop("batch")


_MERGE_BEFORE_SHUFFLE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def stream_sessions(
    events: DataFrame,
    user: str,
    out: str,
    gap: str = "90 minutes",
    late: str = "1 hour",
    trigger: Mapping = AVAILABLE,
) -> StreamingQuery:
    """Closed sittings per user. A sitting is written once the watermark has passed its gap."""
    sittings = (
        events.withWatermark("ts", late)
        .groupBy(user, F.session_window("ts", gap).alias("sitting"))
        .agg(F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events"))
        .select(user, F.col("sitting.start").alias("started_at"), "ended_at", "n_events")
    )
    # Sittings are merged in the map tasks first, so a busy user does not send every event. A
    # query keeps the settings it was started with.
    conf, pre_merge = events.sparkSession.conf, _MERGE_BEFORE_SHUFFLE
    before = conf.get(pre_merge)
    conf.set(pre_merge, "true")
    try:
        return (
            sittings.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{out}/sittings")
            .option("checkpointLocation", f"{out}/_checkpoint")
            .trigger(**trigger)
            .start()
        )
    finally:
        conf.set(pre_merge, before)


def _span_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


_MINUTE = 60_000_000  # microseconds
_ROWS = ("ts", "user_id", "event_id", "own", "told")
_HELD = (
    "ts array<bigint>, user_id array<string>, event_id array<string>, "
    "own array<boolean>, told array<boolean>"
)
_FOUND = "target_id string, event_id string, ts_micros bigint, user_id string"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _crowded(ts: np.ndarray, user: np.ndarray, reach: int, min_users: int) -> np.ndarray:
    """For events in time order: are there `min_users` users in the closed window before each?

    A user is in reach of an instant from an event on until that event expires or the user's
    next event takes over. Users are numbers; a negative one is nobody.
    """
    some = user >= 0
    at, who = ts[some], user[some]
    by_user = np.lexsort((at, who))
    following = np.full(len(at), np.iinfo(np.int64).max)
    same = who[by_user][1:] == who[by_user][:-1]
    following[by_user[:-1][same]] = at[by_user[1:][same]]
    taken_over = following <= at + reach
    started = np.searchsorted(at, ts, side="right")
    replaced = np.searchsorted(np.sort(following[taken_over]), ts, side="right")
    expired = np.searchsorted(np.sort(at[~taken_over] + reach), ts, side="left")
    return started - replaced - expired >= min_users


class PileOns(StatefulProcessor):
    """The messages of one (target, time span), a map entry per minute.

    A batch reads the minutes that its messages can change and those before that they look back on,
    and writes the ones that did change. An event-time timer goes off when no message that may still
    come can look back on the earliest minute: it drops what is over and waits for the next one.
    """

    def __init__(self, min_users: int, minutes: int) -> None:
        self.min_users, self.reach = min_users, minutes * _MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("minutes", "minute bigint", _HELD)

    def close(self) -> None:
        pass

    def expiry(self, minute: int) -> int:
        """Milliseconds: no instant from then on looks back on the minute."""
        return ((minute + 1) * _MINUTE + self.reach) // 1000

    def minutes(self) -> set[int]:
        """The minutes held, by one call: each call goes from Python to the store."""
        return {key[0] for key in self.held.keys()} if self.held.exists() else set()  # noqa: SIM118

    def read(self, minute: int) -> list[tuple]:
        return list(zip(*self.held.getValue((minute,)), strict=True))

    def handleInputRows(  # noqa: N802
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        arrived: dict[int, list[tuple]] = {}
        for frame in rows:
            columns = [frame[c].tolist() for c in _ROWS[:4]]
            for ts, user, event, own in zip(*columns, strict=True):
                arrived.setdefault(ts // _MINUTE, []).append((ts, user, event, own, False))
        ahead = -(-self.reach // _MINUTE)
        changed = {m + i for m in arrived for i in range(ahead + 1)}
        minutes = sorted({m - i for m in changed for i in range(ahead + 1)})
        known = self.minutes()
        held = {m: (self.read(m) if m in known else []) + arrived.get(m, []) for m in minutes}
        found, start = [], 0
        # Stretches of minutes far apart do not see each other.
        for end in range(1, len(minutes) + 1):
            if end < len(minutes) and minutes[end] == minutes[end - 1] + 1:
                continue
            line = [(m, i, *row) for m in minutes[start:end] for i, row in enumerate(held[m])]
            start = end
            line.sort(key=lambda r: (r[2], r[4]))
            if not line:
                continue
            ts = np.array([r[2] for r in line], np.int64)
            names = {u: n for n, u in enumerate({r[3] for r in line} - {None})}
            users = np.array([names.get(r[3], -1) for r in line], np.int64)
            for row, crowd in zip(line, _crowded(ts, users, self.reach, self.min_users), strict=True):
                minute, i, at, user, event, own, told = row
                # What a minute's window looks back on is whole only for the changed ones.
                if crowd and own and not told and minute in changed:
                    found.append((key[0], event, at, user))
                    held[minute][i] = (at, user, event, own, True)
                    arrived.setdefault(minute, [])
        for minute in arrived:
            self.held.updateValue((minute,), tuple(list(c) for c in zip(*held[minute], strict=True)))
        if not known:
            self.handle.registerTimer(self.expiry(min(arrived)))
        if found:
            yield pd.DataFrame(found, columns=["target_id", "event_id", "ts_micros", "user_id"])

    def handleExpiredTimer(  # noqa: N802
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for minute in self.minutes():
            if self.expiry(minute) <= now:
                self.held.removeKey((minute,))
            else:
                left.append(minute)
        if left:
            self.handle.registerTimer(self.expiry(min(left)))
        yield from ()


def stream_pile_on(
    messages: DataFrame,
    out: str,
    min_users: int = 3,
    minutes: int = 10,
    span_seconds: int = 3600,
    late: str = "10 minutes",
    trigger: Mapping = AVAILABLE,
) -> StreamingQuery:
    """Messages that belong to a pile-on, each written once, as soon as it is known.

    State is kept per (target, time span), so that a backlog of a busy target spreads over its
    spans: messages of the last minutes go to the next span as context too. Messages may come in
    any order within the lateness; later ones are dropped by the watermark. A late message can turn
    earlier ones of the span into pile-on messages, which are then written. Ids may be of any type
    and are written as text. Messages without a target never count; those without a user are judged
    but count as nobody. The state store is RocksDB, which the query sets for itself.
    """
    reach = F.expr(f"INTERVAL {minutes} MINUTES")
    own = _span_of(F.col("ts"), span_seconds)
    following = _span_of(F.col("ts") + reach, span_seconds)
    keyed = (
        messages.where(F.col("target_id").isNotNull())
        .withWatermark("ts", late)
        .select(
            *[F.col(c).cast("string").alias(c) for c in ("target_id", "user_id", "event_id")],
            F.explode(F.array_distinct(F.array(own, following))).alias("span"),
            own.alias("_own"),
            F.col("ts").alias("event_time"),
        )
        .select(
            "target_id",
            "span",
            F.unix_micros("event_time").alias("ts"),
            "user_id",
            "event_id",
            (F.col("_own") == F.col("span")).alias("own"),
            "event_time",
        )
    )
    found = keyed.groupBy("target_id", "span").transformWithStateInPandas(
        statefulProcessor=PileOns(min_users, minutes),
        outputStructType=_FOUND,
        outputMode="append",
        timeMode="EventTime",
    )
    # A query keeps the settings it was started with.
    conf = messages.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        return (
            found.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{out}/pile_on")
            .option("checkpointLocation", f"{out}/_checkpoint")
            .trigger(**trigger)
            .start()
        )
    finally:
        conf.set(_STORE, before)
