import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_ordered import SCHEMA, _df, _log, _piled
from tests.test_validation import LINES
from tidewarden.session import scratch_dir
from tidewarden.streaming import jobs


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 40), st.integers(-1, 4)), min_size=1, max_size=60),
    st.integers(0, 12),
    st.integers(1, 4),
)
def test_crowded_equals_counting(events, reach, users):
    events = sorted(events)
    ts = np.array([t for t, _ in events], dtype=np.int64)
    user = np.array([u for _, u in events], dtype=np.int64)
    wanted = [len({u for s, u in events if u >= 0 and t - reach <= s <= t}) >= users for t, _ in events]
    assert jobs._crowded(ts, user, reach, users).tolist() == wanted


def _feed(spark, rows, folder, parts):
    """Writes rows as several files, one per micro-batch."""
    for part in parts:
        _df(spark, [rows[i] for i in part]).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [11, 12])
def test_pile_on_stream_equals_batch(spark, seed):
    """Rows out of order inside the allowed lateness, over several micro-batches."""
    rows = sorted(_log(seed, n=200, hours=6), key=lambda r: r[1])
    rng = random.Random(seed)
    place = sorted(range(len(rows)), key=lambda i: rows[i][1].timestamp() + rng.uniform(0, 3000))
    parts = [place[i : i + 50] for i in range(0, len(place), 50)]
    out = scratch_dir(spark, "test-pile-on")
    _feed(spark, rows, f"{out}/in", parts)
    jobs.stream_pile_on(
        _stream(spark, f"{out}/in"), out, span_seconds=3600, late="2 hours"
    ).awaitTermination()
    got = [int(r["event_id"]) for r in spark.read.parquet(f"{out}/pile_on").collect()]
    assert sorted(got) == sorted(_piled(rows))


def test_pile_on_stream_goes_on_after_a_stop(spark):
    rows = sorted(_log(13, n=120, hours=3), key=lambda r: r[1])
    out = scratch_dir(spark, "test-restart")
    for part in (range(60), range(60, 120)):
        _feed(spark, rows, f"{out}/in", [part])
        jobs.stream_pile_on(_stream(spark, f"{out}/in"), out, late="3 hours").awaitTermination()
    got = [int(r["event_id"]) for r in spark.read.parquet(f"{out}/pile_on").collect()]
    assert sorted(got) == sorted(_piled(rows))


TEXT_IDS = "event_id string, ts timestamp, user_id string, target_id string"


def test_pile_on_stream_with_text_ids_and_late_rows(spark):
    """Rows within the lateness count, later ones do not; ids are text, some users null."""
    from datetime import timedelta

    from tests.test_ordered import START

    def at(minute):
        return START + timedelta(minutes=minute)

    batches = [
        [("a", at(60), "u1", "t"), ("b", at(62), "u2", "t"), ("n", at(63), None, "t"), ("z", at(60), "u1", None), ("x", at(60), "u1", "s"), ("y", at(62), "u2", "s")],
        [("c", at(95), "u4", "t")],
        [("d", at(64), "u3", "t"), ("e", at(64), "u3", "other")],  # 31 minutes late
        [("f", at(300), "u1", "t")],
        [("g", at(64), "u3", "s"), ("h", at(301), "u2", "t"), ("i", at(302), None, "t"), ("j", at(303), "u3", "t")],
    ]
    out = scratch_dir(spark, "test-late")
    for rows in batches:
        spark.createDataFrame(rows, TEXT_IDS).coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(TEXT_IDS).parquet(f"{out}/in")
        jobs.stream_pile_on(stream, out, late="40 minutes").awaitTermination()
    got = sorted((r["target_id"], r["event_id"], r["user_id"]) for r in spark.read.parquet(f"{out}/pile_on").collect())
    assert got == [("t", "d", "u3"), ("t", "j", "u3")]


def test_validate_stream_splits_rows(spark):
    out = scratch_dir(spark, "test-validate")
    df = spark.createDataFrame([(i, line[0]) for i, line in enumerate(LINES)], "i int, j string")
    for half in (df.where("i < 10"), df.where("i >= 10")):
        half.coalesce(1).write.mode("append").json(f"{out}/in")
        stream = spark.readStream.schema("i int, j string").json(f"{out}/in")
        jobs.stream_validate(stream, "j", out).awaitTermination()
    valid = {r["i"] for r in spark.read.parquet(f"{out}/valid").collect()}
    quarantine = {r["i"] for r in spark.read.parquet(f"{out}/quarantine").collect()}
    assert valid == {i for i, line in enumerate(LINES) if not line[1]}
    assert quarantine == {i for i, line in enumerate(LINES) if line[1]}


def _count(spark, out, rows=None, trigger=jobs.AVAILABLE):
    schema = "bucket string, flagged boolean"
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    return jobs.stream_bucket_counts(stream, "bucket", "flagged", out, trigger)


def _counts(spark, out):
    rows = jobs.latest_counts(spark.read.parquet(f"{out}/counts")).collect()
    return {r["bucket"]: (r["n_rows"], r["n_flagged"]) for r in rows}


BATCHES = ([("a", True), ("b", False)], [("a", False), (None, True)], [("c", True)], [("a", True)])


def test_bucket_counts_follow_the_stream(spark):
    out = scratch_dir(spark, "test-counts")
    for rows in BATCHES:
        _count(spark, out, rows).awaitTermination()
    assert _counts(spark, out) == {"a": (3, 2), "b": (1, 0), "c": (1, 1), None: (1, 1)}
    kept = sorted(p.name for p in Path(f"{out}/counts").iterdir())
    assert kept == ["batch=2", "batch=3"]  # the folder does not grow with the stream


def test_a_batch_that_is_tried_again_counts_once(spark):
    """The last batch is done but not committed when the query stops: it comes again with its id."""
    out = scratch_dir(spark, "test-again")
    for rows in BATCHES:
        _count(spark, out, rows).awaitTermination()
    before = _counts(spark, out)
    commits = Path(f"{out}/_checkpoint/commits")
    for name in ("3", ".3.crc"):
        (commits / name).unlink(missing_ok=True)
    again = _count(spark, out)
    again.awaitTermination()
    assert [p["batchId"] for p in again.recentProgress if p["numInputRows"]] == [3]
    assert _counts(spark, out) == before


def test_counts_of_a_stream_that_runs_on(spark):
    out = scratch_dir(spark, "test-running")
    running = _count(spark, out, BATCHES[0], {"processingTime": "0 seconds"})
    try:
        for rows in BATCHES[1:]:
            spark.createDataFrame(rows, "bucket string, flagged boolean").coalesce(1).write.mode("append").parquet(f"{out}/in")
            running.processAllAvailable()
        assert _counts(spark, out) == {"a": (3, 2), "b": (1, 0), "c": (1, 1), None: (1, 1)}
        assert running.isActive
    finally:
        running.stop()


def test_sessions_stream_writes_closed_sittings(spark):
    rows = sorted(_log(14, n=150, hours=60, step=300), key=lambda r: r[1])
    out = scratch_dir(spark, "test-sittings")
    _feed(spark, rows, f"{out}/in", [range(75), range(75, 150)])
    jobs.stream_sessions(_stream(spark, f"{out}/in"), "user_id", out).awaitTermination()
    got = spark.read.parquet(f"{out}/sittings")
    whole = _df(spark, rows).groupBy("user_id", F.session_window("ts", "90 minutes").alias("w")).agg(
        F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events")
    ).select("user_id", F.col("w.start").alias("started_at"), "ended_at", "n_events")
    end = max(r[1] for r in rows).replace(tzinfo=None).isoformat(sep=" ")
    closed = whole.where(
        F.col("ended_at") + F.expr("INTERVAL 90 MINUTES") <= F.lit(end).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    )
    assert closed.count() > 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


