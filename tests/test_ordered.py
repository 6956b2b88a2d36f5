"""Neighbours, runs and signals against brute force, with one key that holds most rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import ordered, sessions, signals

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "event_id int, ts timestamp, user_id int, target_id int, text string, flag boolean"


def _log(seed, n=400, hours=30, step=60):
    """Random messages; user 0 and target 0 hold most of them, many at the same instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=step * rng.randrange(hours * 3600 // step))
        user = rng.choice([0, 0, 0, 1, 2, 3, 4])
        target = rng.choice([0, 0, 0, 1])
        rows.append((i, at, user, target, rng.choice("ab"), rng.random() < 0.6))
    return rows


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _runs(rows, same):
    """Runs per user by walking over its rows in order."""
    found = []
    for user in sorted({r[2] for r in rows}):
        run = []
        for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if run and not same(run[-1], r):
                found.append((user, run))
                run = []
            run.append(r)
        if run:
            found.append((user, run))
    return found


CUTS = [(1, 1), (2, 5), (3, 40), (4, None)]


@pytest.mark.parametrize("seed, parts", CUTS)
def test_previous_crosses_ranges(spark, seed, parts):
    rows = _log(seed)
    got = ordered.with_previous(
        _df(spark, rows), ["user_id"], ["ts", "event_id"], ["event_id"], parts
    )
    found = {r["event_id"]: r["previous"] and r["previous"]["event_id"] for r in got.collect()}
    wanted = {}
    for user in range(5):
        mine = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))
        for before, row in zip([None, *mine], mine):
            wanted[row[0]] = before and before[0]
    assert found == wanted


@pytest.mark.parametrize("seed, parts", CUTS)
def test_value_runs_cross_ranges(spark, seed, parts):
    rows = _log(seed)
    got = ordered.runs(
        _df(spark, rows), ["user_id"], "ts", "event_id", "text", lambda _, a, __, b: a == b, parts
    )
    wanted = sorted(
        (u, run[0][4], run[0][1].replace(tzinfo=None), run[-1][1].replace(tzinfo=None), len(run))
        for u, run in _runs(rows, lambda a, b: a[4] == b[4])
    )
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_one_run_over_all_ranges(spark):
    """A run that is longer than a range, between two keys that end and begin in its ranges."""
    rows = [(i, START + timedelta(seconds=i), 0 if i < 7 else 1 if i < 290 else 2, 0, "a", True) for i in range(300)]
    got = ordered.runs(
        _df(spark, rows), ["user_id"], "ts", "event_id", "text", lambda _, a, __, b: a == b, 30
    )
    assert sorted((r["user_id"], r["n_rows"]) for r in got.collect()) == [(0, 7), (1, 283), (2, 10)]


def test_null_keys_and_times(spark):
    rows = [(i, START if i % 3 else None, None if i % 2 else 1, 0, "a", True) for i in range(24)]
    got = ordered.with_previous(
        _df(spark, rows), ["user_id"], ["ts", "event_id"], ["event_id"], 6
    )
    found = {r["event_id"]: r["previous"] and r["previous"]["event_id"] for r in got.collect()}
    wanted = {}
    for user in (None, 1):
        mine = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is not None, r[0]))
        for before, row in zip([None, *mine], mine):
            wanted[row[0]] = before and before[0]
    assert found == wanted
    empty = _df(spark, rows).where("false")
    assert ordered.with_previous(empty, ["user_id"], ["ts"], ["ts"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7, None])
def test_scans_equal_plain_folds(spark, parts):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, *range(-5, 9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, v int")
    top = ordered.with_scan(df, ["i"], F.col("v"), "top", parts=parts)
    total = ordered.with_scan(df, ["i"], F.col("v"), "total", "sum", inclusive=True, parts=parts)
    tops = {r["i"]: r["top"] for r in top.collect()}
    totals = {r["i"]: r["total"] for r in total.collect()}
    for i, _ in rows:
        known = [v for _, v in rows[:i] if v is not None]
        assert tops[i] == max(known, default=None)
        assert totals[i] == sum(v or 0 for _, v in rows[: i + 1])


def test_a_key_with_a_third_of_the_rows_spreads(spark):
    """No range holds three times the rows of the median one, and each is a task."""
    rows = [(i, START + timedelta(seconds=i // 50), 0 if i % 3 else i, 0, "a", True) for i in range(9000)]
    sizes = [r["n"] for r in ordered.placed(_df(spark, rows), ["user_id", "ts", "event_id"], 30).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 25 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("seed, n", [(4, 200), (5, 400), (6, 30)])
def test_sittings_equal_session_windows(spark, seed, n):
    df = _df(spark, _log(seed, n=n, hours=200, step=900))
    got = sessions.infer_sessions(df, ["user_id"], "ts", "event_id")
    windows = df.groupBy("user_id", F.session_window("ts", "90 minutes").alias("w")).agg(
        F.max("ts").alias("e"), F.count(F.lit(1)).alias("n")
    )
    wanted = windows.select("user_id", F.col("w.start").alias("s"), "e", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_streaks_and_off_topic_runs(spark):
    rows = _log(6)
    df = _df(spark, rows)
    streaks = signals.repeat_streak(df, ["user_id"], "text")
    wanted = sorted(len(r) for _, r in _runs(rows, lambda a, b: a[4] == b[4]) if len(r) >= 3)
    assert sorted(r["n_rows"] for r in streaks.collect()) == wanted
    off = signals.off_topic_run(df, ["user_id"], "flag")
    flagged = _runs(rows, lambda a, b: a[5] == b[5])
    wanted = sorted(len(r) for _, r in flagged if r[0][5] and len(r) > 5)
    assert wanted and sorted(r["n_rows"] for r in off.collect()) == wanted


def _piled(rows, users=3, minutes=10):
    found = {}
    for r in rows:
        near = {
            o[2]
            for o in rows
            if o[3] == r[3] and r[1] - timedelta(minutes=minutes) <= o[1] <= r[1]
        }
        if len(near) >= users:
            found[r[0]] = len(near)
    return found


@pytest.mark.parametrize("seed, parts", [(7, 1), (8, 9), (9, None)])
def test_pile_on_equals_brute_force(spark, seed, parts):
    rows = _log(seed, n=300, hours=8)
    got = signals.pile_on(_df(spark, rows), parts=parts)
    wanted = _piled(rows)
    assert wanted and {r["event_id"]: r["n_users"] for r in got.collect()} == wanted


def test_pile_on_in_one_hour_and_at_one_instant(spark):
    """A third of the log hits one target within an hour, much of it at the same second."""
    rng = random.Random(3)
    rows = [(i, START + timedelta(seconds=rng.choice([600, 600, rng.randrange(3600)])), rng.randrange(9), 0, "a", True) for i in range(150)]
    rows += [(150 + i, START + timedelta(minutes=rng.randrange(5000)), rng.randrange(9), 1 + i % 5, "a", True) for i in range(300)]
    rows += [(450 + i, START + timedelta(seconds=600), None, 0, "a", True) for i in range(2)]
    rows += [(460, START, 1, None, "a", True), (461, START, 2, None, "a", True), (462, START, 3, None, "a", True)]
    got = {r["event_id"]: r["n_users"] for r in signals.pile_on(_df(spark, rows), parts=12).collect()}
    known = [r for r in rows if r[3] is not None]
    near = {r[0]: len({o[2] for o in known if o[3] == r[3] and o[2] is not None and r[1] - timedelta(minutes=10) <= o[1] <= r[1]}) for r in known}
    assert got == {i: n for i, n in near.items() if n >= 3}


def test_pile_on_window_is_closed(spark):
    def at(seconds):
        return START + timedelta(seconds=3600 + seconds)

    def messages(last):
        return [(i, at(s), i, 0, "a", False) for i, s in enumerate([0, 60, last])]

    assert [r["event_id"] for r in signals.pile_on(_df(spark, messages(600))).collect()] == [2]
    assert signals.pile_on(_df(spark, messages(601))).count() == 0


def test_pile_on_needs_distinct_users(spark):
    rows = [(i, START + timedelta(seconds=i), i % 2, 0, "a", False) for i in range(50)]
    assert signals.pile_on(_df(spark, rows)).count() == 0


def test_continued_after_stop(spark):
    """9 asks 1 to stop: what 1 sends to 9 from then on counts, whoever else writes."""
    rows = [
        (0, START, 1, 9, "hi", False),
        (1, START + timedelta(minutes=1), 9, 1, "stop", True),
        (2, START + timedelta(minutes=1), 1, 9, "hi", False),
        (3, START + timedelta(minutes=2), 1, 9, "hi", False),
        (4, START + timedelta(minutes=3), 2, 9, "hi", False),
        (5, START + timedelta(minutes=3), 1, 8, "hi", False),
        (6, START + timedelta(minutes=4), 9, 1, "hi", False),
        (7, START + timedelta(minutes=5), 9, 1, "stop", True),
        (8, START + timedelta(minutes=6), 1, 9, "sorry", False),
        (9, START + timedelta(minutes=7), None, None, "hi", False),
    ]
    df = _df(spark, rows).withColumn("is_stop", F.col("flag"))
    assert sorted(r["event_id"] for r in signals.continued_after_stop(df).collect()) == [3, 8]


def test_once_per_week_bound_is_open(spark):
    days = [0, 7, 13.99, 30]
    rows = [(i, START + timedelta(days=d), 1, 0, "ad", True) for i, d in enumerate(days)]
    got = signals.once_per_week(_df(spark, rows), ["user_id"], F.col("flag"))
    assert [r["event_id"] for r in got.collect()] == [2]


def test_repeats_in_and_across(spark):
    df = spark.createDataFrame(
        [(1, "a\na\na", "t1"), (2, "a\na", "t1"), (3, "x", "t1"), (4, "x", "t2"), (5, "x", "t2")]
        + [(i, t, "t1") for i in range(6, 9) for t in ("one thread", None, "")]
        + [(i, t, f"t{i}") for i in range(9, 12) for t in (None, "")],
        "i int, text string, thread string",
    )
    assert [r["i"] for r in signals.repeat_in_message(df, "text").collect()] == [1]
    found = signals.repeat_across_threads(df, "text", "thread").collect()
    assert [(r["n_posts"], r["n_threads"]) for r in found] == [(3, 2)]
