import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import times
from tidewarden.operators import sessions

NOW = datetime(2026, 1, 5, 12, 0)


def _now():
    return F.lit("2026-01-05 12:00:00").cast("timestamp")


def _sessions(spark, rows):
    """Sessions with defaults; every row gives what differs."""
    base = {
        "session_id": "s",
        "rule_set_slug": "a",
        "target_n": 15,
        "n_completed": 0,
        "cursor": 0,
        "skips_used": 0,
        "seed": 1,
        "started_at": NOW,
        "last_activity_at": NOW,
        "ended_at": None,
        "ended_reason": None,
        "warned_25min": False,
        "dev_mode": False,
    }
    return spark.createDataFrame([{**base, **r} for r in rows], C.SESSION)


@pytest.mark.parametrize("minutes, warn, stop", [(24, False, False), (25, False, False), (25.1, True, False), (30, True, False), (30.1, True, True)])
def test_cap_flags_are_strict(spark, minutes, warn, stop):
    df = _sessions(spark, [{"started_at": NOW - timedelta(minutes=minutes)}])
    row = sessions.cap_flags(df, _now()).first()
    assert (row["warn"], row["stop"]) == (warn, stop)
    assert row["elapsed_minutes"] == pytest.approx(minutes)


def test_cooldown_remaining(spark):
    ends = [NOW - timedelta(minutes=m) for m in (30, 90, 120)] + [None]
    df = _sessions(spark, [{"session_id": str(i), "ended_at": e} for i, e in enumerate(ends)])
    got = sessions.with_cooldown(df, _now()).orderBy("session_id").collect()
    assert [r["cooldown_minutes"] for r in got] == [60.0, 0.0, 0.0, 0.0]


def test_cooldown_breaches(spark):
    def at(minutes):
        return NOW + timedelta(minutes=minutes)

    rows = [
        {"session_id": "1", "started_at": at(0), "ended_at": at(20)},
        {"session_id": "2", "started_at": at(109), "ended_at": at(120)},
        {"session_id": "3", "started_at": at(150), "ended_at": at(160), "dev_mode": True},
        {"session_id": "4", "started_at": at(210), "ended_at": None},
        {"session_id": "5", "started_at": at(220), "ended_at": None},
    ]
    df = _sessions(spark, rows).withColumn("auditor", F.lit("x"))
    got = sessions.cooldown_breaches(df, ["auditor"]).collect()
    assert [(r["session_id"], r["previous_session_id"], r["rested_minutes"]) for r in got] == [
        ("2", "1", 89.0)
    ]


@pytest.mark.parametrize("parts", [1, 9, None])
def test_rest_counts_from_the_latest_end_of_all(spark, parts):
    """Long sessions that outlast later ones, open ones, several auditors, ties and ranges."""
    rng = random.Random(4)
    rows = []
    for i in range(150):
        start = NOW + timedelta(minutes=rng.randrange(4000))
        active = start + timedelta(minutes=rng.choice([0, 5, 20, 300]))
        rows.append({"session_id": f"{i:03}", "rule_set_slug": rng.choice("xxy"), "started_at": start, "last_activity_at": active, "ended_at": rng.choice([None, active]), "dev_mode": rng.random() < 0.1})
    df = _sessions(spark, rows).withColumn("auditor", F.col("rule_set_slug"))
    wanted = set()
    for who in "xy":
        mine = sorted((r["started_at"], r["session_id"], r["ended_at"] or r["last_activity_at"]) for r in rows if r["rule_set_slug"] == who and not r["dev_mode"])
        for i, (start, sid, _) in enumerate(mine):
            if i:
                end, last = max((e, s) for _, s, e in mine[:i])
                if (start - end).total_seconds() < 90 * 60:
                    wanted.add((sid, last, (start - end).total_seconds() / 60))
    got = sessions.cooldown_breaches(df, ["auditor"], parts).collect()
    assert wanted and {(r["session_id"], r["previous_session_id"], r["rested_minutes"]) for r in got} == wanted


def test_is_resumable(spark):
    rows = [
        {"session_id": "open", "n_completed": 3},
        {"session_id": "ended", "ended_at": NOW},
        {"session_id": "done", "n_completed": 15},
        {"session_id": "other", "rule_set_slug": "b"},
    ]
    df = _sessions(spark, rows).where(sessions.is_resumable("a"))
    assert [r["session_id"] for r in df.collect()] == ["open"]


def test_close_abandoned(spark):
    last = NOW - timedelta(minutes=5)
    rows = [
        {"session_id": "1", "last_activity_at": last},
        {"session_id": "2", "ended_at": NOW, "ended_reason": "time_cap"},
    ]
    got = sessions.close_abandoned(_sessions(spark, rows), F.lit(True)).orderBy("session_id").collect()
    assert [(r["ended_at"], r["ended_reason"]) for r in got] == [(last, "abandoned"), (NOW, "time_cap")]


@pytest.mark.parametrize(
    "state, action, minutes, wanted",
    [
        ({"n_completed": 15, "cursor": 20}, "judge", 40, "target_reached"),
        ({"skips_used": 4, "cursor": 20}, "skip", 40, "skip_limit"),
        ({"skips_used": 3}, "skip", 10, None),
        ({"cursor": 20}, "quit", 40, "user_quit"),
        ({"cursor": 20}, "judge", 40, "candidates_exhausted"),
        ({"cursor": 19}, "judge", 31, "time_cap"),
        ({"cursor": 19}, "judge", 30, None),
    ],
)
def test_end_reason(spark, state, action, minutes, wanted):
    reason = sessions.end_reason(F.lit(20), F.lit(action), F.lit(minutes))
    assert _sessions(spark, [state]).select(reason).first()[0] == wanted


def test_skip_breach_is_the_fourth_skip(spark):
    log = [(1, NOW + timedelta(minutes=i), i, "skip") for i in range(6)]
    log += [(2, NOW + timedelta(minutes=i), 10 + i, "skip") for i in range(3)]
    df = spark.createDataFrame(log, "session int, ts timestamp, event_id int, action string")
    got = sessions.skip_breaches(df, ["session"], F.col("action") == "skip").collect()
    assert [(r["session"], r["event_id"], r["skips_used"]) for r in got] == [(1, 3, 4)]


def test_progress_counts_actions(spark):
    log = [(1, NOW + timedelta(minutes=i), a) for i, a in enumerate(["judge", "skip", "discard", "judge", "idle"])]
    df = spark.createDataFrame(log, "session int, ts timestamp, action string")
    row = sessions.session_progress(df, ["session"], 2).first()
    assert (row["n_completed"], row["skips_used"], row["cursor"], row["done"]) == (2, 1, 4, True)


def test_latest_session(spark):
    rows = [{"session_id": str(i), "last_activity_at": NOW + timedelta(minutes=m)} for i, m in enumerate([5, 9, 7])]
    df = _sessions(spark, rows).withColumn("auditor", F.lit("x"))
    assert sessions.latest_session(df, ["auditor"], "last_activity_at").first()["session_id"] == "1"


def test_late_evening_uses_the_auditors_zone(spark):
    rows = [{"session_id": "1", "started_at": datetime(2026, 1, 5, 19, 30)}]
    df = _sessions(spark, rows)
    assert sessions.late_evening(df, "UTC").count() == 0
    assert sessions.late_evening(df, "+01:00").first()["local_hour"] == 20


def test_weeks_without_rest(spark):
    monday = datetime(2026, 1, 5, 10)
    full = [("a", monday + timedelta(days=i)) for i in range(7)]
    shifted = [("b", monday + timedelta(days=3 + i)) for i in range(7)]
    df = spark.createDataFrame(full + shifted, "who string, started_at timestamp")
    got = sessions.weeks_without_rest(df, ["who"], "UTC").collect()
    assert [(r["who"], str(r["week"])) for r in got] == [("a", "2026-01-05")]


def test_iso_utc(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 5, 9, 8, 7, 999999),)], "t timestamp")
    assert df.select(times.iso_utc(F.col("t"))).first()[0] == "2026-01-05T09:08:07Z"


def _played(session, actions, later, cap=30, warn=25):
    """A session walked through as the tool does it: minutes of each action, in order."""
    state = {"n_completed": 0, "skips_used": 0, "cursor": 0}
    active, warned, done = 0.0, False, 0

    def at_top(now):
        if state["n_completed"] >= session["target_n"]:
            return "target_reached"
        if state["cursor"] >= session["n_candidates"]:
            return "candidates_exhausted"
        return "time_cap" if now > cap else None

    now, reason = 0.0, at_top(0.0)
    if reason is None:
        for now, action in actions:
            done += 1
            if action == "quit":
                reason = "user_quit"
            elif action == "skip":
                state["skips_used"] += 1
                state["cursor"] += 1
                reason = "skip_limit" if state["skips_used"] > 3 else None
            elif action in ("judge", "discard"):
                state["cursor"] += 1
                state["n_completed"] += action == "judge"
            if action in ("judge", "skip", "discard", "resume"):
                active = now
            reason = reason or at_top(now)
            if reason:
                break
            warned = warned or now > warn
    if reason:
        end, active = now, now
    else:
        reason, end = ("abandoned", active) if later else (None, None)
    return (*state.values(), active, end, reason, warned, len(actions) - done)


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 11), (3, None)])
def test_replay_walks_through_every_session(spark, seed, parts):
    rng = random.Random(seed)
    every, log, wanted = [], [], {}
    for i in range(60):
        n = rng.choice([0, 1, 4, 9, 30])
        ticks = sorted(rng.choice([5, 24.9, 25, 25.1, 29, 30, 30.1, 31, 40, rng.randrange(60)]) for _ in range(n))
        actions = [(t, rng.choice(["judge"] * 4 + ["skip", "skip", "discard", "quit", "resume", "x", None])) for t in ticks]
        session = {"session_id": f"s{i:02}", "auditor": f"a{i % 7}", "started_at": NOW + timedelta(days=i), "target_n": rng.choice([0, 1, 3, 15]), "n_candidates": rng.choice([0, 3, 8, 50])}
        every.append(session)
        log += [(session["session_id"], session["started_at"] + timedelta(minutes=t), k, a) for k, (t, a) in enumerate(actions)]
        wanted[session["session_id"]] = _played(session, actions, later=i + 7 < 60)
    sessions_df = spark.createDataFrame(every, "session_id string, auditor string, started_at timestamp, target_n int, n_candidates int")
    log_df = spark.createDataFrame(log, "session_id string, ts timestamp, event_id int, action string")
    got = sessions.replay(sessions_df, log_df, ["session_id"], ["auditor"], parts=parts).collect()
    assert {r["session_id"] for r in got} == set(wanted)
    assert {w[5] for w in wanted.values()} >= {"target_reached", "candidates_exhausted", "time_cap", "user_quit", "abandoned"}
    for r in got:
        minutes = [None if t is None else (t - r["started_at"]).total_seconds() / 60 for t in (r["last_activity_at"], r["ended_at"])]
        mine = (r["n_completed"], r["skips_used"], r["cursor"], minutes[0], minutes[1], r["ended_reason"], r["warned_25min"], r["n_ignored"])
        assert mine == pytest.approx(wanted[r["session_id"]]), r["session_id"]


def test_an_abandoned_session_starts_the_rest(spark):
    """The end that replay gives an abandoned session is the one the next session must wait for."""
    rows = [("a", NOW), ("b", NOW + timedelta(minutes=100))]
    df = spark.createDataFrame([(s, "x", t, 5, 9) for s, t in rows], "session_id string, auditor string, started_at timestamp, target_n int, n_candidates int")
    log = spark.createDataFrame([("a", NOW + timedelta(minutes=20), 1, "judge")], "session_id string, ts timestamp, event_id int, action string")
    played = sessions.replay(df, log, ["session_id"], ["auditor"]).withColumn("dev_mode", F.lit(False))
    assert {r["session_id"]: r["ended_reason"] for r in played.collect()} == {"a": "abandoned", "b": None}
    got = sessions.cooldown_breaches(played, ["auditor"]).collect()
    assert [(r["session_id"], r["rested_minutes"]) for r in got] == [("b", 80.0)]


def test_evenings_in_a_zone_with_summer_time(spark):
    """The clocks of the zone change at the end of March: the same instant is another hour."""
    starts = [datetime(2026, 3, 28, 18, 30), datetime(2026, 3, 28, 19, 30), datetime(2026, 3, 29, 18, 30), datetime(2026, 3, 29, 17, 59)]
    df = _sessions(spark, [{"session_id": str(i), "started_at": s} for i, s in enumerate(starts)])
    got = {r["session_id"]: r["local_hour"] for r in sessions.late_evening(df, "Europe/Berlin").collect()}
    assert got == {"1": 20, "2": 20}
    days = [datetime(2026, 3, 22, 23, 30) + timedelta(days=i) for i in range(7)]
    week = _sessions(spark, [{"session_id": str(i), "started_at": s} for i, s in enumerate(days)]).withColumn("auditor", F.lit("x"))
    found = sessions.weeks_without_rest(week, ["auditor"], "Europe/Berlin").collect()
    assert [(r["auditor"], str(r["week"]), r["n_days"]) for r in found] == [("x", "2026-03-23", 7)]
