"""Session discipline, as queries over a table of sessions or a log of actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden import contracts as C
from tidewarden.functions import times
from tidewarden.operators import ordered


def cap_flags(sessions: DataFrame, now: Column) -> DataFrame:
    """Elapsed minutes, and whether they are past the warning and past the cap."""
    elapsed = times.elapsed_minutes(F.col("started_at"), now)
    return sessions.withColumn("elapsed_minutes", elapsed).withColumns(
        {
            "warn": F.col("elapsed_minutes") > C.SESSION_WARN_MINUTES,
            "stop": F.col("elapsed_minutes") > C.SESSION_CAP_MINUTES,
        }
    )


def with_cooldown(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.withColumn(
        "cooldown_minutes", times.cooldown_remaining(F.col("ended_at"), now)
    )


def drop_dev_rows(rows: DataFrame) -> DataFrame:
    """Practice rows are kept apart and never count."""
    return rows.where(~F.col("dev_mode"))


def cooldown_breaches(
    sessions: DataFrame, auditor: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Real sessions begun before the rest after the auditor's last end was over.

    What counts is the latest end among all sessions begun before, not the one begun last. A
    session still open when the next one begins was given up: it ended at its last activity.
    """
    ended = F.coalesce("ended_at", "last_activity_at")
    chained = ordered.with_greatest_before(
        drop_dev_rows(sessions).withColumn("_ended", ended),
        auditor,
        ["started_at", "session_id"],
        ["_ended", "session_id"],
        "previous",
        parts,
    )
    rested = times.minutes_between(F.col("previous._ended"), F.col("started_at"))
    return (
        chained.withColumn("previous_session_id", F.col("previous.session_id"))
        .withColumn("rested_minutes", rested)
        .where(F.col("rested_minutes") < C.COOLDOWN_MINUTES)
        .drop("previous", "_ended")
    )


def skip_breaches(log: DataFrame, session: Sequence[str], skip: Column) -> DataFrame:
    """Sessions with more skips than allowed, and the skip that should have ended them.

    The bound on the rank is constant, so tasks keep only the first few skips of a session.
    """
    rank = F.row_number().over(Window.partitionBy(*session).orderBy("ts", "event_id"))
    return (
        log.where(skip)
        .select(*session, "ts", "event_id", rank.alias("skips_used"))
        .where(F.col("skips_used") <= C.MAX_SKIPS + 1)
        .where(F.col("skips_used") == C.MAX_SKIPS + 1)
    )


def is_resumable(slug: Column | str) -> Column:
    slug = F.lit(slug) if isinstance(slug, str) else slug
    return (
        F.col("ended_at").isNull()
        & (F.col("n_completed") < F.col("target_n"))
        & (F.col("rule_set_slug") == slug)
    )


def close_abandoned(sessions: DataFrame, abandoned: Column) -> DataFrame:
    """Open sessions given up for another one end at their last activity."""
    closing = abandoned & F.col("ended_at").isNull()
    return sessions.withColumns(
        {
            "ended_reason": F.when(closing, "abandoned").otherwise(F.col("ended_reason")),
            "ended_at": F.when(closing, F.col("last_activity_at")).otherwise(F.col("ended_at")),
        }
    )


def end_reason(n_candidates: Column, last_action: Column, elapsed: Column) -> Column:
    """Why a session ended, from its final state; null while it is still open.

    A quit or a skip too many ends the session at once, so both go before the checks that come
    with the next candidate.
    """
    return (
        F.when(F.col("n_completed") >= F.col("target_n"), "target_reached")
        .when(F.col("skips_used") > C.MAX_SKIPS, "skip_limit")
        .when(last_action == "quit", "user_quit")
        .when(F.col("cursor") >= n_candidates, "candidates_exhausted")
        .when(elapsed > C.SESSION_CAP_MINUTES, "time_cap")
    )


def end_reason_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("ended_reason").agg(F.count(F.lit(1)).alias("n_sessions"))


def session_progress(log: DataFrame, session: Sequence[str], target_n: int) -> DataFrame:
    """Completed judgments, skips and cursor of each session, from its log of actions."""
    action = F.col("action")
    return (
        log.groupBy(*session)
        .agg(
            F.count_if(action == "judge").cast("int").alias("n_completed"),
            F.count_if(action == "skip").cast("int").alias("skips_used"),
            F.count_if(action.isin("judge", "skip", "discard")).cast("int").alias("cursor"),
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_activity_at"),
        )
        .withColumn("target_n", F.lit(target_n))
        .withColumn("done", F.col("n_completed") >= F.col("target_n"))
    )


ACTIONS = ("judge", "skip", "discard", "quit", "resume")
_COUNTED = ("n_completed", "skips_used", "cursor")


def replay(
    sessions: DataFrame,
    log: DataFrame,
    session: Sequence[str],
    auditor: Sequence[str],
    cap_minutes: float = C.SESSION_CAP_MINUTES,
    warn_minutes: float = C.SESSION_WARN_MINUTES,
    parts: int | None = None,
) -> DataFrame:
    """The final state of each session, from what was done in it.

    `sessions` has the session columns, `auditor`, started_at, target_n and n_candidates; `log` has
    the session columns, ts, event_id and an action: judge, skip, discard, quit or resume. Other
    actions are no answer, but time passes. After every action, and at the start, a session ends
    for the first of these reasons that holds: a quit, a skip too many, the target reached, the
    candidates used up, the time cap passed. What the log has after the end is counted in
    `n_ignored` and changes nothing. A session still open when a later one of its auditor has
    begun was abandoned: it ended at its last activity.

    The counts are sums over ranges of the log, so a session may have any number of actions.
    """
    action, start = F.col("action"), F.col("_at_start")
    moves = {
        "n_completed": action == "judge",
        "skips_used": action == "skip",
        "cursor": action.isin("judge", "skip", "discard"),
    }
    steps = log.where(F.col("ts").isNotNull()).select(
        *session,
        F.lit(1).alias("_kind"),
        F.col("ts").cast("timestamp").alias("_ts"),
        "event_id",
        "action",
        *[F.coalesce(m, F.lit(False)).cast("bigint").alias(f"_{c}") for c, m in moves.items()],
    )
    # A first row per session, before its actions, and a last one that takes its sums back to zero.
    facts = sessions.select(
        *session,
        F.col("started_at").cast("timestamp").alias("_start"),
        F.col("target_n").alias("_target"),
        F.col("n_candidates").alias("_candidates"),
    )
    first = facts.select(*session, F.lit(0).alias("_kind"), F.col("_start").alias("_ts"))
    last = steps.groupBy(*session).agg(
        F.lit(2).alias("_kind"), *[(-F.sum(f"_{c}")).alias(f"_{c}") for c in _COUNTED]
    )
    line = steps.unionByName(first, allowMissingColumns=True)
    line = line.unionByName(last, allowMissingColumns=True)
    order = [*session, "_kind", "_ts", "event_id"]
    sums = {c: F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in _COUNTED}
    counted = ordered.with_scans(line, order, sums, "sum", inclusive=True, parts=parts)
    seen = counted.where("_kind < 2").drop(*[f"_{c}" for c in _COUNTED])
    seen = seen.join(facts, list(session)).withColumn("_at_start", F.col("_kind") == 0)
    elapsed = times.elapsed_minutes(F.col("_start"), F.col("_ts"))
    reason = (
        F.when(~start & (action == "quit"), "user_quit")
        .when(~start & (action == "skip") & (F.col("skips_used") > C.MAX_SKIPS), "skip_limit")
        .when(F.col("n_completed") >= F.col("_target"), "target_reached")
        .when(F.col("cursor") >= F.col("_candidates"), "candidates_exhausted")
        .when(elapsed > cap_minutes, "time_cap")
    )
    seen = seen.withColumn("_reason", reason).withColumn("_warn", elapsed > warn_minutes)
    place = F.struct("_kind", "_ts", "event_id")
    # The state after an action, or before the first one.
    state = F.struct(*[F.col(c).cast("int").alias(c) for c in _COUNTED], F.col("_ts").alias("at"))
    ended = F.when(F.col("_reason").isNotNull(), place)
    ends = seen.groupBy(*session).agg(
        F.min(ended).alias("_end"),
        F.min_by(F.struct("_reason", state.alias("state")), ended).alias("_ended"),
    )
    inside = seen.join(ends, list(session)).withColumn("_place", place)
    inside = inside.withColumn("_counts", F.col("_end").isNull() | (F.col("_place") <= F.col("_end")))
    moved = F.col("_counts") & (F.col("_at_start") | action.isin("judge", "skip", "discard", "resume"))
    before_end = F.col("_counts") & (F.col("_end").isNull() | (F.col("_place") < F.col("_end")))
    final = inside.groupBy(*session).agg(
        F.first("_ended", ignorenulls=True).alias("_ended"),
        F.max_by(state, F.when(F.col("_counts"), F.col("_place"))).alias("_state"),
        F.max(F.when(moved, F.col("_ts"))).alias("_active"),
        F.max(F.coalesce(before_end & F.col("_warn"), F.lit(False))).alias("warned_25min"),
        F.count_if(~F.col("_counts")).alias("n_ignored"),
    )
    latest = sessions.groupBy(*[F.col(c).alias(f"_of_{c}") for c in auditor]).agg(
        F.max(F.struct(F.col("started_at"), *session)).alias("_latest")
    )
    same = F.lit(True)
    for c in auditor:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    superseded = F.struct(F.col("started_at"), *session) < F.col("_latest")
    whole = sessions.join(final, list(session)).join(latest, same)
    closed = F.when(F.col("_ended").isNotNull(), F.col("_ended.state.at")).when(
        superseded, F.col("_active")
    )
    return whole.select(
        *[c for c in sessions.columns if c not in _COUNTED],
        *[F.col("_state")[c].alias(c) for c in _COUNTED],
        F.coalesce("_ended.state.at", "_active").alias("last_activity_at"),
        closed.alias("ended_at"),
        F.coalesce("_ended._reason", F.when(superseded, "abandoned")).alias("ended_reason"),
        "warned_25min",
        "n_ignored",
    )


def latest_session(sessions: DataFrame, by: Sequence[str], modified: str) -> DataFrame:
    """The session written last, per auditor."""
    row = F.struct(*[F.col(c) for c in sessions.columns if c not in by])
    newest = sessions.groupBy(*by).agg(
        F.max_by(row, F.struct(F.col(modified), F.col("session_id"))).alias("row")
    )
    return newest.select(*by, "row.*")


def infer_sessions(
    events: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_minutes: int = C.COOLDOWN_MINUTES
) -> DataFrame:
    """Sittings: events of a key with no break longer than the gap, as session windows give them."""
    sittings = ordered.runs(
        events.withColumn("_one", F.lit(1)),
        keys,
        ts,
        tie,
        "_one",
        lambda earlier, _, later, __: times.minutes_between(earlier, later) <= gap_minutes,
    )
    return sittings.drop("_one").withColumnRenamed("n_rows", "n_events")


def late_evening(sessions: DataFrame, zone: str, from_hour: int = 20) -> DataFrame:
    """Sessions begun in the evening of the auditor's own time zone."""
    local = F.from_utc_timestamp(F.col("started_at").cast("timestamp"), zone)
    return sessions.withColumn("local_hour", F.hour(local)).where(
        F.col("local_hour") >= from_hour
    )


def weeks_without_rest(sessions: DataFrame, auditor: Sequence[str], zone: str) -> DataFrame:
    """Weeks, from Monday, in which an auditor worked on all seven days."""
    local = F.from_utc_timestamp(F.col("started_at").cast("timestamp"), zone)
    return (
        sessions.groupBy(*auditor, F.to_date(F.date_trunc("week", local)).alias("week"))
        .agg(F.count_distinct(F.to_date(local)).alias("n_days"))
        .where(F.col("n_days") == 7)
    )
