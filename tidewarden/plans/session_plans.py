"""Session discipline and behavioural signals over the event log, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import scores, times
from tidewarden.operators import sessions, signals
from tidewarden.plans import views
from tidewarden.plans.label_plans import JSON_ERRORS_SQL, json_labels
from tidewarden.plans.registry import query
from tidewarden.session import scratch_dir
from tidewarden.sources import tables
from tidewarden.streaming import jobs

NOW = "2024-01-31 00:00:00"


def minutes(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / CAST(60000000 AS DOUBLE)"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "cap_flags",
    f"""SELECT session_id, m AS elapsed_minutes, m > 25 AS warn, m > 30 AS stop
        FROM (SELECT session_id, {minutes('started_at', 'last_activity_at')} AS m FROM sessions)""",
    "sessions",
)
def _(spark, d):
    flagged = sessions.cap_flags(views.sessions(spark, d), F.col("last_activity_at"))
    return flagged.select("session_id", "elapsed_minutes", "warn", "stop")


@query(
    "elapsed_minutes",
    f"SELECT session_id, {minutes('started_at', f"TIMESTAMP '{NOW}'")} AS elapsed FROM sessions",
    "sessions",
)
def _(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return views.sessions(spark, d).select(
        "session_id", times.elapsed_minutes(F.col("started_at"), now).alias("elapsed")
    )


@query(
    "cooldown_remaining",
    f"""SELECT session_id, CASE WHEN ended_at IS NULL THEN 0
               ELSE greatest(0, 90 - {minutes('ended_at', f"TIMESTAMP '{NOW}'")}) END
               AS cooldown_minutes
        FROM sessions""",
    "sessions",
)
def _(spark, d):
    now = F.lit(NOW).cast("timestamp")
    return sessions.with_cooldown(views.sessions(spark, d), now).select(
        "session_id", "cooldown_minutes"
    )


@query(
    "cooldown_breaches",
    f"""SELECT session_id, auditor, last_one.id AS previous_session_id, rested_minutes
        FROM (SELECT session_id, auditor, last_one,
                     {minutes('last_one.ended', 'started_at')} AS rested_minutes
              FROM (SELECT session_id, auditor, started_at,
                           max({{'ended': coalesce(ended_at, last_activity_at), 'id': session_id}})
                               OVER (PARTITION BY auditor ORDER BY started_at, session_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_one
                    FROM sessions WHERE NOT dev_mode))
        WHERE rested_minutes < 90""",
    "sessions",
)
def _(spark, d):
    found = sessions.cooldown_breaches(views.sessions(spark, d), ["auditor"])
    return found.select("session_id", "auditor", "previous_session_id", "rested_minutes")


@query(
    "skip_breaches",
    """SELECT auditor, CAST(day AS VARCHAR) AS day, event_id, CAST(rn AS INTEGER) AS skips_used
       FROM (SELECT *, row_number() OVER (PARTITION BY auditor, day ORDER BY ts, event_id) AS rn
             FROM action_log WHERE action = 'skip') WHERE rn = 4""",
    "action_log",
)
def _(spark, d):
    found = sessions.skip_breaches(
        views.action_log(spark, d), ["auditor", "day"], F.col("action") == "skip"
    )
    return found.select("auditor", F.col("day").cast("string"), "event_id", "skips_used")


@query(
    "is_resumable",
    """SELECT session_id,
              ended_at IS NULL AND n_completed < target_n AND rule_set_slug = 'arena_chat'
              AS resumable
       FROM sessions""",
    "sessions",
)
def _(spark, d):
    return views.sessions(spark, d).select(
        "session_id", sessions.is_resumable("arena_chat").alias("resumable")
    )


@query(
    "close_abandoned",
    f"""SELECT session_id, {iso('last_activity_at')} AS ended_at,
               CASE WHEN ended_at IS NULL THEN 'abandoned' END AS ended_reason
        FROM sessions WHERE rule_set_slug <> 'arena_chat' OR ended_at IS NOT NULL""",
    "sessions",
)
def _(spark, d):
    closed = sessions.close_abandoned(
        views.sessions(spark, d), F.col("rule_set_slug") != "arena_chat"
    )
    return closed.where(F.col("ended_at").isNotNull()).select(
        "session_id", times.iso_utc(F.col("ended_at")).alias("ended_at"), "ended_reason"
    )


_REASON = f"""CASE WHEN n_completed >= target_n THEN 'target_reached'
                   WHEN skips_used > 3 THEN 'skip_limit' WHEN last_action = 'quit' THEN 'user_quit'
                   WHEN cursor >= 12 THEN 'candidates_exhausted'
                   WHEN {minutes('started_at', 'last_activity_at')} > 30 THEN 'time_cap' END"""


@query("end_reason", f"SELECT session_id, {_REASON} AS ended_reason FROM sessions", "sessions")
def _(spark, d):
    elapsed = times.elapsed_minutes(F.col("started_at"), F.col("last_activity_at"))
    reason = sessions.end_reason(F.lit(12), F.col("last_action"), elapsed)
    return views.sessions(spark, d).select("session_id", reason.alias("ended_reason"))


@query(
    "end_reason_counts",
    f"SELECT {_REASON} AS ended_reason, count(*) AS n_sessions FROM sessions GROUP BY 1",
    "sessions",
)
def _(spark, d):
    elapsed = times.elapsed_minutes(F.col("started_at"), F.col("last_activity_at"))
    reason = sessions.end_reason(F.lit(12), F.col("last_action"), elapsed)
    return sessions.end_reason_counts(views.sessions(spark, d).withColumn("ended_reason", reason))


@query(
    "session_progress",
    f"""SELECT auditor, CAST(day AS VARCHAR) AS day,
               CAST(count(*) FILTER (WHERE action = 'judge') AS INTEGER) AS n_completed,
               CAST(count(*) FILTER (WHERE action = 'skip') AS INTEGER) AS skips_used,
               CAST(count(*) AS INTEGER) AS cursor, {iso('min(ts)')} AS started_at,
               {iso('max(ts)')} AS last_activity_at, 2 AS target_n,
               count(*) FILTER (WHERE action = 'judge') >= 2 AS done
        FROM action_log GROUP BY auditor, day""",
    "action_log",
)
def _(spark, d):
    progress = sessions.session_progress(views.action_log(spark, d), ["auditor", "day"], 2)
    shown = {c: times.iso_utc(F.col(c)) for c in ("started_at", "last_activity_at")}
    return progress.withColumns({"day": F.col("day").cast("string"), **shown})


# A day of an auditor is a session of three judgments out of nine candidates, with eight hours.
_DAY_ACTION = """CASE WHEN k % 13 = 0 THEN 'quit' WHEN text IN ('purchase', 'click') THEN 'judge'
                      WHEN text = 'error' OR k % 3 = 0 THEN 'skip' WHEN k % 3 = 1 THEN 'discard'
                      ELSE 'resume' END"""


@query(
    "replay_sessions",
    f"""SELECT * FROM (WITH told AS (
            SELECT user_id AS auditor, CAST(ts AS DATE) AS day, ts, event_id, {_DAY_ACTION} AS action
            FROM messages WHERE user_id IS NOT NULL),
        began AS (SELECT *, min(ts) OVER (PARTITION BY auditor, day) AS started_at FROM told),
        counted AS (
            SELECT *, {minutes('started_at', 'ts')} AS elapsed, row_number() OVER w AS n_done,
                   count(*) FILTER (WHERE action = 'judge') OVER w AS n_completed,
                   count(*) FILTER (WHERE action = 'skip') OVER w AS skips_used,
                   count(*) FILTER (WHERE action IN ('judge', 'skip', 'discard')) OVER w AS cursor
            FROM began WINDOW w AS (PARTITION BY auditor, day ORDER BY ts, event_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        judged_by AS (
            SELECT *, CASE WHEN action = 'quit' THEN 'user_quit'
                           WHEN action = 'skip' AND skips_used > 3 THEN 'skip_limit'
                           WHEN n_completed >= 3 THEN 'target_reached'
                           WHEN cursor >= 9 THEN 'candidates_exhausted'
                           WHEN elapsed > 480 THEN 'time_cap' END AS reason FROM counted),
        marked AS (
            SELECT *, min(CASE WHEN reason IS NOT NULL THEN n_done END)
                          OVER (PARTITION BY auditor, day) AS ends_at,
                   max(day) OVER (PARTITION BY auditor) AS last_day FROM judged_by),
        lived AS (SELECT *, n_done <= coalesce(ends_at, n_done) AS counts FROM marked),
        ended AS (
            SELECT auditor, day, any_value(last_day) AS last_day, min(started_at) AS started_at,
                   max(n_completed) FILTER (WHERE counts) AS n_completed,
                   max(skips_used) FILTER (WHERE counts) AS skips_used,
                   max(cursor) FILTER (WHERE counts) AS cursor,
                   max(ts) FILTER (WHERE counts AND (action <> 'quit')) AS active,
                   max(reason) FILTER (WHERE n_done = ends_at) AS reason,
                   max(ts) FILTER (WHERE n_done = ends_at) AS closed_at,
                   coalesce(bool_or(elapsed > 400)
                                FILTER (WHERE counts AND n_done < coalesce(ends_at, n_done + 1)),
                            false) AS warned,
                   count(*) FILTER (WHERE NOT counts) AS n_ignored
            FROM lived GROUP BY auditor, day)
        SELECT auditor, CAST(day AS VARCHAR) AS day, CAST(n_completed AS INTEGER) AS n_completed,
               CAST(skips_used AS INTEGER) AS skips_used, CAST(cursor AS INTEGER) AS cursor,
               {iso('coalesce(closed_at, active, started_at)')} AS last_activity_at,
               CASE WHEN reason IS NOT NULL THEN {iso('closed_at')}
                    WHEN day < last_day THEN {iso('coalesce(active, started_at)')} END AS ended_at,
               coalesce(reason, CASE WHEN day < last_day THEN 'abandoned' END) AS ended_reason,
               warned AS warned_25min, n_ignored
        FROM ended)""",
    "messages",
)
def _(spark, d):
    log = views.messages(spark, d).where(F.col("user_id").isNotNull())
    log = log.select(
        F.col("user_id").alias("auditor"),
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        F.expr(_DAY_ACTION).alias("action"),
    )
    days = log.groupBy("auditor", "day").agg(F.min("ts").alias("started_at"))
    days = days.withColumns({"target_n": F.lit(3), "n_candidates": F.lit(9)})
    played = sessions.replay(
        days, log, ["auditor", "day"], ["auditor"], cap_minutes=480, warn_minutes=400
    )
    shown = {c: times.iso_utc(F.col(c)) for c in ("last_activity_at", "ended_at")}
    return played.withColumns({"day": F.col("day").cast("string"), **shown}).drop(
        "started_at", "target_n", "n_candidates"
    )


@query(
    "drop_dev_rows", "SELECT session_id, auditor FROM sessions WHERE NOT dev_mode", "sessions"
)
def _(spark, d):
    return sessions.drop_dev_rows(views.sessions(spark, d)).select("session_id", "auditor")


@query(
    "latest_session",
    """SELECT auditor, session_id, n_completed FROM sessions
       QUALIFY row_number() OVER (PARTITION BY auditor
                                  ORDER BY last_activity_at DESC, session_id DESC) = 1""",
    "sessions",
)
def _(spark, d):
    newest = sessions.latest_session(views.sessions(spark, d), ["auditor"], "last_activity_at")
    return newest.select("auditor", "session_id", "n_completed")


_SITTINGS = """
    SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events
    FROM (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
          FROM (SELECT user_id, ts, event_id,
                       CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 5400000000 THEN 0
                            ELSE 1 END AS is_new
                FROM messages WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
    GROUP BY user_id, run"""
_SITTINGS_SHOWN = f"""
    SELECT user_id, {iso('started_at')} AS started_at, {iso('ended_at')} AS ended_at, n_events
    FROM ({_SITTINGS})"""


def _shown(rows):
    return rows.withColumns({c: times.iso_utc(F.col(c)) for c in ("started_at", "ended_at")})


@query("infer_sessions", _SITTINGS_SHOWN, "messages")
def _(spark, d):
    return _shown(
        sessions.infer_sessions(views.messages(spark, d), ["user_id"], "ts", "event_id")
    )


@query(
    "late_evening",
    f"""SELECT user_id, {iso('started_at')} AS started_at, n_events,
               CAST(hour(started_at + INTERVAL 2 HOUR) AS INTEGER) AS local_hour
        FROM ({_SITTINGS}) WHERE hour(started_at + INTERVAL 2 HOUR) >= 20""",
    "messages",
)
def _(spark, d):
    sat = sessions.infer_sessions(views.messages(spark, d), ["user_id"], "ts", "event_id")
    late = sessions.late_evening(sat, "+02:00")
    return late.select(
        "user_id", times.iso_utc(F.col("started_at")).alias("started_at"), "n_events", "local_hour"
    )


@query(
    "weeks_without_rest",
    """SELECT user_id, CAST(CAST(date_trunc('week', ts + INTERVAL 2 HOUR) AS DATE) AS VARCHAR) AS week,
              count(DISTINCT CAST(ts + INTERVAL 2 HOUR AS DATE)) AS n_days
       FROM messages GROUP BY 1, 2
       HAVING count(DISTINCT CAST(ts + INTERVAL 2 HOUR AS DATE)) = 7""",
    "messages",
)
def _(spark, d):
    log = views.messages(spark, d).withColumnRenamed("ts", "started_at")
    found = sessions.weeks_without_rest(log, ["user_id"], "+02:00")
    return found.withColumn("week", F.col("week").cast("string"))


# --- signals ---

_PILE_ON = """
    SELECT target_id, event_id, user_id, n_users FROM (
        SELECT a.target_id, a.event_id, a.user_id,
               CAST(count(DISTINCT b.user_id) AS INTEGER) AS n_users
        FROM messages a JOIN messages b
          ON a.target_id = b.target_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 10 MINUTE
        GROUP BY ALL)
    WHERE n_users >= 3"""


@query("pile_on", _PILE_ON, "messages")
def _(spark, d):
    return signals.pile_on(views.messages(spark, d)).select(
        "target_id", "event_id", "user_id", "n_users"
    )


@query(
    "continued_after_stop",
    """SELECT m.event_id, m.user_id, m.target_id
       FROM messages m JOIN (SELECT user_id, target_id, min(ts) AS at FROM messages WHERE is_stop
                             GROUP BY ALL) s
         ON m.target_id = s.user_id AND m.user_id = s.target_id AND m.ts > s.at
       WHERE NOT m.is_stop""",
    "messages",
)
def _(spark, d):
    return signals.continued_after_stop(views.messages(spark, d)).select(
        "event_id", "user_id", "target_id"
    )


_RUNS = """
    SELECT user_id, {value}, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_rows
    FROM (SELECT user_id, {value}, ts,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                 - row_number() OVER (PARTITION BY user_id, {value} ORDER BY ts, event_id) AS island
          FROM messages)
    GROUP BY user_id, {value}, island"""


@query(
    "repeat_streak",
    f"""SELECT user_id, text, {iso('started_at')} AS started_at, {iso('ended_at')} AS ended_at,
               n_rows
        FROM ({_RUNS.format(value='text')}) WHERE n_rows >= 3""",
    "messages",
)
def _(spark, d):
    return _shown(signals.repeat_streak(views.messages(spark, d), ["user_id"], "text"))


@query(
    "off_topic_run",
    f"""SELECT user_id, {iso('started_at')} AS started_at, {iso('ended_at')} AS ended_at, n_rows
        FROM ({_RUNS.format(value='is_off_topic')}) WHERE is_off_topic AND n_rows > 5""",
    "messages",
)
def _(spark, d):
    return _shown(signals.off_topic_run(views.messages(spark, d), ["user_id"]))


@query(
    "repeat_in_message",
    """SELECT doc_id, max(n) AS line_run FROM (
           SELECT doc_id, line, island, CAST(count(*) AS INTEGER) AS n FROM (
               SELECT doc_id, line, place - row_number() OVER (
                          PARTITION BY doc_id, line ORDER BY place) AS island
               FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place
                     FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                                  generate_subscripts(string_split(text, chr(10)), 1) AS i
                           FROM documents)
                     WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''))
           GROUP BY ALL)
       GROUP BY doc_id HAVING max(n) >= 3""",
)
def _(spark, d):
    found = signals.repeat_in_message(views.table(spark, d, "documents"), "text")
    return found.select("doc_id", "line_run")


@query(
    "repeat_across_threads",
    """SELECT sha256(text) AS text_hash, count(*) AS n_posts, count(DISTINCT source) AS n_threads
       FROM documents WHERE text <> '' GROUP BY text
       HAVING count(*) >= 3 AND count(DISTINCT source) > 1""",
)
def _(spark, d):
    return signals.repeat_across_threads(views.table(spark, d, "documents"), "text", "source")


@query(
    "once_per_week",
    f"""SELECT event_id, user_id, minutes_since FROM (
            SELECT event_id, user_id, {minutes('lag(ts) OVER w', 'ts')} AS minutes_since
            FROM messages WHERE is_promo WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE minutes_since < 7 * 24 * 60""",
    "messages",
)
def _(spark, d):
    found = signals.once_per_week(views.messages(spark, d), ["user_id"], F.col("is_promo"))
    return found.select("event_id", "user_id", "minutes_since")


# --- streams: each run reads its whole table as a stream and ends when it is read ---


def _event_stream(spark, d):
    schema = views.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return views.messages_from(raw)


@query("stream_validate", f"SELECT doc_id, errors = '' AS valid FROM ({JSON_ERRORS_SQL})")
def _(spark, d):
    out = scratch_dir(spark, "validate")
    lines = json_labels(views.table(spark, d, "documents"))
    tables.append_jsonl(lines, f"{out}/in")
    stream = spark.readStream.schema(lines.schema).json(f"{out}/in")
    jobs.stream_validate(stream, "line", out).awaitTermination()
    parts = [
        spark.read.parquet(f"{out}/{part}").select("doc_id", F.lit(part == "valid").alias("valid"))
        for part in ("valid", "quarantine")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "stream_bucket_counts",
    """SELECT bucket, count(*) AS n_rows, count(*) FILTER (WHERE insult >= 0.4) AS n_flagged
       FROM buckets GROUP BY bucket""",
    "buckets",
)
def _(spark, d):
    out = scratch_dir(spark, "counts")
    rows = views.corpus(spark, d).select(
        scores.bucket().alias("bucket"), (F.col("insult") >= 0.4).alias("flagged")
    )
    rows.write.parquet(f"{out}/in")
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2)
    stream = reader.parquet(f"{out}/in")
    jobs.stream_bucket_counts(stream, "bucket", "flagged", out).awaitTermination()
    return jobs.latest_counts(spark.read.parquet(f"{out}/counts"))


@query(
    "stream_sessions",
    f"""SELECT * FROM ({_SITTINGS_SHOWN}) WHERE user_id IS NOT NULL
        AND strptime(ended_at, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 90 MINUTE
            <= (SELECT max(ts) - INTERVAL 60 MINUTE FROM messages)""",
    "messages",
)
def _(spark, d):
    out = scratch_dir(spark, "sittings")
    jobs.stream_sessions(_event_stream(spark, d), "user_id", out).awaitTermination()
    return _shown(spark.read.parquet(f"{out}/sittings"))


@query(
    "stream_pile_on",
    f"""SELECT CAST(target_id AS VARCHAR) AS target_id, CAST(event_id AS VARCHAR) AS event_id,
               CAST(user_id AS VARCHAR) AS user_id FROM ({_PILE_ON})""",
    "messages",
)
def _(spark, d):
    out = scratch_dir(spark, "pile-on")
    jobs.stream_pile_on(_event_stream(spark, d), out, span_seconds=6 * 3600).awaitTermination()
    return spark.read.parquet(f"{out}/pile_on").select("target_id", "event_id", "user_id")
