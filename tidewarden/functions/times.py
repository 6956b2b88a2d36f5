"""Session clock arithmetic. `now` is always passed in, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden import contracts as C


def minutes_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(60_000_000.0)


def elapsed_minutes(started_at: Column, now: Column) -> Column:
    """Minutes since the original start, resumed or not."""
    return minutes_between(started_at, now)


def cooldown_remaining(ended_at: Column, now: Column) -> Column:
    left = F.lit(float(C.COOLDOWN_MINUTES)) - minutes_between(ended_at, now)
    return F.when(ended_at.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), left))


def iso_utc(ts: Column) -> Column:
    """Whole-second ISO form with Z; the session time zone must be UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
