"""Score columns: null handling, buckets and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden import contracts as C


def score_or_zero(score: Column) -> Column:
    """Missing and NaN scores count as zero (Spark orders NaN above every number)."""
    return F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))


def source_features(features: Sequence[str] = C.FEATURES) -> Column:
    """The feature columns as one struct; missing scores stay null."""
    return F.struct(*[F.col(f).cast("double").alias(f) for f in features])


def filled_features(features: Sequence[str] = C.FEATURES) -> Column:
    """The feature columns as one struct; missing scores become zero."""
    return F.struct(*[score_or_zero(F.col(f)).alias(f) for f in features])


def _first_match(conditions: Sequence[tuple[str, Column]], default: str) -> Column:
    name, condition = conditions[0]
    chain = F.when(condition, name)
    for name, condition in conditions[1:]:
        chain = chain.when(condition, name)
    return chain.otherwise(default)


def bucket() -> Column:
    """Sampling bucket of a row with score columns."""
    return _first_match(
        [(name, score_or_zero(F.col(s)) >= low) for name, s, low in C.BUCKET_BOUNDS], "low_tox"
    )


def band() -> Column:
    """Training band of a row; bands are tried in order, the rest is `unassigned`."""
    tox = score_or_zero(F.col("toxicity"))
    any_category = F.greatest(*[score_or_zero(F.col(s)) for s in C.SCORES if s != "toxicity"])
    return _first_match(
        [
            ("high", tox > 0.5),
            ("mid", tox.between(0.2, 0.5)),
            ("category", any_category >= 0.3),
            ("clean", tox < 0.1),
        ],
        "unassigned",
    )


def position_of(value: Column, order: Mapping[str, int] | Sequence[str]) -> Column:
    """0-based place of a value in a fixed list, for ordering reports."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), value) - 1


def proxy_score(outside: Column, own: Column) -> Column:
    """Outside score where there is one, else the generator's own score."""
    return F.coalesce(outside, own)


def proxy_origin(outside: Column) -> Column:
    return F.when(outside.isNull(), "self").otherwise("outside")


def two_decimals(number: Column) -> Column:
    """Rounds the exact binary value, half to even, as C and Python print it."""
    return F.call_function("format_number", number, F.lit("0.00"))


def show_score(score: Column) -> Column:
    """Two decimals, or a question mark when missing."""
    return F.coalesce(two_decimals(score), F.lit("?"))
