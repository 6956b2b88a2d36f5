"""Corpus profiles: lengths, scores, exact quantiles, rates, bucket and review counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden import contracts as C
from tidewarden.functions import scores
from tidewarden.operators import ordered
from tidewarden.operators.tables import literal_table

SCORE_BINS = 1 << 20  # fine bins; a thousand of them make a coarse one


# Of the two 1-based ranks between which the exclusive 95th percentile lies, the lower one.
_P95_RANK = "greatest(1, least(floor(19 * (n + 1) / 20), n - 1))"
_RANKS = {
    "mid_low": "floor((n + 1) / 2)",
    "mid_high": "floor(n / 2) + 1",
    "p95_low": _P95_RANK,
    "p95_high": f"{_P95_RANK} + 1",
}
# Whether a rank lies among the rows of a value, in a histogram with running counts.
_HELD = {name: f"(upto >= {r} AND upto - n_rows < {r})" for name, r in _RANKS.items()}
_MEDIAN = "(mid_low + mid_high) / 2D"
# Linear between the two ranks, beyond the data for few rows.
_WEIGHT = f"(19 * (n + 1) - 20 * {_P95_RANK})"
_P95 = f"CASE WHEN n >= 2 THEN (p95_low * (20 - {_WEIGHT}) + p95_high * {_WEIGHT}) / 20D END"


def _values_at_ranks() -> list[Column]:
    """The values at the median and p95 ranks of a cumulated histogram, as aggregates."""
    return [
        F.expr(f"max(CASE WHEN {held} THEN value END)").alias(name)
        for name, held in _HELD.items()
    ]


def length_profile(df: DataFrame, column: str) -> DataFrame:
    """Exact length statistics of a text column, all from one histogram of lengths.

    The histogram has at most as many rows as there are different lengths.
    """
    lengths = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.length(column).cast("bigint").alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    everything = Window.partitionBy()
    upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        lengths.withColumn("upto", F.sum("n_rows").over(upto))
        .withColumn("n", F.sum("n_rows").over(everything))
        .withColumn("chars", F.sum(F.col("value") * F.col("n_rows")).over(everything))
        .withColumn("shortest", F.min("value").over(everything))
        .withColumn("longest", F.max("value").over(everything))
    )
    facts = [F.max(c).alias(c) for c in ("chars", "shortest", "longest")]
    picked = ranked.agg(
        F.max("n").alias("n"),
        *facts,
        *_values_at_ranks(),
    )
    return picked.select(
        F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.col("shortest").alias("min_length"),
        F.expr(_MEDIAN).alias("median_length"),
        F.floor(F.expr(_MEDIAN)).alias("median_shown"),
        (F.col("chars") / F.col("n")).alias("mean_length"),
        F.expr(_P95).alias("p95_length"),
        F.col("longest").alias("max_length"),
    )


def _holding_ranks(bins: DataFrame) -> DataFrame:
    """The bins, with their running counts, in which the wanted ranks lie: four at most."""
    held = bins.where(" OR ".join(_HELD.values()))
    return held.withColumn("before", F.col("upto") - F.col("n_rows"))


def score_profile(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Exact minimum, median and p95 of a score column, whatever the number of distinct values.

    The wanted ranks are looked up in a thousand coarse bins, then in the thousand fine bins of
    each coarse bin that holds one, then among the values of four fine bins at most. A task sends
    a thousand counts or a few; the score column is read three times. Scores outside low..high
    fall in the outer bins, whose values are counted like those of any other. Null and NaN scores
    are left out.
    """
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    last = SCORE_BINS - 1
    step = F.floor((F.col("value") - low) * F.lit(SCORE_BINS / (high - low)))
    fine = F.greatest(F.lit(0), F.least(F.lit(last), step))
    values = (
        df.select(value.alias("value"))
        .where(F.col("value").isNotNull())
        .withColumn("fine", fine)
        .withColumn("coarse", F.shiftright("fine", 10))
    )
    upto = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    known = ["n", "smallest", "before"]

    coarse = (
        values.groupBy("coarse")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("lowest"))
        .withColumn("upto", F.sum("n_rows").over(upto.orderBy("coarse")))
        .withColumn("n", F.sum("n_rows").over(everything))
        .withColumn("smallest", F.min("lowest").over(everything))
    )
    wanted = _holding_ranks(coarse).select("coarse", *known)
    fine_bins = (
        values.join(F.broadcast(wanted), "coarse")  # four rows at most, as below
        .groupBy("coarse", "fine", *known)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn(
            "upto",
            F.col("before") + F.sum("n_rows").over(upto.partitionBy("coarse").orderBy("fine")),
        )
    )
    # Rows of the held bins before a bin, to tell the running count of a bin from that of all four.
    skipped = F.sum("n_rows").over(Window.orderBy("fine").rowsBetween(Window.unboundedPreceding, -1))
    wanted = _holding_ranks(fine_bins).select(
        "fine", *known, F.coalesce(skipped, F.lit(0)).alias("skipped")
    )
    counted = (
        values.join(F.broadcast(wanted), "fine")
        .groupBy("fine", *known, "skipped", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    # A bin may hold very many values, all that lie outside low..high for one: they are counted up
    # over ranges of values, not in one task.
    summed = ordered.with_scan(
        counted, ["fine", "value"], F.col("n_rows"), "seen", "sum", inclusive=True
    )
    ranked = summed.withColumn("upto", F.col("before") + F.col("seen") - F.col("skipped"))
    picked = ranked.agg(
        F.max("n").alias("n"), F.max("smallest").alias("smallest"), *_values_at_ranks()
    )
    return picked.select(
        F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.col("smallest").alias("min_score"),
        F.expr(_MEDIAN).alias("median_score"),
        F.expr(_P95).alias("p95_score"),
    )


def label_rates(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts and percentages of two 0/1 flags, in one pass."""
    a, b = F.col(first) != 0, F.col(second) != 0
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(a).alias(f"n_{first}"),
        F.count_if(b).alias(f"n_{second}"),
        F.count_if(a & b).alias("n_both"),
    )

    def percent(column: str) -> Column:
        return F.when(F.col("n_rows") > 0, F.lit(100.0) * F.col(column) / F.col("n_rows"))

    return counts.select(
        "*",
        percent(f"n_{first}").alias(f"pct_{first}"),
        percent(f"n_{second}").alias(f"pct_{second}"),
    )


def flag_subset(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """Whether every row with the inner flag has the outer flag too."""
    outside = F.count_if((F.col(inner) != 0) & (F.col(outer) == 0))
    return df.agg(outside.alias("n_outside")).withColumn("is_subset", F.col("n_outside") == 0)


def audit_summary(rows: DataFrame, judgment: str = "judgment") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(f"{judgment}.violates_policy")).alias("violations"),
        F.count_if(F.col(f"{judgment}.confidence") < C.LOW_CONFIDENCE).alias("low_confidence"),
    )


def bucket_breakdown(
    rows: DataFrame, bucket: str, violates: str, targets: Sequence[str] = tuple(C.BUCKET_TARGETS)
) -> DataFrame:
    """Rows and flagged rows per bucket, in target order, and in total (null bucket)."""
    per = rows.groupBy(F.col(bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(violates)).alias("n_flagged")
    )
    return (
        per.rollup("bucket")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_flagged").alias("n_flagged"))
        .withColumn("position", scores.position_of(F.col("bucket"), targets))
        .orderBy(F.col("position").asc_nulls_last())
    )


def bucket_fill(picked: DataFrame, targets: Mapping[str, int] = C.BUCKET_TARGETS) -> DataFrame:
    """Rows got and wanted per bucket, empty buckets included."""
    got = picked.groupBy("bucket").agg(F.count(F.lit(1)).alias("got"))
    return (
        literal_table(picked.sparkSession, targets, "bucket", "target")
        .join(got, "bucket", "left")
        .select("bucket", F.coalesce("got", F.lit(0)).alias("got"), "target")
    )


def catalog_report(validated: DataFrame, rule_set: str = "rule_set") -> DataFrame:
    """File, regime, number of rules and outcome of each rule set."""
    return validated.select(
        *[c for c in validated.columns if c not in (rule_set, "errors")],
        F.col(f"{rule_set}.regime").alias("regime"),
        F.coalesce(F.size(f"{rule_set}.rules"), F.lit(0)).alias("n_rules"),
        F.when(F.size("errors") == 0, "OK").otherwise("FAIL").alias("outcome"),
    )


def yield_estimate(df: DataFrame, column: str, at_most: int) -> DataFrame:
    """How many rows, and which share, a length cut-off keeps."""
    kept = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.length(column) <= at_most).alias("n_kept"),
    )
    return kept.withColumn(
        "share", F.when(F.col("n_rows") > 0, F.col("n_kept") / F.col("n_rows"))
    )


def slice_quota(rows: DataFrame, group: str, quotas: Mapping[str, int]) -> DataFrame:
    """Rows per slice beside the planned number, and how many are missing; slices that the plan
    lacks are shown with a planned number of zero."""
    got = rows.groupBy(F.col(group).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    n_rows, planned = F.coalesce("n", F.lit(0)), F.coalesce("planned", F.lit(0))
    return (
        literal_table(rows.sparkSession, quotas, "slice", "planned")
        .join(got, "slice", "full_outer")
        .select(
            "slice",
            n_rows.alias("n_rows"),
            planned.alias("planned"),
            F.greatest(F.lit(0), planned - n_rows).alias("missing"),
        )
    )
