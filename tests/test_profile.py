import math
import random
import statistics

import pytest

from tidewarden.operators import profile


def _wanted(values):
    p95 = statistics.quantiles(values, n=20)[-1] if len(values) >= 2 else None
    return min(values), statistics.median(values), p95


SIZES = [1, 2, 3, 18, 19, 20, 21, 22, 37, 100]


@pytest.mark.parametrize("n", SIZES)
def test_length_profile(spark, n):
    rng = random.Random(n)
    lengths = [rng.randrange(0, 60) for _ in range(n)]
    df = spark.createDataFrame([("x" * k,) for k in lengths], "t string")
    row = profile.length_profile(df, "t").first()
    low, median, p95 = _wanted(lengths)
    assert (row["n_rows"], row["min_length"], row["max_length"]) == (n, low, max(lengths))
    assert row["median_length"] == median
    assert row["median_shown"] == int(median)
    assert row["mean_length"] == pytest.approx(statistics.mean(lengths))
    assert (row["p95_length"] is None) if p95 is None else row["p95_length"] == pytest.approx(p95)


@pytest.mark.parametrize("n", SIZES)
def test_score_profile(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 0.5, rng.random()]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "s double")
    row = profile.score_profile(df, "s").first()
    low, median, p95 = _wanted(values)
    assert (row["n_rows"], row["min_score"]) == (n, low)
    assert row["median_score"] == pytest.approx(median)
    assert (row["p95_score"] is None) if p95 is None else row["p95_score"] == pytest.approx(p95)


def test_score_profile_outside_the_expected_range(spark):
    values = [-5.0, -4.0, 0.2, 0.3, 7.0, 9.0, 11.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    row = profile.score_profile(df, "s").first()
    assert row["median_score"] == 0.3
    assert row["p95_score"] == pytest.approx(statistics.quantiles(values, n=20)[-1])


def test_score_profile_of_many_values_outside(spark):
    """Nearly all values lie in one outer bin, which many tasks count up."""
    rng = random.Random(2)
    values = [rng.uniform(50, 90) for _ in range(3000)] + [0.5, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    found = profile.score_profile(df, "s")
    row = found.first()
    assert (row["n_rows"], row["min_score"]) == (3002, -1.0)
    assert row["median_score"] == pytest.approx(statistics.median(values))
    assert row["p95_score"] == pytest.approx(statistics.quantiles(values, n=20)[-1])


def test_profiles_of_nothing(spark):
    empty = spark.createDataFrame([], "t string, s double")
    assert profile.length_profile(empty, "t").first()["n_rows"] == 0
    assert profile.score_profile(empty, "s").first()["n_rows"] == 0


def test_label_rates_and_subset(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "a int, b int")
    row = profile.label_rates(df, "a", "b").first()
    assert (row["n_a"], row["n_b"], row["n_both"], row["pct_a"]) == (2, 2, 1, 50.0)
    assert profile.flag_subset(df, "b", "a").first().asDict() == {"n_outside": 1, "is_subset": False}


def test_low_confidence_is_strict(spark):
    df = spark.createDataFrame(
        [((True, 0.69),), ((False, 0.7),)], "judgment struct<violates_policy:boolean,confidence:double>"
    )
    assert profile.audit_summary(df).first().asDict() == {
        "total": 2,
        "violations": 1,
        "low_confidence": 1,
    }


def test_bucket_fill_names_empty_buckets(spark):
    df = spark.createDataFrame([("threat",)] * 3, "bucket string")
    got = {r["bucket"]: (r["got"], r["target"]) for r in profile.bucket_fill(df).collect()}
    assert got["threat"] == (3, 7) and got["low_tox"] == (0, 5) and len(got) == 6
