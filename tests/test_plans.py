"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tidewarden.operators import ordering, profile, sampling, signals
from tidewarden.plans import views

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_is_thinned_and_placed_in_bins(spark):
    """No task gets the whole prefix: places are given per hash bin, and the bound needs ids only."""
    text = plan(ordering.stream(views.table(spark, SF_DIR, "documents"), 100, "doc_id", 1))
    assert "TakeOrderedAndProject" not in text and "hashpartitioning(_bin" in text
    assert "ReadSchema: struct<doc_id:bigint>" in text and "ReadSchema: struct<>" in text


def test_quota_sample_is_limited_before_the_shuffle(spark):
    rows = views.corpus(spark, SF_DIR).withColumn("g", F.col("lang"))
    text = plan(sampling.first_n_per_group(rows, "g", {"en": 3, "de": 5}, ["doc_id"]))
    assert "row_number(), 5, Partial" in text


def test_rows_of_a_group_are_dealt_by_its_bins(spark):
    text = plan(QUERIES["spot_check"](spark, SF_DIR))
    assert "hashpartitioning(slug" in text and "_bin" in text.split("hashpartitioning(slug")[1].split(")")[0]


def test_skips_are_limited_before_the_shuffle(spark):
    assert "row_number(), 4, Partial" in plan(QUERIES["skip_breaches"](spark, SF_DIR))


@pytest.mark.parametrize("name", ["infer_sessions", "repeat_streak", "off_topic_run"])
def test_runs_read_the_log_once(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("FileScan") == 1 and "rangepartitioning" in text and "Broadcast" not in text


def test_no_window_is_dealt_by_a_key(spark):
    for name in ("infer_sessions", "pile_on", "once_per_week", "cooldown_breaches"):
        text = plan(QUERIES[name](spark, SF_DIR))
        dealt = [x.split(",")[0] for x in text.split("hashpartitioning(")[1:]]
        assert dealt and all(x.startswith(("_part", "_lane")) for x in dealt)


def test_profiles_read_one_column(spark):
    text = plan(profile.length_profile(views.table(spark, SF_DIR, "documents"), "text"))
    assert "ReadSchema: struct<text:string>" in text


def test_flag_filter_reaches_the_scan(spark):
    labels = views.table(spark, SF_DIR, "labels").where(F.col("toxic") == 1)
    assert "EqualTo(toxic,1)" in plan(labels)


@pytest.mark.parametrize("name", ["stratified_sample", "pile_on", "infer_sessions", "foils", "cap_source"])
def test_results_do_not_depend_on_partitions(spark, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            seen.append(sorted(map(str, QUERIES[name](spark, SF_DIR).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
