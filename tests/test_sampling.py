import hashlib

import pytest
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.operators import ordering, sampling


def _hash(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()


def _stream(seed, keys):
    return sorted(keys, key=lambda k: _hash(seed, k))


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(5000).withColumnRenamed("id", "k").withColumn("text", F.lit("some text"))


@pytest.mark.parametrize("n", [0, 1, 10, 200, 4999, 5000, 9000])
def test_prefix_is_the_start_of_the_stream(ids, n):
    got = [r["k"] for r in ordering.scan_prefix(ids, n, "k", 7).collect()]
    assert got == _stream(7, range(5000))[:n]


@pytest.mark.parametrize("n", [1, 600, 5000, 9000])
def test_places_are_given_in_bins(ids, n):
    wanted = _stream(7, range(5000))[:n]
    assert [r["k"] for r in ordering.scan_prefix(ids, n, "k", 7).collect()] == wanted
    rows = ordering.stream(ids, n, "k", 7).collect()
    assert {r["stream_idx"]: r["k"] for r in rows} == dict(enumerate(wanted))


def test_the_whole_stream_is_numbered(ids):
    rows = ordering.stream(ids, None, "k", 7).collect()
    assert {r["stream_idx"]: r["k"] for r in rows} == dict(enumerate(_stream(7, range(5000))))


def test_prefix_of_nothing(spark):
    assert ordering.scan_prefix(spark.range(0), 5, "id", 1).count() == 0


def test_thin_drops_the_bound_when_too_few_lie_below_it(spark):
    """Hashes that all lie high, as no real hash does, still give whole results."""
    df = spark.range(1000).withColumn(ordering.HASH, F.concat(F.lit("ff"), F.hex("id")))
    assert ordering.thin(df, {"": 10}).count() == 1000


def test_thin_keeps_few_rows(ids):
    hashed = ids.withColumn(ordering.HASH, ordering.order_hash(3, F.col("k")))
    assert 50 <= ordering.thin(hashed, {"": 50}).count() < 400


def test_thin_per_group(spark):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") < 4000, "big").otherwise("small"))
    hashed = df.withColumn(ordering.HASH, ordering.order_hash(3, F.col("id")))
    kept = ordering.thin(hashed, {"big": 30, "small": 5000}, F.col("g"))
    counts = {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()}
    assert 30 <= counts["big"] < 400 and counts["small"] == 2000


def test_stream_idx_is_given_before_filters(ids):
    rows = ordering.stream(ids, 100, "k", 9).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["stream_idx"])] == _stream(9, range(5000))[:100]
    assert sorted(r["stream_idx"] for r in rows) == list(range(100))


def test_seeded_shuffle_is_the_whole_stream(spark):
    got = [r["id"] for r in ordering.seeded_shuffle(spark.range(50), "id", 5).collect()]
    assert got == _stream(5, range(50))


@pytest.mark.parametrize("quotas", [{"a": 2, "b": 5}, {"a": 0, "b": 1}, {"a": 2000, "b": 1500}])
def test_hashed_sample_direct_and_thinned(spark, quotas):
    df = spark.range(9000).withColumn("g", F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")))
    got = sampling.hashed_sample(df, "g", quotas, "id", 11)
    seen = {g: [] for g in "abc"}
    for r in got.orderBy("rank").collect():
        seen[r["g"]].append(r["id"])
    for i, g in enumerate("abc"):
        assert seen[g] == _stream(11, range(i, 9000, 3))[: quotas.get(g, 0)]


def _corpus(spark, rows):
    schema = "doc int, text string, " + ", ".join(f"{s} double" for s in C.SCORES)
    return spark.createDataFrame([(r[0], r[1], *[r[2].get(s) for s in C.SCORES]) for r in rows], schema)


def test_stratified_sample_order_and_quota(spark):
    rows = [(i, "x" * (10 if i % 4 else 3), {"threat": 0.5} if i % 2 else {}) for i in range(400)]
    got = sampling.stratified_sample(_corpus(spark, rows), "doc", seed=2, scan_rows=300).collect()
    place = {k: i for i, k in enumerate(_stream(2, range(400))[:300])}
    threats = [k for k in place if k % 2][:7]
    low = [k for k in place if k % 2 == 0 and k % 4][:5]
    assert [int(r["hf_id"]) for r in got] == threats + low
    assert [r["stream_idx"] for r in got] == [place[k] for k in threats + low]
    assert got[0]["features"]["obscene"] == 0.0 and got[0]["sexual_explicit"] == 0.0


def test_uniform_candidates_filter_after_the_prefix(spark):
    rows = [(i, "x" * (i % 300), {}) for i in range(1000)]
    got = sampling.uniform_candidates(_corpus(spark, rows), "doc", 3, "chat").collect()
    start = _stream(3, range(1000))[:200]
    wanted = {k: i for i, k in enumerate(start) if 5 <= k % 300 < 150}
    assert {r["doc"]: r["stream_idx"] for r in got} == wanted


def test_resume_counts_filtered_candidates(spark):
    df = spark.createDataFrame([(s,) for s in (3, 8, 9, 20)], "stream_idx bigint")
    assert [r["stream_idx"] for r in sampling.resume_slice(df, 2).orderBy("place").collect()] == [9, 20]


@pytest.mark.parametrize(
    "scores, wanted, above",
    [
        ([0.1, 0.7, 0.71, 0.9], 2, True),
        ([0.1, 0.7, 0.7, 0.2], 1, False),
        ([None, float("nan"), 0.2], 2, False),
    ],
)
def test_example_or_max(spark, scores, wanted, above):
    df = spark.createDataFrame(list(enumerate(scores)), "stream_idx bigint, toxicity double")
    row = sampling.example_or_max(df, "toxicity", 0.7).first()
    assert (row["stream_idx"], row["above_threshold"]) == (wanted, above)


def test_example_of_nothing(spark):
    empty = spark.createDataFrame([], "stream_idx bigint, toxicity double")
    assert sampling.example_or_max(empty, "toxicity", 0.7).count() == 0


def test_first_flagged_leaves_out_flags_that_never_occur(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0)], "i int, a int, b int")
    assert [(r["flag"], r["i"]) for r in sampling.first_flagged(df, ["a", "b"], "i").collect()] == [("a", 2)]


@pytest.mark.parametrize("n_main, n_extra, allowed", [(80, 500, 20), (80, 10, 10), (0, 10, 0), (7, 100, 1)])
def test_cap_source(spark, n_main, n_extra, allowed):
    main, extra = spark.range(n_main), spark.range(1000, 1000 + n_extra)
    got = [r["id"] for r in sampling.cap_source(main, extra, 0.2, "id", 5).collect()]
    assert sorted(i for i in got if i < 1000) == list(range(n_main))
    assert sorted(i for i in got if i >= 1000) == sorted(_stream(5, range(1000, 1000 + n_extra))[:allowed])


SHARES = {"high": 0.35, "mid": 0.25, "category": 0.25, "clean": 0.15}


@pytest.mark.parametrize("n", range(201))
def test_quotas_add_up(n):
    got = sampling.apportion(n, SHARES)
    assert sum(got.values()) == n
    assert all(abs(got[k] - n * share) < 1 for k, share in SHARES.items())
    supply = {"high": 3, "mid": 1000, "category": 20, "clean": 0}
    short = sampling.apportion(n, SHARES, supply)
    assert sum(short.values()) == n and all(short[k] <= supply[k] for k in SHARES)


def test_quotas_fall_short_only_where_all_are_exhausted():
    assert sampling.apportion(50, SHARES, {"high": 2, "mid": 3, "category": 0}) == {"high": 2, "mid": 3, "category": 0, "clean": 0}
    assert sampling.apportion(7, {"a": 0.5, "b": 0.5}) == {"a": 4, "b": 3}
    assert sampling.apportion(9, {"a": 0.0, "b": 1.0}, {"a": 9, "b": 4}) == {"a": 0, "b": 4}


def test_short_bands_are_reported_and_made_up_for(spark):
    rows = [(i, "text", {"toxicity": 0.9} if i < 4 else {"toxicity": 0.3}) for i in range(60)]
    corpus = _corpus(spark, rows)
    got = sampling.band_sample(corpus, "doc", 3, 41)
    assert {r["band"]: r["count"] for r in got.groupBy("band").count().collect()} == {"high": 4, "mid": 37}
    banded = corpus.withColumn("g", F.when(F.col("doc") % 20 == 0, "other").when(F.col("doc") < 4, "high").otherwise("mid"))
    quotas, report = sampling.quota_report(banded, "g", 10, SHARES)
    assert quotas == {"high": 3, "mid": 7, "category": 0, "clean": 0}
    assert sorted(map(tuple, report.collect())) == [
        ("category", 2, 0, 0, 2), ("clean", 1, 0, 0, 1), ("high", 4, 3, 3, 1), ("mid", 3, 54, 7, 0), ("other", 0, 3, 0, 0),
    ]


def test_source_mix_makes_up_for_a_small_source(spark):
    sources = {"a": (spark.range(5), 0.5), "b": (spark.range(100), 0.3), "c": (spark.range(100), 0.2)}
    got = sampling.source_mix(sources, 41, "id", 1)
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 5, "b": 22, "c": 14}


def test_spot_check_of_a_large_group(spark):
    """One group holds nearly all rows, one key is null, and more is asked than most groups have."""
    df = spark.range(6000).withColumn("g", F.when(F.col("id") % 100 < 97, "big").when(F.col("id") % 100 < 99, F.col("id").cast("string")))
    got = sampling.spot_check(df, "g", 4000, "id", 5).collect()
    counts = {}
    for r in got:
        counts.setdefault(r["g"], []).append((r["rank"], r["id"]))
    big = [k for _, k in sorted(counts.pop("big"))]
    assert big == _stream(5, [k for k in range(6000) if k % 100 < 97])[:4000]
    assert [r for r, _ in sorted(counts.pop(None))] == list(range(1, 61))
    assert len(counts) == 120 and all(len(v) == 1 for v in counts.values())


def test_resume_slice_over_many_ranges(spark):
    df = spark.range(0, 900, 3).select(F.col("id").alias("stream_idx"))
    got = sampling.resume_slice(df, 250, parts=9).orderBy("place").collect()
    assert [(r["place"], r["stream_idx"]) for r in got] == [(p, 3 * p) for p in range(250, 300)]


def test_mix_by_rule_shows_plan_and_rest(spark):
    rows = [(["R1", "R2"], "clear"), (["R1", "R1"], "odd"), (["R7"], None), ([], "clear"), (None, "clear")]
    df = spark.createDataFrame(rows, "rules array<string>, call string")
    found = sampling.mix_by_rule(df, "rules", "call", {"clear": 0.6, "edge": 0.4}, ["R1", "R3"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Expand") == 1
    got = {(r["rule_id"], r["kind"]): (r["n_rows"], r["share"], r["planned"]) for r in found.collect()}
    assert got == {
        ("R1", None): (2, 1.0, 1.0), ("R1", "clear"): (1, 0.5, 0.6), ("R1", "edge"): (0, 0.0, 0.4), ("R1", "odd"): (1, 0.5, 0.0),
        ("R2", None): (1, 1.0, 0.0), ("R2", "clear"): (1, 1.0, 0.0),
        ("R3", None): (0, None, 1.0), ("R3", "clear"): (0, None, 0.6), ("R3", "edge"): (0, None, 0.4),
        ("R7", None): (1, 1.0, 0.0), ("R7", ""): (1, 1.0, 0.0),
    }


def test_source_mix_takes_shares(spark):
    a = spark.range(100).withColumn("x", F.lit(1))
    got = sampling.source_mix({"a": (a, 0.5), "b": (spark.range(100), 0.3)}, 40, "id", 1)
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert counts == {"a": 25, "b": 15}


def test_share_check_shows_absent_groups(spark):
    df = spark.createDataFrame([("clean",)] * 3 + [("odd",)], "kind string")
    got = {r["kind"]: (r["n_rows"], r["share"], r["planned"]) for r in
           sampling.share_check(df, "kind", C.GENERATOR_SHARES).collect()}
    assert got["clean"] == (3, 0.75, 0.4) and got["obfuscated"] == (0, 0.0, 0.1)
    assert got["odd"] == (1, 0.25, 0.0)
