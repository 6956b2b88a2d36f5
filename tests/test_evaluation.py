import random

import pytest

from tidewarden.operators import evaluation


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "gold boolean, pred boolean")


def test_binary_f1(spark):
    rows = [(True, True)] * 3 + [(False, True)] + [(True, False)] * 2 + [(False, False)] * 4
    row = evaluation.binary_f1(_pairs(spark, rows), "gold", "pred").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (3, 1, 2, 4)
    assert (row["precision"], row["recall"], row["f1"]) == (0.75, 0.6, pytest.approx(2 / 3, abs=1e-6))


def test_f1_without_positives_is_null(spark):
    row = evaluation.binary_f1(_pairs(spark, [(False, False)]), "gold", "pred").first()
    assert row["precision"] is None and row["recall"] is None and row["f1"] is None


def test_macro_f1_counts_classes_of_both_sides(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "g string, p string")
    row = evaluation.macro_f1(df, "g", "p").first()
    assert (row["n_classes"], row["macro_f1"]) == (3, pytest.approx((2 / 3 + 0.5 + 0) / 3, abs=1e-6))


def test_agreement_gate(spark):
    df = spark.createDataFrame(
        [("a", 1, 0, 1, 0), ("a", 1, 0, 0, 1), ("b", 0, 1, 0, 1)],
        "slug string, a_yes long, a_no long, b_yes long, b_no long",
    )
    got = {r["slug"]: (r["agreement"], r["passes"]) for r in evaluation.agreement(df, "slug").collect()}
    assert got["a"] == (0.5, False) and got["b"] == (1.0, True)
    assert got[None] == (pytest.approx(2 / 3), False)


def test_rule_slices(spark):
    schema = "doc int, slug string, violated_rules array<string>"
    gold = spark.createDataFrame([(1, "s", ["R1", "R2"]), (2, "s", ["R1"]), (3, "s", [])], schema)
    pred = spark.createDataFrame([(1, "s", ["R1"]), (2, "s", []), (3, "s", ["R1"])], schema)
    got = {r["rule_id"]: (r["tp"], r["fp"], r["fn"]) for r in
           evaluation.rule_slice_metrics(gold, pred, ["doc", "slug"]).collect()}
    assert got == {"R1": (1, 1, 1), "R2": (0, 0, 1)}


def test_reliability_edges(spark):
    rows = [(0.0, True), (0.1, True), (0.95, False), (1.0, True), (None, True), (float("nan"), True)]
    df = spark.createDataFrame(rows, "c double, ok boolean")
    bins = {r["bin"]: r["n_rows"] for r in evaluation.reliability_bins(df, "c", "ok").collect()}
    assert bins == {0: 1, 1: 1, 9: 2, None: 2}


def test_ece_of_known_bins(spark):
    df = spark.createDataFrame([(0.8, True)] * 8 + [(0.8, False)] * 2 + [(0.3, True)] * 10, "c double, ok boolean")
    assert evaluation.ece(df, "c", "ok").first()["ece"] == pytest.approx(0.5 * 0.0 + 0.5 * 0.7, abs=1e-6)


def test_rows_without_a_confidence_are_counted(spark):
    rows = [("a", 0.8, True), ("a", 0.8, False), ("a", None, True), ("a", 1.5, False), ("b", float("nan"), True)]
    df = spark.createDataFrame(rows, "g string, c double, ok boolean")
    got = {r["g"]: (r["n_rows"], r["n_left_out"], r["ece"]) for r in evaluation.ece(df, "c", "ok", by=["g"]).collect()}
    assert got == {"a": (2, 2, 0.3), "b": (0, 1, None)}


def test_identity_slices_of_every_grain_from_one_pass(spark):
    """A row counts for each attribute and once for each rule of its list; one Expand in the plan."""
    rows = [
        (True, True, 0.9, True, True, True, ["R1", "R2", "R1"], "R1:a"),
        (False, True, 0.8, False, True, False, [], None),
        (True, False, 0.85, False, True, False, None, "R1:a"),
        (True, True, 0.2, True, False, False, ["R9"], "R9:z"),
    ]
    df = spark.createDataFrame(rows, "gold boolean, pred boolean, c double, ok boolean, x boolean, y boolean, rules array<string>, edge string")
    found = evaluation.identity_slices(df, ["x", "y"], "gold", "pred", "c", "ok", "rules", "edge")
    assert found._jdf.queryExecution().executedPlan().toString().count("Expand") == 1
    got = {(r["attribute"], r["grain"], r["value"]): (r["n_rows"], r["precision"], r["recall"]) for r in found.collect()}
    assert got == {
        ("x", "all", "all"): (3, 0.5, 0.5),
        ("y", "all", "all"): (1, 1.0, 1.0),
        ("x", "rule", "R1"): (1, 1.0, 1.0),
        ("x", "rule", "R2"): (1, 1.0, 1.0),
        ("y", "rule", "R1"): (1, 1.0, 1.0),
        ("y", "rule", "R2"): (1, 1.0, 1.0),
        ("x", "edge", "R1:a"): (2, 1.0, 0.5),
        ("y", "edge", "R1:a"): (1, 1.0, 1.0),
        ("x", "bin", "9"): (1, 1.0, 1.0),
        ("x", "bin", "8"): (2, 0.0, 0.0),
        ("y", "bin", "9"): (1, 1.0, 1.0),
    }


def _pool(points):
    """Pool-adjacent-violators on (x, mean, weight)."""
    blocks = []
    for x, mean, weight in sorted(points):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, k = blocks.pop()
            a, b, c = blocks.pop()
            blocks.append([(a * b + m * w) / (b + w), b + w, c + k])
    return [m for m, _, k in blocks for _ in range(k)]


def test_isotonic_calibration(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), rng.random() < 0.6) for _ in range(300)]
    df = spark.createDataFrame(rows, "c double, ok boolean")
    got = evaluation.isotonic_calibration(df, "c", "ok").orderBy("confidence").collect()
    groups = {}
    for c, ok in rows:
        groups.setdefault(c, []).append(ok)
    wanted = _pool([(c, sum(v) / len(v), len(v)) for c, v in groups.items()])
    assert [r["calibrated"] for r in got] == pytest.approx(wanted, abs=1e-6)


@pytest.mark.parametrize("parts, merge", [(1, 32), (12, 32), (40, 3), (None, 2)])
def test_isotonic_calibration_without_a_grid(spark, monkeypatch, parts, merge):
    """Six decimals, many ranges and several rounds of merging; falling, rising and flat stretches."""
    monkeypatch.setattr(evaluation, "MERGE", merge)
    rng = random.Random(8)
    rows = [(rng.randrange(10**6) / 10**6, rng.random()) for _ in range(3000)]
    rows = [(c, u < (1 - c if c < 0.3 else c if c < 0.8 else 0.5)) for c, u in rows]
    rows += [(0.5, True), (0.5, False), (None, True), (float("nan"), True), (1.5, True), (-0.1, False)]
    df = spark.createDataFrame(rows, "c double, ok boolean")
    got = evaluation.isotonic_calibration(df, "c", "ok", parts).orderBy("confidence").collect()
    groups = {}
    for c, ok in rows:
        if c is not None and 0 <= c <= 1:
            groups.setdefault(c, []).append(ok)
    wanted = _pool([(c, sum(v) / len(v), len(v)) for c, v in sorted(groups.items())])
    assert [r["confidence"] for r in got] == sorted(groups)
    assert [r["calibrated"] for r in got] == pytest.approx(wanted, abs=1e-6)
    assert evaluation.isotonic_calibration(df.where("false"), "c", "ok").count() == 0


def test_scorers_are_compared_on_the_same_rows(spark):
    rows = [(True, 0.9, None), (False, 0.2, 0.6), (True, 0.7, 1.2), (None, 0.7, 0.2), (True, float("nan"), 0.3), (True, 0.4, 0.8)]
    df = spark.createDataFrame(rows, "gold boolean, a double, b double")
    got = {r["scorer"]: (r["n_rows"], r["recall"]) for r in evaluation.compare_scorers(df, {"A": "a", "B": "b"}, "gold", 0.5).collect()}
    assert got == {"A": (2, 0.0), "B": (2, 1.0)}


def test_disagreements_and_polarity(spark):
    df = spark.createDataFrame(
        [("x", True, 0.1, "spam"), ("x", False, 0.1, "spam"), ("y", True, 0.9, "sexual")],
        "item string, violates_policy boolean, score double, primary_category string",
    )
    assert [r["item"] for r in evaluation.rater_disagreement(df, ["item"]).collect()] == ["x"]
    got = {r["item"]: r["share"] for r in
           evaluation.classifier_disagreement(df, "score", "violates_policy", 0.5, "item").collect()}
    assert got == {"x": 0.5, "y": 0.0}
    both = {r["primary_category"]: r["both"] for r in evaluation.category_polarity(df).collect()}
    assert both == {"spam": True, "sexual": False}
