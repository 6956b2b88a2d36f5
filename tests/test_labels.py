import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import checks
from tidewarden.operators import labels, validation
from tests.test_validation import GOOD

CATALOG = [("chatty", "chat"), ("news", "comment"), ("mixed", "hybrid")]


def _labels(spark, keys):
    return spark.createDataFrame([(k, GOOD) for k in keys], C.LABELS)


def _inbox(spark, keys):
    features = dict.fromkeys(C.FEATURES, 0.1)
    rows = [(k, "threat", f"text {k}", str(k), {**features, "obscene": None}, 0.0) for k in keys]
    return spark.createDataFrame(rows, C.INBOX)


def test_label_join_and_gates(spark):
    inbox, some = _inbox(spark, [1, 2, 3]), _labels(spark, [2, 3, 4])
    assert sorted(r["stream_idx"] for r in labels.attach_labels(inbox, some).collect()) == [2, 3]
    assert [r["stream_idx"] for r in labels.unlabelled(inbox, some).collect()] == [1]
    assert [r["stream_idx"] for r in labels.orphan_labels(inbox, some).collect()] == [4]
    found = {r["stream_idx"]: r["problem"] for r in labels.label_mismatches(inbox, some).collect()}
    assert found == {1: "unlabelled", 4: "orphan_label"}
    with pytest.raises(validation.ContractError, match="unlabelled x1"):
        labels.require_complete(inbox, some)
    labels.require_complete(inbox, _labels(spark, [1, 2, 3]))
    with pytest.raises(validation.ContractError, match="repeated_label x1"):
        labels.require_complete(inbox, _labels(spark, [1, 2, 3, 3]))


def test_leak_gate(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "source_id string")
    held = spark.createDataFrame([("b",), ("b",), ("c",)], "source_id string")
    assert labels.leaked(train, held).count() == 2
    assert [r[0] for r in labels.drop_leaked(train, held).collect()] == ["a"]
    assert [r[0] for r in labels.leaked_ids(train, held).collect()] == ["b"]
    with pytest.raises(validation.ContractError, match="held-out"):
        labels.require_no_leak(train, held)
    with pytest.raises(validation.ContractError, match="without a source id"):
        labels.require_no_leak(spark.createDataFrame([(None,)], "source_id string"), held)
    assert labels.require_no_leak(labels.drop_leaked(train, held), held).count() == 1


def test_approved_row_is_an_audit_row_with_more(spark):
    joined = labels.attach_labels(_inbox(spark, [7]), _labels(spark, [7]))
    rows = labels.build_approved_row(
        joined, "s1", F.lit("2026-01-05 09:00:00"), "chatty", "chat", "corpus", "draft"
    )
    row = rows.first().asDict(recursive=True)
    assert row["audited_by"] == "human_approved" and row["dev_mode"] is False
    assert row["provenance"]["initial_author"] == "draft"
    assert row["provenance"]["drafted_at"] == row["timestamp"]
    assert row["content"]["source_features"]["obscene"] is None
    assert row["content"]["bucket"] == "threat" and "sexual_explicit" not in row["content"]
    assert row["judgment"] == GOOD
    audit = {f.name for f in C.AUDIT_ROW.fields}
    assert set(rows.columns) == audit | {"provenance"}
    content = {f.name for f in C.AUDIT_CONTENT.fields}
    assert set(rows.schema["content"].dataType.names) == content | {"bucket"}


def test_audit_row_schema_and_null_features(spark):
    rows = _labels(spark, [7]).select("stream_idx", "judgment", F.lit("t").alias("text"),
                                      F.lit("7").alias("hf_id"),
                                      *[F.lit(None if s == "insult" else 0.5).cast("double").alias(s) for s in C.SCORES])
    audit = labels.build_audit_row(rows, F.lit("s"), F.lit("2026-01-05 09:00:00"), F.lit("mixed"),
                                   F.lit("hybrid"), "corpus", F.lit(True))
    assert audit.schema.simpleString() == C.AUDIT_ROW.simpleString()
    row = audit.first()
    assert row["content"]["regime"] == "comment"
    assert row["content"]["source_features"]["insult"] is None
    # Comment rows come without a title, which the content contract reports.
    content = F.struct(
        F.col("content.text").alias("text"),
        F.col("content.regime").alias("regime"),
        F.lit(None).cast("string").alias("article_title"),
        F.lit("en").alias("language"),
    )
    errors = audit.select(checks.error_text(checks.content_errors(content)))
    assert errors.first()[0] == "article_title:title_required"


def test_review_rows_number_in_target_order(spark):
    joined = labels.attach_labels(_inbox(spark, [5, 3]), _labels(spark, [3, 5]))
    joined = joined.withColumn("bucket", F.when(F.col("stream_idx") == 3, "low_tox").otherwise("threat"))
    rows = labels.build_approved_row(joined, "s", F.lit("2026-01-05 09:00:00"), "a", "chat", "c", "d")
    got = labels.review_row(rows).orderBy("number").collect()
    assert [(r["number"], r["bucket"], r["tag"], r["confidence"]) for r in got] == [
        (1, "threat", "violation", "0.80"),
        (2, "low_tox", "violation", "0.80"),
    ]
    assert "obscene=?" in got[0]["features"] and "threat=0.10" in got[0]["features"]


def test_pairing_takes_compatible_regimes(spark):
    content = spark.createDataFrame([(1, "chat"), (2, "comment")], "i int, regime string")
    sets = spark.createDataFrame(CATALOG, "slug string, regime string")
    got = {(r["i"], r["slug"]) for r in labels.pair_with_rule_sets(content, sets).collect()}
    assert got == {(1, "chatty"), (2, "news"), (2, "mixed")}
    drawn = labels.rank_pairings(content, sets, "i", 1, 3).collect()
    assert len(drawn) == 2 and {(r["i"], r["slug"]) for r in drawn} <= got


def _scored(spark, **values):
    row = [values.get(s) for s in C.SCORES]
    schema = "slug string, " + ", ".join(f"{s} double" for s in C.SCORES)
    return spark.createDataFrame([("a", *row), ("none", *row)], schema)


def test_derive_labels_bounds_are_closed_and_ids_distinct(spark):
    thresholds = spark.createDataFrame(
        [("a", "R2", "threat", 0.4), ("a", "R2", "insult", 0.1), ("a", "R1", "toxicity", 0.5)],
        "slug string, rule_id string, feature string, min_score double",
    )
    got = labels.derive_labels(_scored(spark, threat=0.4, insult=0.3, toxicity=0.49), thresholds)
    assert {r["slug"]: (r["violated_rules"], r["violates_policy"]) for r in got.collect()} == {
        "a": (["R2"], True),
        "none": ([], False),
    }


def test_binary_labels(spark):
    pairs = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 0), (3, "b", 1), (4, "a", None)], "i int, slug string, toxic int"
    )
    rules = spark.createDataFrame([("a", "R2")], "slug string, rule_id string")
    got = {r["i"]: (r["violated_rules"], r["violates_policy"]) for r in
           labels.derive_labels_binary(pairs, "toxic", rules).collect()}
    assert got == {1: (["R2"], True), 2: ([], False), 3: ([], True), 4: ([], False)}


def _verdicts(spark, rows):
    return spark.createDataFrame(rows, "doc int, slug string, violates_policy boolean")


def test_foils_and_matrix(spark):
    df = _verdicts(spark, [(1, "a", True), (1, "b", False), (2, "a", True), (2, "b", True), (1, "a", True)])
    got = labels.foils(df, ["doc"]).collect()
    assert [(r["doc"], r["violating"], r["allowing"]) for r in got] == [(1, ["a"], ["b"])]
    matrix = {r["doc"]: (r["a"], r["b"], r["c"]) for r in labels.foil_matrix(df, ["doc"], ["a", "b", "c"]).collect()}
    assert matrix == {1: (True, False, None), 2: (True, True, None)}


def test_foils_over_a_thousand_rule_sets(spark):
    """None is listed by the caller; the slugs of both sides come back whole and in order."""
    rng = random.Random(5)
    rows = [(doc, f"set_{i:04}", rng.random() < 0.5) for doc in range(4) for i in rng.sample(range(1000), 700)]
    rows += [(9, f"set_{i:04}", True) for i in range(1000)]
    rows += [(8, "set_0062", True), (8, "set_0063", False), (8, None, True), (8, "set_0999", None)]
    got = {r["doc"]: (r["violating"], r["allowing"]) for r in labels.foils(_verdicts(spark, rows * 2), ["doc"]).collect()}
    wanted = {}
    for doc in (0, 1, 2, 3, 8):
        mine = [r for r in rows if r[0] == doc and r[1] is not None]
        wanted[doc] = tuple(sorted(s for _, s, v in mine if v is side) for side in (True, False))
    assert got == wanted


def test_foil_matrix_has_a_column_for_every_rule_set(spark):
    rows = [(1, f"s{i}", i % 2 == 0) for i in range(70)] + [(2, "s3", None), (2, None, True)]
    matrix = labels.foil_matrix(_verdicts(spark, rows), ["doc"], ["s1", "unseen"])
    assert set(matrix.columns) == {"doc", "unseen", *(f"s{i}" for i in range(70))}
    first = {r["doc"]: r for r in matrix.collect()}
    assert first[1]["s68"] is True and first[1]["s69"] is False and first[1]["unseen"] is None
    assert first[2]["s3"] is None


def test_join_raters_counts_what_a_join_would(spark):
    a = [(1, "s", True), (1, "s", False), (1, "s", True), (2, "s", True), (3, "s", False)]
    b = [(1, "s", True), (1, "s", True), (2, "s", False), (4, "s", True)]
    from tidewarden.operators import evaluation

    joined = labels.join_raters(_verdicts(spark, a), _verdicts(spark, b), ["doc", "slug"])
    total = evaluation.agreement(joined, "slug").where("slug IS NULL").first()
    matches = [(x, y) for x, y in itertools.product(a, b) if x[:2] == y[:2]]
    assert total["n_pairs"] == len(matches)
    assert total["n_equal"] == sum(x[2] == y[2] for x, y in matches)


def test_resolve_keeps_unknown_rules(spark):
    df = spark.createDataFrame([(1, "a", ["R1", "R9"]), (2, "a", [])], "i int, slug string, rules array<string>")
    catalog = spark.createDataFrame([("a", "R1", "Be kind.")], "slug string, rule_id string, rule_text string")
    got = {(r["i"], r["rule_id"]): r["rule_text"] for r in labels.resolve_rules(df, "slug", "rules", catalog).collect()}
    assert got == {(1, "R1"): "Be kind.", (1, "R9"): None}


def test_union_rows_fills_missing_columns(spark):
    both = labels.union_rows(spark.range(1).select("id"), spark.range(1).withColumn("extra", F.lit("x")))
    assert sorted((r["id"], r["extra"] or "") for r in both.collect()) == [(0, ""), (0, "x")]
