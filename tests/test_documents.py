"""Nested JSON documents: faults of shape at any depth, and values where the shape is right."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden import contracts as C
from tidewarden.functions import checks, documents
from tidewarden.operators import validation

JUDGMENT = {
    "violates_policy": True,
    "violated_rules": ["R1"],
    "severity": "low",
    "primary_category": "other",
    "evidence_spans": [],
    "suggested_action": "warn",
    "confidence": 0.5,
    "reasoning": "as the rule says",
}
CONTENT = {"text": "hello", "regime": "chat"}
FEATURES = {f: 0.5 for f in C.FEATURES}
AUDIT = {
    "session_id": "s",
    "timestamp": "2026-05-21T10:00:00Z",
    "audited_by": "human",
    "rule_set_slug": "arena_chat",
    "content": {**CONTENT, "source": "corpus", "source_stream_idx": 3, "source_hf_id": "h", "source_features": FEATURES},
    "judgment": JUDGMENT,
    "dev_mode": False,
}
HAND = {
    **AUDIT,
    "audited_by": "adversarial",
    "content": {**CONTENT, "source": "handcrafted", "source_stream_idx": None, "prior_context": ["a", "b"], "rule_set_foil": "study_hub", "edge_tested": "R1:banter"},
    "expected_classifier_disagreement": True,
}
GONE = object()


def changed(document, path, value):
    """A copy with the value at a dotted path set, or taken out."""
    name, _, rest = path.partition(".")
    copy = dict(document)
    if rest:
        copy[name] = changed(copy[name], rest, value)
    elif value is GONE:
        copy.pop(name)
    else:
        copy[name] = value
    return copy


def errors_of(spark, parse, documents_):
    rows = [(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents_)]
    parsed = parse(spark.createDataFrame(rows, "i int, line string"), "line")
    return [r["e"] for r in parsed.select("i", checks.error_text(F.col("errors")).alias("e")).orderBy("i").collect()]


CASES = [
    (validation.parse_content, CONTENT, [
        ("text", GONE, "text:missing"), ("text", 5, "text:type"), ("text", None, "text:null"), ("text", "", "text:too_short"),
        ("text", "x" * 4001, "text:too_long"), ("regime", "hybrid", "regime:enum"), ("language", None, "language:null"), ("language", "de", ""),
        ("article_title", None, ""), ("article_title", "On it", "article_title:title_forbidden"), ("regime", "comment", "article_title:title_required"),
        ("note", None, "note:extra"), ("regime", ["chat"], "regime:type"),
    ]),
    (validation.parse_audit_row, AUDIT, [
        ("content", GONE, "content:missing"), ("content", [CONTENT], "content:type"), ("content.kind", 1, "content.kind:extra"),
        ("content.source_features.toxicity", None, ""), ("content.source_features.toxicity", "high", "content.source_features.toxicity:type"),
        ("content.source_features.threat", GONE, "content.source_features.threat:missing"), ("content.source_features.odd", 1, "content.source_features.odd:extra"),
        ("content.source_features", None, "content.source_features:null"), ("content.source_stream_idx", 1.5, "content.source_stream_idx:type"),
        ("content.source_stream_idx", 2**70, "content.source_stream_idx:type"), ("content.prior_context", [], "content.prior_context:extra"),
        ("judgment.violated_rules", GONE, ""), ("judgment.violated_rules", ["R1", 7, None, {}], "judgment.violated_rules[1]:type,judgment.violated_rules[2]:null,judgment.violated_rules[3]:type"),
        ("judgment.violated_rules", "R1", "judgment.violated_rules:type"), ("judgment.violated_rules", ["R1", "R1"], "judgment.violated_rules:duplicate"),
        ("judgment.confidence", 1, ""), ("judgment.confidence", 1.5, "judgment.confidence:range"), ("judgment.severity", "HIGH", "judgment.severity:enum"),
        ("timestamp", "soon", "timestamp:type"), ("timestamp", 17, "timestamp:type"), ("dev_mode", 0, "dev_mode:type"), ("session_id", GONE, "session_id:missing"),
        ("content.text", "", "content.text:too_short"),
    ]),
    (validation.parse_adversarial_row, HAND, [
        ("content.prior_context", ["a", 1, "c", None], "content.prior_context[1]:type,content.prior_context[3]:null"), ("content.prior_context", GONE, ""),
        ("content.prior_context", None, ""), ("content.prior_context", "a", "content.prior_context:type"), ("content.rule_set_foil", GONE, ""),
        ("content.rule_set_foil", "arena_chat", "content.rule_set_foil:same"), ("content.edge_tested", GONE, "content.edge_tested:missing"),
        ("content.edge_tested", "banter", "content.edge_tested:pattern"), ("content.source", "corpus", "content.source:enum"),
        ("content.source_stream_idx", 4, "content.source_stream_idx:forbidden"), ("audited_by", "human", "audited_by:enum"),
        ("expected_classifier_disagreement", GONE, ""), ("expected_classifier_disagreement", "yes", "expected_classifier_disagreement:type"),
        ("content.source_features", FEATURES, ""), ("judgment.reasoning", None, "judgment.reasoning:null"),
    ]),
]


@pytest.mark.parametrize("parse, good, cases", CASES)
def test_faults_carry_their_path(spark, parse, good, cases):
    got = errors_of(spark, parse, [good, *(changed(good, path, value) for path, value, _ in cases)])
    assert got == ["", *(wanted for _, _, wanted in cases)]


def test_documents_that_are_none(spark):
    odd = [None, "", "{", "[]", "17", "null", '{"text":"a","text":"b","regime":"chat"}', '{"text":"a","regime":"chat"} x']
    assert errors_of(spark, validation.parse_content, odd) == [":malformed"] * 3 + [":type", ":type", ":null"] + [":malformed"] * 2


def test_defaults_are_filled_and_columns_stay(spark):
    rows = [(1, json.dumps(CONTENT), "x"), (2, json.dumps({"text": 1}), "y")]
    df = spark.createDataFrame(rows, "i int, line string, _shape string")
    got = {r["i"]: r for r in validation.parse_content(df.withColumnRenamed("_shape", "kept"), "line").collect()}
    assert got[1]["content"]["language"] == "en" and got[1]["kept"] == "x" and got[1]["errors"] == []
    assert got[2]["content"] is None and got[2]["kept"] == "y"
    bare = changed(changed(AUDIT, "judgment.violated_rules", GONE), "judgment.evidence_spans", GONE)
    row = validation.parse_audit_row(spark.createDataFrame([(json.dumps(bare),)], "line string"), "line").first()
    assert row["row"]["judgment"]["violated_rules"] == [] and row["row"]["judgment"]["evidence_spans"] == []
    assert row["row"]["timestamp"].year == 2026 and row["row"]["content"]["source_stream_idx"] == 3


def test_lists_of_objects(spark):
    kind = T.StructType([T.StructField("rules", T.ArrayType(C.RULE_SET["rules"].dataType.elementType))])
    contract = documents.Contract(kind, nullable=frozenset(["rules[].text"]))
    line = '{"rules":[{"id":"R1","text":"a"},{"id":2,"text":null},{"text":"c","more":[]},"R4"]}'
    df = spark.createDataFrame([(line,)], "line string").select(F.try_parse_json("line").alias("d"))
    errors = checks.error_text(documents.shape_errors(F.col("d"), contract))
    assert df.select(errors).first()[0] == "rules[1].id:type,rules[2].id:missing,rules[2].more:extra,rules[3]:type"
