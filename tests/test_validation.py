import json
import math

import pytest
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import checks
from tidewarden.operators import profile, validation

GOOD = {
    "violates_policy": True,
    "violated_rules": ["R1"],
    "severity": "low",
    "primary_category": "spam",
    "evidence_spans": ["a line"],
    "suggested_action": "warn",
    "confidence": 0.8,
    "reasoning": "It advertises.",
}

# One changed field -> the errors it causes.
JUDGMENTS = [
    ({}, []),
    ({"violates_policy": None}, ["violates_policy:missing"]),
    ({"violated_rules": []}, []),
    ({"violated_rules": ["R1", "R999"]}, []),
    ({"violated_rules": ["R1234"]}, ["violated_rules:pattern"]),
    ({"violated_rules": ["r1"]}, ["violated_rules:pattern"]),
    ({"violated_rules": [" R1"]}, ["violated_rules:pattern"]),
    ({"violated_rules": ["R1\n"]}, ["violated_rules:pattern"]),
    ({"violated_rules": ["R١"]}, []),
    ({"violated_rules": [None]}, ["violated_rules:pattern"]),
    ({"violated_rules": ["R1", "R1"]}, ["violated_rules:duplicate"]),
    ({"violated_rules": [f"R{i}" for i in range(10)]}, []),
    ({"violated_rules": [f"R{i}" for i in range(11)]}, ["violated_rules:too_many"]),
    ({"violated_rules": None}, ["violated_rules:missing"]),
    ({"severity": "HIGH"}, ["severity:enum"]),
    ({"severity": None}, ["severity:missing"]),
    ({"primary_category": "rude"}, ["primary_category:enum"]),
    ({"suggested_action": ""}, ["suggested_action:enum"]),
    ({"evidence_spans": []}, []),
    ({"evidence_spans": ["x"] * 5}, []),
    ({"evidence_spans": ["x"] * 6}, ["evidence_spans:too_many"]),
    ({"evidence_spans": ["x" * 300]}, []),
    ({"evidence_spans": ["x" * 301]}, ["evidence_spans:span_length"]),
    ({"evidence_spans": [""]}, ["evidence_spans:span_length"]),
    ({"confidence": 0.0}, []),
    ({"confidence": 1.0}, []),
    ({"confidence": -0.01}, ["confidence:range"]),
    ({"confidence": 1.01}, ["confidence:range"]),
    ({"confidence": math.nan}, ["confidence:range"]),
    ({"confidence": None}, ["confidence:missing"]),
    ({"reasoning": ""}, ["reasoning:too_short"]),
    ({"reasoning": "x" * 400}, []),
    ({"reasoning": "x" * 401}, ["reasoning:too_long"]),
    ({"severity": "x", "confidence": 2.0}, ["confidence:range", "severity:enum"]),
]


def _judged(spark, changes):
    rows = [(i, {**GOOD, **c}) for i, c in enumerate(changes)]
    schema = f"i int, judgment {C.JUDGMENT.simpleString()}"
    return spark.createDataFrame(rows, schema)


def _words(df):
    rows = df.select("i", checks.error_text(F.col("errors")).alias("e")).orderBy("i").collect()
    return [r["e"].split(",") if r["e"] else [] for r in rows]


def test_judgment_contract(spark):
    df = validation.validate_judgment(_judged(spark, [c for c, _ in JUDGMENTS]))
    assert _words(df) == [e for _, e in JUDGMENTS]


def test_failing_fields_are_sorted_and_distinct(spark):
    df = _judged(spark, [{"severity": "x", "confidence": 3.0, "violated_rules": ["x"] * 11}])
    errors = validation.validate_judgment(df).select(checks.failing_fields(F.col("errors")))
    assert errors.first()[0] == ["confidence", "severity", "violated_rules"]


def _rule_set(**changes):
    rules = [{"id": f"R{i}", "text": f"Rule {i}"} for i in range(1, 4)]
    return {
        "slug": "my_set",
        "name": "My set",
        "regime": "chat",
        "description": "A set of rules for testing.",
        "rules": rules,
        "version": 1,
        "created": "2026-01-05",
        **changes,
    }


def _rules(n):
    return [{"id": f"R{i}", "text": "t"} for i in range(1, n + 1)]


RULE_SETS = [
    ({}, []),
    ({"slug": "My-Set"}, ["slug:pattern"]),
    ({"slug": "my_set\n"}, ["slug:pattern"]),
    ({"slug": "a" * 65}, ["slug:too_long"]),
    ({"name": ""}, ["name:too_short"]),
    ({"name": "x" * 121}, ["name:too_long"]),
    ({"regime": "hybrid"}, []),
    ({"regime": "forum"}, ["regime:enum"]),
    ({"description": "x" * 19}, ["description:too_short"]),
    ({"description": "x" * 501}, ["description:too_long"]),
    ({"rules": _rules(2)}, ["rules:too_few"]),
    ({"rules": _rules(20)}, []),
    ({"rules": _rules(21)}, ["rules:too_many"]),
    ({"rules": [*_rules(3), {"id": "R1", "text": "t"}]}, ["rules:duplicate"]),
    ({"rules": [*_rules(3), {"id": "X1", "text": "t"}]}, ["rules:pattern"]),
    ({"rules": [*_rules(3), {"id": "R9", "text": "x" * 301}]}, ["rules:text_length"]),
    ({"created": None}, ["created:missing"]),
]


def test_rule_set_contract(spark):
    rows = [(i, json.dumps(_rule_set(**c))) for i, (c, _) in enumerate(RULE_SETS)]
    df = spark.createDataFrame(rows, "i int, j string").select(
        "i", F.from_json("j", C.RULE_SET).alias("rule_set")
    )
    assert _words(validation.validate_rule_set(df)) == [e for _, e in RULE_SETS]


CONTENTS = [
    (("x", "chat", None, "en"), []),
    (("x", "comment", "Title", "en"), []),
    (("", "chat", None, "en"), ["text:too_short"]),
    (("x" * 4000, "chat", None, "en"), []),
    (("x" * 4001, "chat", None, "en"), ["text:too_long"]),
    (("x", "hybrid", None, "en"), ["regime:enum"]),
    (("x", "comment", None, "en"), ["article_title:title_required"]),
    (("x", "chat", "Title", "en"), ["article_title:title_forbidden"]),
    (("x", "comment", "", "en"), ["article_title:title_length"]),
    (("x", "comment", "t" * 300, "en"), []),
    (("x", "comment", "t" * 301, "en"), ["article_title:title_length"]),
    ((None, "chat", None, "en"), ["text:missing"]),
]


def test_content_contract(spark):
    rows = [(i, c) for i, (c, _) in enumerate(CONTENTS)]
    df = spark.createDataFrame(rows, f"i int, content {C.CONTENT.simpleString()}")
    assert _words(validation.validate_content(df)) == [e for _, e in CONTENTS]


def _without(*fields):
    return {k: v for k, v in GOOD.items() if k not in fields}


# JSON line -> strict errors, lenient errors.
LINES = [
    (json.dumps(GOOD), [], []),
    ("", [":malformed"], [":malformed"]),
    ("{", [":malformed"], [":malformed"]),
    ("[1]", [":malformed"], [":malformed"]),
    ("null", [":malformed"], [":malformed"]),
    (None, [":malformed"], [":malformed"]),
    (json.dumps(_without("violated_rules", "evidence_spans")), [], []),
    (json.dumps(_without("reasoning")), ["reasoning:missing"], ["reasoning:missing"]),
    (json.dumps({**GOOD, "note": 1}), ["note:extra"], ["note:extra"]),
    (json.dumps({**GOOD, "violates_policy": "yes"}), ["violates_policy:type"], []),
    (json.dumps({**GOOD, "violates_policy": 1}), ["violates_policy:type"], []),
    (json.dumps({**GOOD, "violates_policy": 2}), ["violates_policy:type"] , ["violates_policy:type"]),
    (json.dumps({**GOOD, "violates_policy": "maybe"}), ["violates_policy:type"], ["violates_policy:type"]),
    (json.dumps({**GOOD, "violates_policy": None}), ["violates_policy:type"], ["violates_policy:type"]),
    (json.dumps({**GOOD, "confidence": "0.9"}), ["confidence:type"], []),
    (json.dumps({**GOOD, "confidence": True}), ["confidence:type"], []),
    (json.dumps({**GOOD, "confidence": 1}), [], []),
    (json.dumps({**GOOD, "confidence": 1.5}), ["confidence:range"], ["confidence:range"]),
    (json.dumps({**GOOD, "reasoning": 5}), ["reasoning:type"], ["reasoning:type"]),
    (json.dumps({**GOOD, "reasoning": {"a": 1}}), ["reasoning:type"], ["reasoning:type"]),
    (json.dumps({**GOOD, "severity": "HIGH"}), ["severity:enum"], ["severity:enum"]),
    (json.dumps({**GOOD, "violated_rules": None}), ["violated_rules:type"], ["violated_rules:type"]),
    (json.dumps({**GOOD, "violated_rules": [1]}), ["violated_rules:type"], ["violated_rules:type"]),
    (json.dumps({**GOOD, "violated_rules": "R1"}), ["violated_rules:type"], ["violated_rules:type"]),
    (json.dumps({**GOOD, "violated_rules": []}), [], []),
    ('{"severity": "low", ' + json.dumps(GOOD)[1:], [":malformed"], [":malformed"]),
]


@pytest.mark.parametrize("lax", [False, True])
def test_parse_judgment(spark, lax):
    df = spark.createDataFrame([(i, line[0]) for i, line in enumerate(LINES)], "i int, j string")
    parsed = validation.parse_judgment(df, "j", lax=lax)
    assert _words(parsed) == [line[1 + lax] for line in LINES]
    first = parsed.where("i = 0").first()["judgment"].asDict()
    assert first == GOOD
    defaults = parsed.where("i = 6").first()["judgment"]
    assert defaults["violated_rules"] == [] and defaults["evidence_spans"] == []


def test_split_and_gate(spark):
    checked = validation.validate_judgment(_judged(spark, [{}, {"severity": "x"}, {}]))
    valid, quarantine = validation.split_valid(checked)
    assert (valid.count(), quarantine.count()) == (2, 1)
    with pytest.raises(validation.ContractError, match="severity:enum x1"):
        validation.gate_all_or_nothing(checked)
    rest = validation.validate_judgment(valid)
    assert validation.gate_all_or_nothing(rest).count() == 2


def _checked(spark, rows):
    """(file, row, words): rows with an error for each word."""
    df = spark.createDataFrame(rows, "file string, i int, words array<string>")
    wrong = F.transform("words", lambda w: F.struct(w.alias("loc"), F.lit("odd").alias("type")))
    return df.withColumn("errors", wrong).drop("words")


def test_the_gate_reports_every_failure(spark):
    """More kinds than a message names, and every failing row in the error's table."""
    checked = _checked(spark, [("a", i, [f"w{i}", "all"]) for i in range(120)] + [("b", 500, [])])
    with pytest.raises(validation.ContractError, match="240 failures of 121 kinds: all:odd x120") as raised:
        validation.gate_all_or_nothing(checked)
    assert raised.value.failures.count() == 240
    assert raised.value.failures.where("loc = 'w77'").first()["i"] == 77


def test_one_invalid_row_holds_back_its_batch(spark):
    rows = [("a", 1, []), ("a", 2, ["x", "y"]), ("a", 3, ["x"]), ("b", 4, []), (None, 5, []), (None, 6, ["z"]), ("c", 7, [])]
    checked = _checked(spark, rows)
    assert sorted(r["i"] for r in validation.gate_each(checked, ["file"]).collect()) == [4, 7]
    got = {r["file"]: tuple(r)[1:] for r in validation.gate_report(checked, ["file"]).collect()}
    assert got == {
        "a": (3, 2, False, "x:odd:2,y:odd:1"),
        "b": (1, 0, True, ""),
        "c": (1, 0, True, ""),
        None: (2, 1, False, "z:odd:1"),
    }


def test_rule_membership_keeps_rows_of_unknown_sets(spark):
    df = spark.createDataFrame(
        [(1, "a", ["R1", "R9"]), (2, "a", []), (3, "zzz", ["R1"])],
        "i int, slug string, rules array<string>",
    )
    catalog = spark.createDataFrame([("a", "R1"), ("a", "R2")], "slug string, rule_id string")
    found = validation.check_rule_membership(df, "slug", "rules", catalog)
    assert {r["i"]: r["unknown_rules"] for r in found.collect()} == {1: ["R9"], 2: [], 3: ["R1"]}


def test_source_rows(spark):
    df = spark.createDataFrame(
        [(0, "t", "1"), (1, None, "0"), (2, "t", "x"), (3, None, None)], "i int, text string, flag string"
    )
    assert _words(validation.check_source_row(df, "text", ["flag"])) == [
        [],
        ["text:missing"],
        ["flag:not_a_number"],
        ["flag:not_a_number", "text:missing"],
    ]


def test_require_nonempty_and_warn_short(spark):
    empty = spark.range(0)
    with pytest.raises(validation.ContractError):
        validation.require_nonempty(empty, "the corpus")
    assert validation.require_nonempty(spark.range(1), "the corpus").count() == 1
    assert validation.warn_short(spark.range(3), 5).first().asDict() == {
        "found": 3,
        "wanted": 5,
        "short": True,
    }


def test_catalog_report_lists_failures(spark):
    rows = [("my_set.yaml", json.dumps(_rule_set())), ("other.yaml", json.dumps(_rule_set(rules=_rules(2))))]
    from tidewarden.sources.rule_sets import rule_sets_from_json

    parsed = rule_sets_from_json(spark.createDataFrame(rows, "file_name string, document string"))
    report = {r["file_name"]: (r["n_rules"], r["outcome"]) for r in profile.catalog_report(parsed).collect()}
    assert report == {"my_set.yaml": (3, "OK"), "other.yaml": (2, "FAIL")}
