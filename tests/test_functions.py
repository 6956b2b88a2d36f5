import math

import pytest

from tidewarden import contracts as C
from tidewarden.functions import scores, text


@pytest.mark.parametrize(
    "regime, lengths, wanted",
    [
        ("chat", [0, 4, 5, 149, 150, 1000], [False, False, True, True, False, False]),
        ("comment", [4, 5, 149, 150, 1000, 1001], [False, True, True, True, True, False]),
        ("hybrid", [4, 5, 150, 1000, 1001], [False, True, True, True, False]),
    ],
)
def test_passes_length(column, regime, lengths, wanted):
    texts = ["x" * n for n in lengths]
    assert column(texts, "string", lambda x: text.passes_length(x, regime)) == wanted


def test_length_counts_code_points(column):
    assert column(["\U0001f600" * 5], "string", lambda x: text.passes_length(x, "chat")) == [True]


def test_strip_takes_unicode_whitespace(column):
    values = [" \t\xa0a b　\n", "\x1cx\x85", "", None, " "]
    wanted = [v.strip() if v is not None else None for v in values]
    assert column(values, "string", text.strip) == wanted


def test_source_id_of_null_is_null(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "1"), ("a", None)], "t string, i string")
    got = [r[0] for r in df.select(text.source_id(F.col("t"), F.col("i"))).collect()]
    assert len(got[0]) == 64 and got[1] is None


def test_normalise_flag(column):
    values = ["Y", " yes\n", "TRUE", "1", "n", "No", "false", "0", "maybe", "", None, "on"]
    wanted = [True] * 4 + [False] * 4 + [None] * 4
    assert column(values, "string", text.normalise_flag) == wanted


def test_normalise_enum(column):
    values = ["1", " 4 ", "04", "0", "5", "-1", "+1", "LOW", "critical\t", "lo", "", None, "9" * 12, "0" * 20 + "2", "0" * 12, "10000000001"]
    wanted = ["low", "critical", "critical", None, None, None, None, "low", "critical"] + [None] * 4 + ["moderate", None, None]
    assert column(values, "string", lambda x: text.normalise_enum(x, C.SEVERITIES)) == wanted


def test_normalise_rule_list(column):
    from pyspark.sql import functions as F

    known = F.array(*[F.lit(f"R{i}") for i in range(1, 13)])
    values = ["", " , ", "R1,R2", " R2 ,,\tR1", "R99", "R1,R1", ",".join(f"R{i}" for i in range(1, 12)), None, "r1"]
    got = column(values, "string", lambda x: text.normalise_rule_list(x, known))
    assert [(r["value"], r["error"]) for r in got] == [
        ([], None),
        ([], None),
        (["R1", "R2"], None),
        (["R2", "R1"], None),
        (None, "unknown"),
        (None, "duplicate"),
        (None, "too_many"),
        (None, "missing"),
        (None, "unknown"),
    ]


def test_normalise_spans(column):
    values = [
        [],
        ["a", " b ", "", "c"],
        list("abcdef"),
        ["x" * 300],
        ["x" * 301],
        ["a", "", "x" * 301],
        None,
    ]
    got = column(values, "array<string>", text.normalise_spans)
    assert [(r["value"], r["error"]) for r in got] == [
        ([], None),
        (["a", "b"], None),
        (list("abcde"), None),
        (["x" * 300], None),
        (None, "too_long"),
        (["a"], None),
        (None, "missing"),
    ]


def test_normalise_confidence(column):
    values = ["0", " 1.0 ", ".5", "5e-1", "1.01", "-0.01", "nan", "inf", "0.5d", "0.5f", "", "x", None]
    wanted = [0.0, 1.0, 0.5, 0.5] + [None] * 9
    assert column(values, "string", text.normalise_confidence) == wanted


def test_normalise_reasoning(column):
    values = ["", "  ", " a ", "x" * 400, "x" * 401, " " + "x" * 400 + "\n", None]
    wanted = [None, None, "a", "x" * 400, None, "x" * 400, None]
    assert column(values, "string", text.normalise_reasoning) == wanted


def test_longest_line_run(column):
    values = ["a\na\na\nb", "a\n\na\n \na", "a\nb\na", "", None, "b\na\na\nb\nb\nb"]
    assert column(values, "string", text.longest_line_run) == [3, 3, 1, 0, None, 3]


def test_score_or_zero(column):
    got = column([0.3, None, math.nan], "double", scores.score_or_zero)
    assert got == [0.3, 0.0, 0.0]


def test_two_decimals_rounds_as_c_does(column):
    values = [0.125, 0.135, 1.005, 0.5, 0.999, 1.0, 0.0, 0.045]
    assert column(values, "double", scores.two_decimals) == [f"{v:.2f}" for v in values]
    assert column([None, 0.25], "double", scores.show_score) == ["?", "0.25"]


def _rows(spark, rows):
    schema = ", ".join(f"{s} double" for s in C.SCORES)
    return spark.createDataFrame([tuple(r.get(s) for s in C.SCORES) for r in rows], schema)


def test_bucket_priority_bounds_null_and_nan(spark):
    rows = [
        {"identity_attack": 0.4, "threat": 0.9},
        {"identity_attack": 0.39, "threat": 0.4},
        {"sexual_explicit": 0.4, "toxicity": 0.9},
        {"toxicity": 0.7},
        {"toxicity": 0.3},
        {"toxicity": 0.29},
        {},
        {"toxicity": math.nan, "threat": math.nan},
    ]
    wanted = ["identity_attack", "threat", "sexual_explicit", "high_tox", "mid_tox"] + ["low_tox"] * 3
    assert [r[0] for r in _rows(spark, rows).coalesce(1).select(scores.bucket()).collect()] == wanted


def test_band_order_and_gap(spark):
    rows = [
        {"toxicity": 0.51},
        {"toxicity": 0.5},
        {"toxicity": 0.2, "threat": 0.9},
        {"toxicity": 0.15, "threat": 0.3},
        {"toxicity": 0.15, "threat": 0.29},
        {"toxicity": 0.09},
        {},
    ]
    wanted = ["high", "mid", "mid", "category", "unassigned", "clean", "clean"]
    assert [r[0] for r in _rows(spark, rows).coalesce(1).select(scores.band()).collect()] == wanted
