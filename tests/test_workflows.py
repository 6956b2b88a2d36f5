import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_validation import GOOD
from tidewarden import contracts as C
from tidewarden import workflows
from tidewarden.operators import validation


def _corpus(spark, n=400):
    df = spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit("a short text").alias("text"))
    number = F.col("key").cast("int")
    values = {s: F.when(number % 7 == i, 0.8).otherwise(0.0) for i, s in enumerate(C.SCORES)}
    return df.withColumns(values).withColumn("insult", F.lit(None).cast("double"))


def _lines(path):
    files = sorted(Path(path).glob("*.json"))
    return [json.loads(line) for f in files for line in f.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def inbox_path(spark, tmp_path):
    path = str(tmp_path / "inbox")
    filled = workflows.write_inbox(_corpus(spark), "key", path, scan_rows=300)
    got = {r["bucket"]: (r["got"], r["target"]) for r in filled.collect()}
    assert got["threat"] == (7, 7) and got["identity_attack"] == (10, 10) and got["mid_tox"] == (0, 10)
    return path


def _label(tmp_path, lines):
    (tmp_path / "labels.json").write_text("\n\n".join(json.dumps(x) for x in lines))
    return str(tmp_path / "labels.json")


def _approve(spark, inbox_path, labels_path, out):
    return workflows.approve_labels(
        workflows.read_inbox(spark, inbox_path),
        workflows.read_labels(spark, labels_path),
        out,
        "batch-1",
        F.lit("2026-01-05 09:00:00"),
        "arena_chat",
        "chat",
        "corpus",
        "draft",
    )


def test_inbox_rows_have_every_key_in_target_order(inbox_path):
    rows = _lines(inbox_path)
    assert list(rows[0]) == ["_stream_idx", "bucket", "text", "hf_id", "features", "sexual_explicit"]
    assert rows[0]["features"]["insult"] == 0.0
    order = [list(C.BUCKET_TARGETS).index(r["bucket"]) for r in rows]
    assert order == sorted(order)


def test_labels_become_approved_rows(spark, tmp_path, inbox_path):
    rows = _lines(inbox_path)
    judgments = [{**GOOD, "violates_policy": r["bucket"] == "threat", "confidence": 0.6 if i == 0 else 0.9}
                 for i, r in enumerate(rows)]
    path = _label(tmp_path, [{"_stream_idx": r["_stream_idx"], "judgment": j} for r, j in zip(rows, judgments)])
    review = _approve(spark, inbox_path, path, str(tmp_path / "out"))
    written = {r["content"]["source_stream_idx"]: r for r in _lines(tmp_path / "out")}
    assert len(written) == len(rows)
    first = written[rows[0]["_stream_idx"]]
    assert first["timestamp"] == "2026-01-05T09:00:00Z" == first["provenance"]["reviewed_at"]
    assert first["judgment"] == judgments[0] and first["content"]["bucket"] == rows[0]["bucket"]
    assert review.summary.first().asDict() == {"total": len(rows), "violations": 7, "low_confidence": 1}
    total = review.buckets.where("bucket IS NULL").first()
    assert (total["n_rows"], total["n_flagged"]) == (len(rows), 7)
    assert [r["number"] for r in review.lines.orderBy("number").collect()] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("fault, message", [
    ("missing", "unlabelled x1"),
    ("extra", "orphan_label x1"),
    ("repeated", "repeated_label x1"),
    ("invalid", "severity:enum x1"),
    ("typo", "note:extra x1"),
])
def test_any_fault_writes_nothing(spark, tmp_path, inbox_path, fault, message):
    lines = [{"_stream_idx": r["_stream_idx"], "judgment": dict(GOOD)} for r in _lines(inbox_path)]
    if fault == "missing":
        lines.pop()
    elif fault == "extra":
        lines.append({"_stream_idx": 10**6, "judgment": GOOD})
    elif fault == "repeated":
        lines.append(lines[0])
    elif fault == "invalid":
        lines[3]["judgment"]["severity"] = "worst"
    else:
        lines[3]["judgment"]["note"] = "?"
    with pytest.raises(validation.ContractError, match=message):
        _approve(spark, inbox_path, _label(tmp_path, lines), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_rule_set_folder_report(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"slug": "a"}))
    row = workflows.check_rule_sets(spark, str(tmp_path)).first()
    assert (row["file_name"], row["outcome"]) == ("a.json", "FAIL")
