import json
import os

import pytest
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import checks
from tidewarden.session import scratch_dir
from tidewarden.sources import rule_sets, tables

YAML = """
slug: {slug}
name: Quiet corner
regime: chat
description: >-
  Rules for a small reading room, with a text
  that runs over two lines.
created: 2026-01-05
rules:
  - id: R1
    text: Speak softly.
  - id: R2
    text: "No shouting: not even in capitals."
  - id: R3
    text: Put books back.
"""


def test_yaml_files_without_a_reader_are_not_called_malformed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rule_sets, "yaml", None)
    (tmp_path / "good.yaml").write_text(YAML.format(slug="good"))
    (tmp_path / "short.json").write_text(json.dumps({"slug": "short", "rules": []}))
    loaded = rule_sets.load_rule_sets(spark, str(tmp_path))
    errors = {r["file_name"]: r["e"] for r in loaded.select("file_name", checks.error_text(F.col("errors")).alias("e")).collect()}
    assert errors["good.yaml"] == ":unread" and "rules:too_few" in errors["short.json"]


@pytest.mark.skipif(rule_sets.yaml is None, reason="needs the yaml package")
def test_load_rule_sets(spark, tmp_path):
    files = {
        "quiet_corner.yaml": YAML.format(slug="quiet_corner"),
        "wrong_name.yml": YAML.format(slug="other_name"),
        "extra.yaml": YAML.format(slug="extra") + "colour: red\n",
        "inner.yaml": YAML.format(slug="inner") + "    note: x\n",
        "number.yaml": YAML.format(slug="number") + "  - id: R4\n    text: 12\n",
        "unnamed.yaml": YAML.format(slug="unnamed").replace("Quiet corner", "5"),
        "broken.yaml": "slug: [",
        "list.yaml": "- a\n- b\n",
        "date.yaml": YAML.format(slug="date").replace("2026-01-05", "2026-13-45"),
        "keys.yaml": YAML.format(slug="keys") + "? [1, 2]\n: x\n",
        "short.json": json.dumps({"slug": "short", "rules": []}),
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    loaded = rule_sets.load_rule_sets(spark, str(tmp_path))
    errors = {r["file_name"]: r["e"] for r in loaded.select("file_name", checks.error_text(F.col("errors")).alias("e")).collect()}
    assert errors["quiet_corner.yaml"] == ""
    assert errors["wrong_name.yml"] == "slug:file_mismatch"
    assert errors["extra.yaml"] == "colour:extra"
    assert errors["inner.yaml"] == "rules:extra" and errors["number.yaml"] == "rules:type"
    assert errors["unnamed.yaml"] == "name:type"
    assert errors["broken.yaml"] == ":malformed" and errors["list.yaml"] == ":malformed"
    assert errors["date.yaml"] == ":malformed" and errors["keys.yaml"] == ":malformed"
    assert "rules:too_few" in errors["short.json"] and "created:missing" in errors["short.json"]
    good = loaded.where("file_name = 'quiet_corner.yaml'").first()["rule_set"]
    assert good["version"] == 1 and str(good["created"]) == "2026-01-05"
    assert good["description"].endswith("text that runs over two lines.")
    rules = rule_sets.rule_table(loaded).orderBy("rule_id").collect()
    assert [(r["slug"], r["rule_id"]) for r in rules] == [("quiet_corner", f"R{i}") for i in (1, 2, 3)]
    assert rules[1]["rule_text"] == "No shouting: not even in capitals."


def test_jsonl_keeps_nulls_and_skips_blank_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("1", None), ("2", "naïve \U0001f600")], "id string, text string")
    tables.write_jsonl(df.coalesce(1), path)
    lines = [line for f in os.listdir(path) if f.endswith(".json") for line in open(f"{path}/{f}", encoding="utf-8")]
    assert {"id": "1", "text": None} in [json.loads(line) for line in lines]
    assert any("\U0001f600" in line for line in lines)
    with open(f"{path}/more.json", "w", encoding="utf-8") as f:
        f.write('\n\n{"id": "3", "text": "x"}\n\n')
    assert sorted(r["id"] for r in tables.read_jsonl(spark, path, df.schema).collect()) == ["1", "2", "3"]
    tables.append_jsonl(df, path)
    assert tables.read_jsonl(spark, path, df.schema).count() == 5
    tables.write_jsonl(df, path)
    assert tables.read_jsonl(spark, path, df.schema).count() == 2


def test_read_sessions_skips_unreadable_files(spark, tmp_path):
    state = {
        "session_id": "s1", "rule_set_slug": "a", "target_n": 15, "n_completed": 2, "cursor": 3,
        "skips_used": 1, "seed": 7, "started_at": "2026-01-05T09:00:00Z",
        "last_activity_at": "2026-01-05T09:10:00Z", "ended_at": None, "ended_reason": None,
        "warned_25min": False, "dev_mode": False,
    }
    (tmp_path / "s1.json").write_text(json.dumps(state, indent=2))
    (tmp_path / "s2.json").write_text(json.dumps({**state, "session_id": "s2", "ended_at": "2026-01-05T09:20:00Z"}))
    (tmp_path / "junk.json").write_text("{not json")
    (tmp_path / "other.json").write_text('{"a": 1}')
    os.utime(tmp_path / "s1.json", (2_000_000_000, 2_000_000_000))
    got = tables.read_sessions(spark, str(tmp_path)).orderBy("session_id").collect()
    assert [r["session_id"] for r in got] == ["s1", "s2"]
    assert got[0]["ended_at"] is None and got[0]["n_completed"] == 2
    assert str(got[1]["ended_at"]) == "2026-01-05 09:20:00"
    from tidewarden.operators import sessions

    df = tables.read_sessions(spark, str(tmp_path)).withColumn("auditor", F.lit("x"))
    assert sessions.latest_session(df, ["auditor"], "modified_at").first()["session_id"] == "s1"


def test_held_out_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\n\n b \nc\n")
    got = tables.read_held_out(spark, str(tmp_path / "ids.txt"))
    assert sorted(r["source_id"] for r in got.collect()) == ["a", "b", "c"]


def test_scan_corpus_with_schema_and_report(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame([("1", "t", 0.5, "x")], "id string, text string, toxicity double, more string").write.parquet(path)
    df = tables.scan_corpus(spark, path, C.CORPUS_SCORES)
    row = df.first()
    assert (row["toxicity"], row["insult"]) == (0.5, None)
    report = {r["column"]: r["type"] for r in tables.source_schema(df).collect()}
    assert report["text"] == "string" and report["toxicity"] == "double" and len(report) == 9


def test_manifest_ids_repeat(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")

    def rows():
        made = tables.manifest(df, "text", F.lit("gen"), F.lit("prompt"), F.lit("2026-01-05 09:00:00"))
        return sorted(r["id"] for r in made.collect())

    assert rows() == rows() and len(set(rows())) == 2


def test_scratch_is_below_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path != scratch_dir(spark, "x")
    if base:
        assert path.startswith(base.rstrip("/"))
