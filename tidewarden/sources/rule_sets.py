"""Rule-set files -> catalog tables."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import checks

try:
    import yaml
except ImportError:  # YAML catalogs need the yaml package on the executors
    yaml = None

# The converter travels to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


UNREAD = "no YAML reader"


def _to_json(text: str) -> str | None:
    """None for what is no YAML, or YAML that no JSON text can hold: a bad date, a cycle, odd keys."""
    try:
        return json.dumps(yaml.safe_load(text), default=str, allow_nan=False)
    except (yaml.YAMLError, ValueError, TypeError, OverflowError, RecursionError):
        return None


def _yaml_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if yaml is None:
            yield batch.assign(document=None, unread=UNREAD)
        else:
            yield batch.assign(document=batch["document"].map(_to_json), unread=None)


def load_rule_sets(spark: SparkSession, path: str) -> DataFrame:
    """Rule-set files, one document each -> file_name, rule_set, errors.

    YAML and JSON files may be mixed in a folder. A file that cannot be read, has unknown keys,
    breaks the contract or has another name than its slug keeps its row and gets errors, and the
    other files are read all the same. Where the executors have no YAML reader, YAML files get the
    error `unread` instead of being called malformed.
    """
    files = (
        spark.read.text(path, wholetext=True)
        .select("value", F.col("_metadata.file_name").alias("file_name"))
        .select("file_name", F.col("value").alias("document"))
    )
    is_json = F.col("file_name").endswith(".json")
    converted = files.where(~is_json).mapInPandas(
        _yaml_batches, "file_name string, document string, unread string"
    )
    plain = files.where(is_json).withColumn("unread", F.lit(None).cast("string"))
    checked = rule_sets_from_json(plain.unionByName(converted))
    unread = checks.gather(checks.failure("", "unread", F.lit(True)))
    errors = F.when(F.col("unread").isNotNull(), unread).otherwise(F.col("errors"))
    return checked.withColumn("errors", errors).drop("unread")


def rule_sets_from_json(files: DataFrame) -> DataFrame:
    """file_name, document (JSON text) -> file_name, rule_set, errors; other columns stay."""
    raw, rule_set = F.col("document"), F.col("rule_set")
    required = [f for f in C.RULE_SET_FIELDS if f != "version"]
    parsed = files.withColumns(
        {
            "_keys": F.json_object_keys(raw),
            "_document": F.try_parse_json(raw),
            "_rules": F.from_json(raw, "rules array<map<string,variant>>")["rules"],
            "rule_set": F.from_json(raw, C.RULE_SET),
        }
    )
    version = F.coalesce("rule_set.version", F.lit(1))
    parsed = parsed.withColumn("rule_set", rule_set.withField("version", version))
    shape = F.concat(
        checks.key_errors(checks.extra_keys(F.col("_keys"), C.RULE_SET_FIELDS), "extra"),
        checks.key_errors(checks.missing_keys(F.col("_keys"), required), "missing"),
        checks.gather(*_type_failures(F.col("_document"), F.col("_rules"))),
    )
    values = F.concat(
        checks.rule_set_errors(rule_set), checks.slug_file_errors(rule_set.slug, F.col("file_name"))
    )
    errors = F.when(F.col("_keys").isNull(), checks.malformed()).otherwise(
        F.array_distinct(F.concat(shape, values))
    )
    return parsed.withColumn("errors", errors).drop(
        "document", "_keys", "_document", "_rules"
    )


def _type_failures(document: Column, rules: Column) -> list[Column]:
    """`from_json` takes any value for a text, so the JSON types are looked at here."""
    kinds = {"slug": "STRING", "name": "STRING", "regime": "STRING", "description": "STRING"}
    kinds["version"] = "BIGINT"
    fields = [
        checks.failure(
            field,
            "type",
            F.schema_of_variant(F.try_variant_get(document, f"$.{field}", "variant")) != kind,
        )
        for field, kind in kinds.items()
    ]
    known = F.array(F.lit("id"), F.lit("text"))
    extra = F.exists(rules, lambda r: F.size(F.array_except(F.map_keys(r), known)) > 0)
    odd = F.exists(
        rules,
        lambda r: F.exists(F.map_values(r), lambda v: F.schema_of_variant(v) != "STRING"),
    )
    return [
        *fields,
        checks.failure("rules", "extra", extra),
        checks.failure("rules", "type", odd),
    ]


def rule_table(validated: DataFrame) -> DataFrame:
    """One row per rule of the valid rule sets: slug, regime, rule_id, rule_text."""
    valid = validated.where(F.size("errors") == 0)
    return valid.select(
        F.col("rule_set.slug").alias("slug"),
        F.col("rule_set.regime").alias("regime"),
        F.explode("rule_set.rules").alias("rule"),
    ).select(
        "slug", "regime", F.col("rule.id").alias("rule_id"), F.col("rule.text").alias("rule_text")
    )
