"""Contract checks as expressions that collect every error of a row.

Each check gives `array<struct<loc, type>>`; a row is valid when the array is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden import contracts as C

ERRORS_TYPE = "array<struct<loc:string,type:string>>"


def failure(loc: str, kind: str, broken: Column) -> Column:
    return F.when(broken, F.expr(f"named_struct('loc', '{loc}', 'type', '{kind}')"))


def gather(*failures: Column) -> Column:
    return F.array_compact(F.array(*failures))


def length_failures(loc: str, text: Column, shortest: int, longest: int) -> list[Column]:
    return [
        failure(loc, "missing", text.isNull()),
        failure(loc, "too_short", F.length(text) < shortest),
        failure(loc, "too_long", F.length(text) > longest),
    ]


def enum_failures(loc: str, value: Column, allowed: Sequence[str]) -> list[Column]:
    return [
        failure(loc, "missing", value.isNull()),
        failure(loc, "enum", ~value.isin(*allowed)),
    ]


def judgment_errors(judgment: Column) -> Column:
    """Errors of a judgment struct."""
    rules, spans = judgment.violated_rules, judgment.evidence_spans
    odd_rule = F.exists(rules, lambda r: r.isNull() | ~r.rlike(C.RULE_ID_PATTERN))
    many_rules = F.size(rules) > C.MAX_VIOLATED_RULES
    return gather(
        failure("violates_policy", "missing", judgment.violates_policy.isNull()),
        failure("violated_rules", "missing", rules.isNull()),
        failure("violated_rules", "too_many", many_rules),
        failure("violated_rules", "pattern", odd_rule),
        failure(
            "violated_rules",
            "duplicate",
            (F.size(F.array_distinct(rules)) < F.size(rules)) & ~many_rules & ~odd_rule,
        ),
        *enum_failures("severity", judgment.severity, C.SEVERITIES),
        *enum_failures("primary_category", judgment.primary_category, C.CATEGORIES),
        failure("evidence_spans", "missing", spans.isNull()),
        failure("evidence_spans", "too_many", F.size(spans) > C.MAX_SPANS),
        failure(
            "evidence_spans",
            "span_length",
            F.exists(spans, lambda s: s.isNull() | ~F.length(s).between(1, C.MAX_SPAN_CHARS)),
        ),
        *enum_failures("suggested_action", judgment.suggested_action, C.ACTIONS),
        failure("confidence", "missing", judgment.confidence.isNull()),
        failure("confidence", "range", ~judgment.confidence.between(0.0, 1.0)),
        *length_failures("reasoning", judgment.reasoning, 1, C.MAX_REASONING_CHARS),
    )


def rule_set_errors(rule_set: Column) -> Column:
    """Errors of a rule-set struct."""
    rules = rule_set.rules
    ids = F.transform(rules, lambda r: r.id)
    odd_id = F.exists(ids, lambda i: i.isNull() | ~i.rlike(C.RULE_ID_PATTERN))
    return gather(
        failure("slug", "missing", rule_set.slug.isNull()),
        failure("slug", "pattern", ~rule_set.slug.rlike(C.SLUG_PATTERN)),
        failure("slug", "too_long", F.length(rule_set.slug) > C.MAX_SLUG_CHARS),
        *length_failures("name", rule_set["name"], 1, C.MAX_NAME_CHARS),
        *enum_failures("regime", rule_set.regime, C.REGIMES),
        *length_failures(
            "description",
            rule_set.description,
            C.MIN_DESCRIPTION_CHARS,
            C.MAX_DESCRIPTION_CHARS,
        ),
        failure("rules", "missing", rules.isNull()),
        failure("rules", "too_few", F.size(rules) < C.MIN_RULES),
        failure("rules", "too_many", F.size(rules) > C.MAX_RULES),
        failure("rules", "pattern", odd_id),
        failure(
            "rules",
            "text_length",
            F.exists(
                rules,
                lambda r: r.text.isNull() | ~F.length(r.text).between(1, C.MAX_RULE_CHARS),
            ),
        ),
        failure("rules", "duplicate", F.size(F.array_distinct(ids)) < F.size(ids)),
        failure("version", "missing", rule_set.version.isNull()),
        failure("created", "missing", rule_set.created.isNull()),
    )


def content_errors(content: Column) -> Column:
    """Errors of a content struct, with the rule that ties the title to the regime."""
    title, regime = content.article_title, content.regime
    return gather(
        *length_failures("text", content.text, 1, C.MAX_CONTENT_CHARS),
        *enum_failures("regime", regime, C.CONTENT_REGIMES),
        failure(
            "article_title", "title_length", ~F.length(title).between(1, C.MAX_TITLE_CHARS)
        ),
        failure("article_title", "title_required", (regime == "comment") & title.isNull()),
        failure("article_title", "title_forbidden", (regime == "chat") & title.isNotNull()),
        failure("language", "missing", content.language.isNull()),
    )


def slug_file_errors(slug: Column, file_name: Column) -> Column:
    stem = F.regexp_replace(file_name, r"\.(ya?ml|json)\z", "")
    return gather(failure("slug", "file_mismatch", ~slug.eqNullSafe(stem)))


def extra_keys(keys: Column, allowed: Sequence[str]) -> Column:
    """Keys of a JSON object, as `json_object_keys` lists them, that the contract lacks."""
    return F.array_except(keys, F.array(*[F.lit(f) for f in allowed]))


def missing_keys(keys: Column, required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(f) for f in required]), keys)


def key_errors(keys: Column, kind: str) -> Column:
    """An error of one kind for each key."""
    return F.transform(keys, lambda k: F.struct(k.alias("loc"), F.lit(kind).alias("type")))


def none() -> Column:
    """No errors."""
    return F.array().cast(ERRORS_TYPE)


def malformed() -> Column:
    return gather(failure("", "malformed", F.lit(True)))


def failing_fields(errors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(errors, lambda e: e["loc"])))


def error_text(errors: Column) -> Column:
    """Errors as sorted `loc:type` words, for reports."""
    words = F.transform(errors, lambda e: F.concat_ws(":", e["loc"], e["type"]))
    return F.array_join(F.array_sort(words), ",")


def source_row_errors(text: Column, **numbers: Column) -> Column:
    """A source row needs a text and flags or scores that can be read as numbers."""
    unreadable = [
        failure(name, "not_a_number", number.try_cast("double").isNull())
        for name, number in numbers.items()
    ]
    return gather(failure("text", "missing", text.isNull()), *unreadable)
