"""Validation of whole tables: an `errors` column, valid and quarantined rows, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden import contracts as C
from tidewarden.functions import checks, documents, text


class ContractError(ValueError):
    """A table that must be clean or complete is not; `failures` has every failure, if it is known."""

    def __init__(self, message: str, failures: DataFrame | None = None):
        super().__init__(message)
        self.failures = failures


def validate_judgment(df: DataFrame, judgment: str = "judgment") -> DataFrame:
    return df.withColumn("errors", checks.judgment_errors(F.col(judgment)))


def validate_rule_set(df: DataFrame, rule_set: str = "rule_set") -> DataFrame:
    return df.withColumn("errors", checks.rule_set_errors(F.col(rule_set)))


def validate_content(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("errors", checks.content_errors(F.col(content)))


def check_slug_matches_file(df: DataFrame, slug: str, file_name: str) -> DataFrame:
    return df.withColumn("errors", checks.slug_file_errors(F.col(slug), F.col(file_name)))


# JSON kind of each judgment field, as Spark's variant schema spells it.
_NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\))"
_KINDS = {
    "violates_policy": r"BOOLEAN",
    "violated_rules": r"ARRAY<(STRING|VOID)>",
    "severity": r"STRING",
    "primary_category": r"STRING",
    "evidence_spans": r"ARRAY<(STRING|VOID)>",
    "suggested_action": r"STRING",
    "confidence": _NUMBER,
    "reasoning": r"STRING",
}


def _well_typed() -> str:
    """Pattern of the type of a document with all fields, in the order of their names."""
    *others, last = sorted(_KINDS)
    parts = []
    for field in others:
        part = f"{field}: {_KINDS[field]}, "
        parts.append(f"({part})?" if field in C.JUDGMENT_DEFAULTED else part)
    return rf"^OBJECT<{''.join(parts)}{last}: {_KINDS[last]}>\z"


_WELL_TYPED = _well_typed()
# Words and kinds taken for a truth value or a number when types are read leniently.
_LAX_TRUE = ("true", "t", "yes", "y", "on", "1")
_LAX_FALSE = ("false", "f", "no", "n", "off", "0")


def _member(document: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(document, f"$.{field}", kind)


def _lax_flag(document: Column) -> Column:
    """A truth value, 0 or 1, or a word for one; null if it is none of these."""
    kind = F.schema_of_variant(_member(document, "violates_policy", "variant"))
    number = _member(document, "violates_policy", "double")
    word = F.lower(_member(document, "violates_policy", "string"))
    spelled = F.when(word.isin(*_LAX_TRUE), True).when(word.isin(*_LAX_FALSE), False)
    return (
        F.when(kind == "BOOLEAN", _member(document, "violates_policy", "boolean"))
        .when(kind.rlike(f"^{_NUMBER}$"), F.when(number == 1, True).when(number == 0, False))
        .when(kind == "STRING", spelled)
    )


def _lax_number(document: Column) -> Column:
    """A number, a text that spells one, or a truth value as 0 or 1; else null."""
    kind = F.schema_of_variant(_member(document, "confidence", "variant"))
    word = text.strip(_member(document, "confidence", "string"))
    return (
        F.when(kind.rlike(f"^{_NUMBER}$"), _member(document, "confidence", "double"))
        .when(kind == "STRING", F.when(word.rlike(text.NUMBER), word.try_cast("double")))
        .when(kind == "BOOLEAN", _member(document, "confidence", "boolean").cast("double"))
    )


def parse_judgment(
    df: DataFrame, json_column: str, into: str = "judgment", lax: bool = False
) -> DataFrame:
    """JSON text -> judgment struct and `errors`; bad text makes an error row, not a failure.

    JSON types are taken strictly, unless `lax`: then truth values may be spelled as 0, 1 or a
    word and the confidence as text. Absent lists become empty. The value checks run on
    documents whose fields all have the right type.
    """
    raw, document, keys = F.col(json_column), F.col("_document"), F.col("_keys")
    lenient = {"violates_policy": _lax_flag, "confidence": _lax_number} if lax else {}
    strict = T.StructType([f for f in C.JUDGMENT.fields if f.name not in lenient])

    def value(field: str) -> Column:
        if field in lenient:
            return lenient[field](document).alias(field)
        found = F.col("_strict")[field]
        if field in C.JUDGMENT_DEFAULTED:
            found = F.coalesce(found, F.array().cast("array<string>"))
        return found.alias(field)

    def mistyped(field: str) -> Column:
        if field in lenient:
            wrong = F.col("_values")[field].isNull()
        else:
            kind = F.schema_of_variant(_member(document, field, "variant"))
            wrong = ~F.coalesce(kind, F.lit("VOID")).rlike(f"^{_KINDS[field]}$")
        return F.array_contains(keys, field) & wrong

    faults = F.concat(
        checks.key_errors(checks.extra_keys(keys, C.JUDGMENT_FIELDS), "extra"),
        checks.key_errors(checks.missing_keys(keys, C.JUDGMENT_REQUIRED), "missing"),
        checks.gather(*[checks.failure(f, "type", mistyped(f)) for f in C.JUDGMENT_FIELDS]),
    )
    # Staged in columns, so that a text is parsed once and not once per field. One look at the
    # document's type settles the usual case, in which every field is there with its kind.
    shaped = (
        df.withColumns({"_document": F.try_parse_json(raw), "_keys": F.json_object_keys(raw)})
        .withColumn("_strict", F.try_variant_get(document, "$", strict.simpleString()))
        .withColumn("_values", F.struct(*[value(f) for f in C.JUDGMENT_FIELDS]))
        .withColumn(
            "_shape",
            F.when(F.schema_of_variant(document).rlike(_WELL_TYPED), checks.none())
            .when(document.isNull() | keys.isNull(), checks.malformed())
            .otherwise(faults),
        )
    )
    well_shaped = F.size("_shape") == 0
    return (
        shaped.withColumn(into, F.when(well_shaped, F.col("_values")))
        .withColumn(
            "errors",
            F.when(well_shaped, checks.judgment_errors(F.col(into))).otherwise(F.col("_shape")),
        )
        .drop("_document", "_keys", "_strict", "_values", "_shape")
    )


def _contract(kind: T.StructType, optional: Sequence[str], nullable: Sequence[str]):
    return documents.Contract(kind, frozenset(optional), frozenset(nullable))


CONTENT_CONTRACT = _contract(C.CONTENT, C.CONTENT_OPTIONAL, C.CONTENT_NULLABLE)
AUDIT_CONTRACT = _contract(C.AUDIT_ROW, C.AUDIT_OPTIONAL, C.AUDIT_NULLABLE)
ADVERSARIAL_CONTRACT = _contract(C.ADVERSARIAL_ROW, C.ADVERSARIAL_OPTIONAL, C.ADVERSARIAL_NULLABLE)


def _parse_document(
    df: DataFrame, json_column: str, into: str, contract: documents.Contract, values
) -> DataFrame:
    """JSON text -> struct and `errors`. Values are checked where the shape is right; a document of
    another shape has a null struct."""
    document, shape = F.col("_document"), F.col("_shape")
    # As the only element of a list, a document that goes on after its end is no JSON.
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(json_column), F.lit("]")))
    only = F.try_variant_get("_listed", "$[1]", "variant").isNull()
    parsed = (
        df.withColumn("_listed", listed)
        .withColumn("_document", F.when(only, F.try_variant_get("_listed", "$[0]", "variant")))
        .drop("_listed")
        .withColumn("_shape", documents.shape_errors(document, contract))
        .withColumn("_parsed", F.try_variant_get(document, "$", contract.kind.simpleString()))
    )
    right = F.size("_shape") == 0
    return (
        parsed.withColumn(into, F.when(right, values(F.col("_parsed"))[0]))
        .withColumn("errors", F.when(right, values(F.col(into))[1]).otherwise(shape))
        .drop("_document", "_shape", "_parsed")
    )


def _with_lists(judgment: Column) -> Column:
    """A judgment in which absent lists are empty."""
    for name in C.JUDGMENT_DEFAULTED:
        filled = F.coalesce(judgment[name], F.array().cast("array<string>"))
        judgment = judgment.withField(name, filled)
    return judgment


def parse_content(df: DataFrame, json_column: str, into: str = "content") -> DataFrame:
    """JSON text -> content struct and `errors`; the language is English where none is given."""

    def values(content: Column) -> tuple[Column, Column]:
        filled = content.withField("language", F.coalesce(content.language, F.lit("en")))
        return filled, checks.content_errors(filled)

    return _parse_document(df, json_column, into, CONTENT_CONTRACT, values)


def _row_errors(row: Column) -> Column:
    content = row.content
    return F.concat(
        checks.gather(
            *checks.length_failures("content.text", content.text, 1, C.MAX_CONTENT_CHARS),
            *checks.enum_failures("content.regime", content.regime, C.CONTENT_REGIMES),
        ),
        documents.below(checks.judgment_errors(row.judgment), "judgment"),
    )


def parse_audit_row(df: DataFrame, json_column: str, into: str = "row") -> DataFrame:
    """JSON text of an audit row -> struct and `errors`, those of content and judgment included."""

    def values(row: Column) -> tuple[Column, Column]:
        return row.withField("judgment", _with_lists(row.judgment)), _row_errors(row)

    return _parse_document(df, json_column, into, AUDIT_CONTRACT, values)


def parse_adversarial_row(df: DataFrame, json_column: str, into: str = "row") -> DataFrame:
    """JSON text of a hand-written test row -> struct and `errors`.

    An audit row with the earlier messages, a rule set that judges otherwise, and the edge tested;
    it has no place in a stream.
    """

    def values(row: Column) -> tuple[Column, Column]:
        content = row.content
        own = checks.gather(
            checks.failure("audited_by", "enum", row.audited_by != C.ADVERSARIAL_AUDITOR),
            checks.failure("content.source", "enum", content.source != C.ADVERSARIAL_SOURCE),
            checks.failure(
                "content.source_stream_idx", "forbidden", content.source_stream_idx.isNotNull()
            ),
            checks.failure(
                "content.edge_tested", "pattern", ~content.edge_tested.rlike(C.EDGE_PATTERN)
            ),
            checks.failure(
                "content.rule_set_foil", "same", content.rule_set_foil == row.rule_set_slug
            ),
        )
        filled = row.withField("judgment", _with_lists(row.judgment))
        return filled, F.concat(own, _row_errors(row))

    return _parse_document(df, json_column, into, ADVERSARIAL_CONTRACT, values)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the errors column, and the quarantined rows with it."""
    bad = F.size("errors") > 0
    return validated.where(~bad).drop("errors"), validated.where(bad)


SHOWN = 20  # kinds of failure named in a message; the report has all of them


def failures(validated: DataFrame) -> DataFrame:
    """Every failure of every row: the row's columns, loc, type."""
    columns = [c for c in validated.columns if c != "errors"]
    return validated.select(*columns, F.inline("errors"))


def gate_all_or_nothing(validated: DataFrame) -> DataFrame:
    """The rows, if every one is valid. Otherwise raises and nothing can be written.

    The message counts the failures and names the commonest kinds; the error's `failures` is the
    table of all of them.
    """
    report = error_report(validated).orderBy(F.desc("n_rows"), "loc", "type")
    kinds = report.limit(SHOWN).collect()
    if kinds:
        totals = report.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_rows").alias("n")).first()
        seen = ", ".join(f"{k['loc']}:{k['type']} x{k['n_rows']}" for k in kinds)
        message = f"nothing written, {totals['n']} failures of {totals['kinds']} kinds: {seen}"
        raise ContractError(message, failures(validated))
    return validated.drop("errors")


def gate_each(validated: DataFrame, batch: Sequence[str]) -> DataFrame:
    """The rows of the batches in which every row is valid: one invalid row holds back its batch."""
    held = validated.where(F.size("errors") > 0).select(*batch).distinct()
    same = F.lit(True)
    for c in batch:
        same = same & validated[c].eqNullSafe(held[c])
    return validated.join(held, same, "left_anti").drop("errors")


def gate_report(validated: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Per batch: rows, failing rows, whether it passes, and every kind of failure with its count.

    Rows are counted by kind before they meet, so a batch of any size sends a few counts.
    """
    bad = F.size("errors") > 0
    totals = validated.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_failing")
    )
    kinds = (
        validated.where(bad)
        .select(*[F.col(c).alias(f"_{c}") for c in batch], F.inline("errors"))
        .groupBy(*[f"_{c}" for c in batch], "loc", "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("said", F.concat_ws(":", "loc", "type", F.col("n").cast("string")))
        .groupBy(*[f"_{c}" for c in batch])
        .agg(F.array_join(F.array_sort(F.collect_list("said")), ",").alias("failures"))
    )
    same = F.lit(True)
    for c in batch:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return totals.join(kinds, same, "left").select(
        *batch,
        "n_rows",
        "n_failing",
        (F.col("n_failing") == 0).alias("passes"),
        F.coalesce("failures", F.lit("")).alias("failures"),
    )


def error_report(validated: DataFrame) -> DataFrame:
    """How many rows fail in each way."""
    return (
        validated.select(F.explode("errors").alias("e"))
        .groupBy(F.col("e.loc").alias("loc"), F.col("e.type").alias("type"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def check_rule_membership(df: DataFrame, slug: str, rules: str, catalog: DataFrame) -> DataFrame:
    """Adds `unknown_rules`: named rules that the row's own rule set does not have.

    The catalog is folded to one row per rule set, so each judgment meets one catalog row at
    most and keeps its list whole.
    """
    known = catalog.groupBy(F.col("slug").alias("_slug")).agg(
        F.collect_set("rule_id").alias("_known")
    )
    joined = df.join(known, F.col(slug) == F.col("_slug"), "left")
    return joined.withColumn(
        "unknown_rules",
        F.array_except(rules, F.coalesce("_known", F.array().cast("array<string>"))),
    ).drop("_slug", "_known")


def check_source_row(df: DataFrame, text: str, numbers: list[str]) -> DataFrame:
    return df.withColumn(
        "errors", checks.source_row_errors(F.col(text), **{n: F.col(n) for n in numbers})
    )


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"no rows in {what}")
    return df


def warn_short(df: DataFrame, wanted: int) -> DataFrame:
    """One report row: how many candidates there are, how many are wanted, and whether too few."""
    return df.agg(F.count(F.lit(1)).alias("found")).select(
        "found",
        F.lit(wanted).cast("bigint").alias("wanted"),
        (F.col("found") < wanted).alias("short"),
    )


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
