"""Contracts of nested JSON documents: every fault of a document with the path it stands at.

A contract is a Spark type with the paths that may be absent and the paths that may be null. A list
adds `[]` to a path of the contract, and the place of the element to the path of a fault, as in
`content.prior_context[2]`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import checks, text

_WHOLE = r"^(BIGINT|DECIMAL\([0-9]+,0\))$"
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\))$"


@dataclass(frozen=True)
class Contract:
    """The type of a document, and what may be left out of it or be null."""

    kind: T.StructType
    optional: frozenset[str] = field(default_factory=frozenset)
    nullable: frozenset[str] = field(default_factory=frozenset)


def _fault(loc: Column, kind: str) -> Column:
    return F.array(F.struct(loc.alias("loc"), F.lit(kind).alias("type")))


def _named(keys: Column, loc: Column, kind: str) -> Column:
    """A fault of one kind for each key below a path."""
    return F.transform(
        keys, lambda k: F.struct(F.concat(loc, k).alias("loc"), F.lit(kind).alias("type"))
    )


def _scalar(kind: T.DataType) -> Callable[[Column], Column]:
    """Whether a value that is not null has the JSON type of a field."""

    def shape(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value), F.lit(""))

    def dated(as_type: str) -> Callable[[Column], Column]:
        return lambda v: (shape(v) == "STRING") & F.try_variant_get(
            v, "$", "string"
        ).try_cast(as_type).isNotNull()

    if isinstance(kind, T.StringType):
        return lambda v: shape(v) == "STRING"
    if isinstance(kind, T.BooleanType):
        return lambda v: shape(v) == "BOOLEAN"
    if isinstance(kind, (T.IntegerType, T.LongType)):
        as_type = kind.simpleString()
        return lambda v: shape(v).rlike(_WHOLE) & F.try_variant_get(v, "$", as_type).isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda v: shape(v).rlike(_NUMBER)
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return dated(kind.simpleString())
    raise TypeError(f"no JSON type for {kind}")


def _walk(contract: Contract, root: Column, at: str, kind: T.DataType, path: str, loc: Column) -> Column:
    """Faults of the value at `at` below a variant; it is present."""
    value = F.try_variant_get(root, at, "variant")

    def inner(value: Column) -> Column:
        if isinstance(kind, T.StructType):
            held = F.try_variant_get(root, at, "map<string,variant>")
            prefix = F.when(loc == "", "").otherwise(F.concat(loc, F.lit(".")))

            def members(keys: Column) -> Column:
                below = f"{path}." if path else ""
                required = [f.name for f in kind.fields if below + f.name not in contract.optional]
                parts = [
                    _named(checks.extra_keys(keys, kind.names), prefix, "extra"),
                    _named(checks.missing_keys(keys, required), prefix, "missing"),
                ]
                for f in kind.fields:
                    child = _walk(
                        contract, root, f"{at}.{f.name}", f.dataType, below + f.name,
                        F.concat(prefix, F.lit(f.name)),
                    )
                    parts.append(F.when(F.array_contains(keys, f.name), child).otherwise(checks.none()))
                return F.concat(*parts)

            found = F.when(held.isNotNull(), text.bind(F.map_keys(held), members))
        elif isinstance(kind, T.ArrayType):
            items = F.try_variant_get(root, at, "array<variant>")
            each = F.transform(
                items,
                lambda item, i: _walk(
                    contract, item, "$", kind.elementType, f"{path}[]",
                    F.concat(loc, F.lit("["), i.cast("string"), F.lit("]")),
                ),
            )
            found = F.when(items.isNotNull(), F.flatten(each))
        else:
            found = F.when(_scalar(kind)(value), checks.none())
        return found.otherwise(_fault(loc, "type"))

    null = checks.none() if path in contract.nullable else _fault(loc, "null")
    is_null = value.isNull() | F.is_variant_null(value)
    return F.when(is_null, null).otherwise(inner(value))


def shape_errors(document: Column, contract: Contract) -> Column:
    """Unknown, missing, null and mistyped members at any depth; `document` is a variant."""
    return F.when(document.isNull(), checks.malformed()).otherwise(
        _walk(contract, document, "$", contract.kind, "", F.lit(""))
    )


def below(errors: Column, path: str) -> Column:
    """Errors of a part, with the paths that they have in the whole."""
    return F.transform(
        errors,
        lambda e: F.struct(F.concat(F.lit(f"{path}."), e["loc"]).alias("loc"), e["type"].alias("type")),
    )
