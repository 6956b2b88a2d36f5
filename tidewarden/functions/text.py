"""Text predicates, identifiers and normalisers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden import contracts as C

# Spark's plain trim takes spaces only. All characters that count as whitespace.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def strip(text: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def passes_length(text: Column, regime: Column | str) -> Column:
    """Whether a text is neither too short nor too long for its regime."""
    regime = F.lit(regime) if isinstance(regime, str) else regime
    chars = F.length(text)
    return chars.between(C.MIN_TEXT_CHARS, C.MAX_TEXT_CHARS) & (
        (regime != "chat") | (chars < C.CHAT_TEXT_BELOW)
    )


def length_band(text: Column, shortest: int, longest: int) -> Column:
    return F.length(text).between(shortest, longest)


def source_id(text: Column, row_id: Column) -> Column:
    """Stable identity of a corpus row; null when the row id is null."""
    return F.sha2(F.concat(text, row_id.cast("string")), 256)


def content_regime(rule_set_regime: Column) -> Column:
    return F.when(rule_set_regime == "chat", "chat").otherwise("comment")


def edge_rule(edge: Column) -> Column:
    return F.split_part(edge, F.lit(":"), F.lit(1))


def edge_name(edge: Column) -> Column:
    return F.split_part(edge, F.lit(":"), F.lit(2))


def longest_line_run(text: Column) -> Column:
    """Length of the longest run of equal, non-blank neighbouring lines in one text."""
    lines = F.filter(F.split(text, "\n"), lambda line: strip(line) != "")
    start = F.struct(
        F.lit(None).cast("string").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(seen: Column, line: Column) -> Column:
        run = F.when(seen.line.eqNullSafe(line), seen.run + 1).otherwise(1)
        return F.struct(
            line.alias("line"), run.alias("run"), F.greatest(seen.best, run).alias("best")
        )

    return F.aggregate(lines, start, step, lambda seen: seen.best)


# The normalisers turn one answer as typed by an annotator into a typed value. An answer that
# does not fit gives a null value, or for structs a null `value` and the reason in `error`.


def normalise_flag(answer: Column) -> Column:
    word = F.lower(strip(answer))
    return F.when(word.isin(*C.TRUE_WORDS), True).when(word.isin(*C.FALSE_WORDS), False)


def normalise_enum(answer: Column, values: Sequence[str]) -> Column:
    """An option by its 1-based number or by its name."""
    word = F.lower(strip(answer))
    digits = F.regexp_extract(word, r"^0*([0-9]+)\z", 1)  # however many zeros lead
    number = F.when(F.length(digits).between(1, 9), digits.cast("int"))
    options = F.array(*[F.lit(v) for v in values])
    return F.when(number.between(1, len(values)), F.get(options, number - 1)).when(
        word.isin(*values), word
    )


def normalise_rule_list(answer: Column, rule_ids: Column) -> Column:
    """Comma-separated rule ids -> struct<value, error>."""

    def check(ids: Column) -> Column:
        error = (
            F.when(ids.isNull(), "missing")
            .when(F.size(F.array_except(ids, rule_ids)) > 0, "unknown")
            .when(F.size(ids) > F.size(F.array_distinct(ids)), "duplicate")
            .when(F.size(ids) > C.MAX_VIOLATED_RULES, "too_many")
        )
        return F.struct(F.when(error.isNull(), ids).alias("value"), error.alias("error"))

    return bind(F.filter(F.transform(F.split(answer, ","), strip), lambda x: x != ""), check)


def normalise_spans(lines: Column) -> Column:
    """Entered lines -> struct<value, error>: up to the first blank line, five at most."""

    def entered(clean: Column) -> Column:
        blank = F.array_position(clean, "").cast("int")
        upto = F.when(blank == 0, F.size(clean)).otherwise(blank - 1)
        return F.slice(clean, 1, F.least(F.lit(C.MAX_SPANS), upto))

    def check(spans: Column) -> Column:
        error = F.when(spans.isNull(), "missing").when(
            F.exists(spans, lambda s: F.length(s) > C.MAX_SPAN_CHARS), "too_long"
        )
        return F.struct(F.when(error.isNull(), spans).alias("value"), error.alias("error"))

    return bind(bind(F.transform(lines, strip), entered), check)


def normalise_confidence(answer: Column) -> Column:
    word = strip(answer)
    number = F.when(word.rlike(NUMBER), word.try_cast("double"))
    return F.when(number.between(0.0, 1.0), number)


def normalise_reasoning(answer: Column) -> Column:
    text = strip(answer)
    return F.when(F.length(text).between(1, C.MAX_REASONING_CHARS), text)
