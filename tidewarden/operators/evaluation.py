"""Agreement, precision and recall, calibration. Every report is grouped counts first."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.operators import ordered
from tidewarden.session import kept

# The pooling functions travel to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 6
BINS = 10


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, DIGITS))


def _precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision")


def _recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")


def _f1(tp: str = "tp") -> Column:
    return _ratio(2 * F.col(tp), 2 * F.col(tp) + F.col("fp") + F.col("fn"))


def confusion(gold: str, pred: str) -> list[Column]:
    g, p = F.col(gold), F.col(pred)
    return [
        F.count_if(g & p).alias("tp"),
        F.count_if(~g & p).alias("fp"),
        F.count_if(g & ~p).alias("fn"),
        F.count_if(~g & ~p).alias("tn"),
    ]


def agreement(joined: DataFrame, by: str, gate: float = C.AGREEMENT_GATE) -> DataFrame:
    """Share of equal verdicts per group and overall (null group), against the gate.

    Takes the counts of `join_raters`.
    """
    pairs = (F.col("a_yes") + F.col("a_no")) * (F.col("b_yes") + F.col("b_no"))
    equal = F.col("a_yes") * F.col("b_yes") + F.col("a_no") * F.col("b_no")
    per = joined.groupBy(by).agg(F.sum(pairs).alias("n_pairs"), F.sum(equal).alias("n_equal"))
    total = per.rollup(by).agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum("n_equal").alias("n_equal")
    )
    return total.select(
        by,
        "n_pairs",
        "n_equal",
        (F.col("n_equal") / F.col("n_pairs")).alias("agreement"),
        (F.col("n_equal") / F.col("n_pairs") >= gate).alias("passes"),
    )


def binary_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.agg(*confusion(gold, pred)).select(
        "tp", "fp", "fn", "tn", _precision(), _recall(), _f1().alias("f1")
    )


def class_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """F1 of each class, from the confusion matrix."""
    cells = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("bigint")

    def entry(label: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(F.col(label).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    hit = F.array(entry("g", F.col("n"), zero, zero))
    miss = F.array(entry("g", zero, zero, F.col("n")), entry("p", zero, F.col("n"), zero))
    parts = cells.select(F.inline(F.when(F.col("g") == F.col("p"), hit).otherwise(miss)))
    return (
        parts.groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("f1", _f1())
    )


def macro_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean F1 over the classes that occur on either side."""
    return class_f1(df, gold, pred).agg(
        F.count(F.lit(1)).alias("n_classes"), F.round(F.avg("f1"), DIGITS).alias("macro_f1")
    )


def rule_slice_metrics(gold: DataFrame, pred: DataFrame, item: Sequence[str]) -> DataFrame:
    """Precision and recall of each (rule set, rule). `item` names a judged row, slug included."""

    def named(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            *item, F.explode("violated_rules").alias("rule_id"), F.lit(side).alias("side")
        )

    said = (
        named(gold, 0)
        .unionByName(named(pred, 1))
        .groupBy(*item, "rule_id")
        .agg(
            F.max(F.col("side") == 0).alias("in_gold"), F.max(F.col("side") == 1).alias("in_pred")
        )
    )
    return (
        said.groupBy("slug", "rule_id")
        .agg(*confusion("in_gold", "in_pred"))
        .select("slug", "rule_id", "tp", "fp", "fn", _precision(), _recall())
    )


def edge_slice_metrics(df: DataFrame, edge: str, gold: str, pred: str) -> DataFrame:
    return (
        df.groupBy(edge)
        .agg(*confusion(gold, pred))
        .select(edge, "tp", "fp", "fn", _precision(), _recall())
    )


def _bin(confidence: Column, k: int) -> Column:
    return F.least(F.floor(confidence * k), F.lit(k - 1)).cast("int")


def _known(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0.0, 1.0), F.lit(False))


def reliability_bins(
    df: DataFrame, confidence: str, correct: str, k: int = BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Mean confidence and accuracy in k equal confidence bins.

    Rows without a confidence between 0 and 1 are counted under the null bin.
    """
    c = F.col(confidence)
    return (
        df.groupBy(*by, F.when(_known(c), _bin(c, k)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(correct)).alias("n_correct"),
            F.sum(F.when(_known(c), c)).alias("_sum"),
        )
        .select(
            *by,
            "bin",
            "n_rows",
            "n_correct",
            F.round(F.col("_sum") / F.col("n_rows"), DIGITS).alias("mean_confidence"),
            _ratio(F.col("n_correct"), F.col("n_rows")).alias("accuracy"),
        )
    )


def ece(
    df: DataFrame, confidence: str, correct: str, k: int = BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Expected calibration error, optionally per group, of the rows with a confidence between 0
    and 1; `n_left_out` counts the others."""
    c = F.col(confidence)
    bins = df.groupBy(*by, F.when(_known(c), _bin(c, k)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.abs(F.count_if(F.col(correct)) - F.sum(F.when(_known(c), c))).alias("gap"),
    )
    inside = F.col("bin").isNotNull()
    n_rows = F.sum(F.when(inside, F.col("n")).otherwise(0))
    gap = F.sum(F.when(inside, F.col("gap")))
    return bins.groupBy(*by).agg(
        n_rows.alias("n_rows"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_left_out"),
        F.round(gap / F.sum(F.when(inside, F.col("n"))), DIGITS).alias("ece"),
    )


_CELLS = ("tp", "fp", "fn", "tn")


def _quality(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts and gaps per bin -> F1, macro F1 and calibration error per slice."""
    total = bins.groupBy(*by).agg(*[F.sum(x).alias(x) for x in _CELLS], F.sum("gap").alias("gap"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")

    def f1(tp: str) -> Column:
        whole = 2 * F.col(tp) + F.col("fp") + F.col("fn")
        return F.when(whole > 0, 2 * F.col(tp) / whole)

    return (
        total.withColumn("f1_yes", f1("tp"))
        .withColumn("f1_no", f1("tn"))
        .select(
            *by,
            n.alias("n_rows"),
            _precision(),
            _recall(),
            F.round("f1_yes", DIGITS).alias("f1"),
            F.round(
                (F.coalesce("f1_yes", F.lit(0.0)) + F.coalesce("f1_no", F.lit(0.0))) / 2, DIGITS
            ).alias("macro_f1"),
            F.round(F.col("gap") / n, DIGITS).alias("ece"),
        )
    )


def sliced_quality(
    df: DataFrame, by: str, gold: str, pred: str, confidence: str, correct: str, k: int = BINS
) -> DataFrame:
    """Confusion counts, F1, macro F1 and calibration error per slice, in one pass."""
    c = F.col(confidence)
    bins = df.groupBy(by, _bin(c, k).alias("bin")).agg(
        *confusion(gold, pred),
        F.abs(F.count_if(F.col(correct)) - F.sum(c)).alias("gap"),
    )
    return _quality(bins, [by])


def identity_slices(
    df: DataFrame,
    attributes: Sequence[str],
    gold: str,
    pred: str,
    confidence: str,
    correct: str,
    rules: str,
    edge: str,
    k: int = BINS,
) -> DataFrame:
    """The quality report of each identity attribute, as a whole and by rule, edge and bin.

    attribute, grain (all, rule, edge or bin), value, n_rows and the measures. A row counts for
    every attribute it carries, and by rule once for each rule of its list; rows without a rule or
    an edge have no slice there. All grains come from one pass: the rows of a list are marked, so
    that the grains without rules count the first one only.
    """
    carried = F.filter(
        F.array(*[F.when(F.col(a), F.lit(a)) for a in attributes]), lambda a: a.isNotNull()
    )
    c = F.col(confidence)
    rows = (
        df.select(
            *[F.col(x).alias(y) for x, y in ((gold, "_g"), (pred, "_p"), (correct, "_ok"))],
            c.alias("_c"),
            _bin(F.when(c.between(0.0, 1.0), c), k).alias("bin"),
            F.col(edge).alias("edge"),
            F.array_distinct(rules).alias("_rules"),
            F.explode(carried).alias("attribute"),
        )
        .select("*", F.posexplode_outer("_rules").alias("_at", "rule"))
        .withColumn("_first", F.coalesce("_at", F.lit(0)) == 0)
    )

    def sums(counts: Column, tag: str) -> list[Column]:
        g, p = F.col("_g"), F.col("_p")
        cells = {"tp": g & p, "fp": ~g & p, "fn": g & ~p, "tn": ~g & ~p, "ok": F.col("_ok")}
        return [
            *[F.count_if(counts & cell).alias(f"{name}{tag}") for name, cell in cells.items()],
            F.sum(F.when(counts, F.col("_c"))).alias(f"conf{tag}"),
        ]

    sets = [["attribute", "bin"], ["attribute", "rule", "bin"], ["attribute", "edge", "bin"]]
    grouped = rows.groupingSets(sets, "attribute", "rule", "edge", "bin").agg(
        *sums(F.lit(True), "_all"),
        *sums(F.col("_first"), "_once"),
        F.grouping("rule").alias("_no_rule"),
        F.grouping("edge").alias("_no_edge"),
    )
    by_rule, by_edge = F.col("_no_rule") == 0, F.col("_no_edge") == 0

    def pick(name: str) -> Column:
        return F.when(by_rule, F.col(f"{name}_all")).otherwise(F.col(f"{name}_once"))

    def slice_of(grain: str, value: Column) -> Column:
        return F.struct(F.lit(grain).alias("grain"), value.cast("string").alias("value"))

    slices = (
        F.when(by_rule, F.array(slice_of("rule", F.col("rule"))))
        .when(by_edge, F.array(slice_of("edge", F.col("edge"))))
        .otherwise(F.array(slice_of("all", F.lit("all")), slice_of("bin", F.col("bin"))))
    )
    bins = grouped.select(
        "attribute",
        *[pick(x).alias(x) for x in _CELLS],
        F.abs(pick("ok") - pick("conf")).alias("gap"),
        F.inline(slices),
    )
    return _quality(bins.where(F.col("value").isNotNull()), ["attribute", "grain", "value"])


def compare_scorers(
    df: DataFrame, scorers: Mapping[str, str], gold: str, threshold: float
) -> DataFrame:
    """Calibration error and macro F1 of several score columns on the same rows.

    The rows are those that have a label and a score between 0 and 1 from every scorer.
    """
    each = F.array(
        *[F.struct(F.lit(n).alias("scorer"), F.col(c).alias("score")) for n, c in scorers.items()]
    )
    whole = F.col(gold).isNotNull()
    for c in scorers.values():
        whole = whole & F.col(c).between(0.0, 1.0)
    rows = df.where(whole).select(gold, F.inline(each))
    rows = rows.withColumn("_pred", F.col("score") >= threshold)
    return sliced_quality(rows, "scorer", gold, "_pred", "score", gold)


Block = tuple[float, float, int, int]  # lowest and highest confidence, rows, correct rows


def _pool(blocks: list[Block], more: Iterable[Block]) -> None:
    """Pools adjacent violators: a block whose rate is not above the one before joins it.

    Rates are compared as products of whole numbers, so nothing is rounded.
    """
    for low, high, n, k in more:
        while blocks and blocks[-1][3] * n >= k * blocks[-1][2]:
            low, _, n0, k0 = blocks.pop()
            n, k = n + n0, k + k0
        blocks.append((low, high, n, k))


_BLOCK = "part int, low double, high double, n_rows bigint, n_correct bigint"
_FIELDS = ["low", "high", "n_rows", "n_correct"]


def _blocks_of_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pooled blocks of one range of confidences, which come in order."""
    blocks, part = [], 0
    for batch in batches:
        part = batch["part"].iloc[0] if len(batch) else part
        _pool(blocks, zip(*[batch[c].tolist() for c in _FIELDS], strict=True))
    if blocks:
        yield pd.DataFrame(blocks, columns=_FIELDS).assign(part=part)[["part", *_FIELDS]]


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The pooled blocks of neighbouring ranges."""
    blocks: list[Block] = []
    rows = rows.sort_values("low")
    _pool(blocks, zip(*[rows[c].tolist() for c in _FIELDS], strict=True))
    return pd.DataFrame(blocks, columns=_FIELDS).assign(part=rows["part"].iloc[0] // MERGE)


MERGE = 32  # neighbouring lists of blocks that one task merges


def isotonic_blocks(points: DataFrame, parts: int | None = None) -> DataFrame:
    """Blocks of equal calibrated rate: low, high, n_rows, n_correct, by rising rate.

    Takes one row per confidence with n_rows and n_correct. Confidences are dealt by ranges and
    pooled within each; then the lists of neighbouring ranges are merged, MERGE at a time, until
    one is left. Pooling in any order gives the same blocks. Their rates differ and are ratios of
    counts, so of N rows there are at most about N^(2/3) blocks, whatever the confidences are.
    """
    count = () if parts is None else (parts,)
    ranges = points.repartitionByRange(*count, "confidence").sortWithinPartitions("confidence")
    c = F.col("confidence")
    rows = ranges.select(
        F.spark_partition_id().alias("part"), c.alias("low"), c.alias("high"), "n_rows", "n_correct"
    )
    blocks = kept(rows.mapInPandas(_blocks_of_range, _BLOCK), "blocks")
    lists = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while lists > 1:
        group = F.floor(F.col("part") / MERGE)
        blocks = kept(blocks.groupBy(group).applyInPandas(_merged, _BLOCK), "blocks")
        lists = -(-lists // MERGE)
    return blocks.select(*_FIELDS)


def isotonic_calibration(
    df: DataFrame, confidence: str, correct: str, parts: int | None = None
) -> DataFrame:
    """Monotone map from each confidence to the share that is correct: the least-squares fit.

    Every distinct confidence between 0 and 1 is a point of the fit; rows without one take no part.
    """
    c = F.col(confidence)
    points = (
        df.where(c.between(0.0, 1.0))
        .groupBy(c.cast("double").alias("confidence"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(correct)).alias("n_correct"))
    )
    points = kept(points, "points")
    rate = F.round(F.col("n_correct") / F.col("n_rows"), DIGITS).alias("rate")
    starts = isotonic_blocks(points, parts).select(
        F.col("low").alias("confidence"),
        F.lit(0).alias("kind"),
        F.struct(F.col("low"), rate).alias("block"),
    )
    line = points.withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    found = ordered.with_scan(line, ["confidence", "kind"], F.col("block"), "last", parts=parts)
    return found.where("kind = 1").select(
        "confidence", "n_rows", "n_correct", F.col("last.rate").alias("calibrated")
    )


def classifier_disagreement(
    df: DataFrame, score: str, violates: str, threshold: float, by: str
) -> DataFrame:
    """Share of rows on which an outside score and the rule-set verdict differ."""
    differ = (F.col(score) >= threshold) != F.col(violates)
    return (
        df.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differ).alias("n_differ"))
        .withColumn("share", F.col("n_differ") / F.col("n_rows"))
    )


def rater_disagreement(votes: DataFrame, item: Sequence[str]) -> DataFrame:
    """Items that one rater flags and another does not."""
    yes = F.count_if(F.col("violates_policy"))
    no = F.count_if(~F.col("violates_policy"))
    sides = votes.groupBy(*item).agg(yes.alias("n_yes"), no.alias("n_no"))
    return sides.where((F.col("n_yes") > 0) & (F.col("n_no") > 0))


def category_polarity(judgments: DataFrame) -> DataFrame:
    """Categories with their verdict counts, and whether both verdicts occur."""
    return (
        judgments.groupBy("primary_category")
        .agg(
            F.count_if(F.col("violates_policy")).alias("n_violating"),
            F.count_if(~F.col("violates_policy")).alias("n_allowed"),
        )
        .withColumn("both", (F.col("n_violating") > 0) & (F.col("n_allowed") > 0))
    )
