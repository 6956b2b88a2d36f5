"""Joins of candidates, labels, rule sets and held-out lists.

Joins carry no broadcast hints: Spark broadcasts a side whose measured size is below its
threshold, and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden import contracts as C
from tidewarden.functions import scores, text
from tidewarden.operators import validation


def attach_labels(inbox: DataFrame, labels: DataFrame) -> DataFrame:
    return inbox.join(labels, "stream_idx", "inner")


def unlabelled(inbox: DataFrame, labels: DataFrame) -> DataFrame:
    """Inbox rows without a label."""
    return inbox.join(labels.select("stream_idx"), "stream_idx", "left_anti")


def orphan_labels(inbox: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels without an inbox row."""
    return labels.join(inbox.select("stream_idx"), "stream_idx", "left_anti")


def label_mismatches(inbox: DataFrame, labels: DataFrame) -> DataFrame:
    """Both key differences, and keys that occur twice on a side, in one pass over the keys."""
    sides = inbox.select("stream_idx", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        labels.select("stream_idx", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    found = sides.groupBy("stream_idx").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    problem = (
        F.when(F.col("b") == 0, "unlabelled")
        .when(F.col("a") == 0, "orphan_label")
        .when(F.col("a") > 1, "repeated_row")
        .when(F.col("b") > 1, "repeated_label")
    )
    return found.select("stream_idx", problem.alias("problem")).where(F.col("problem").isNotNull())


def require_complete(inbox: DataFrame, labels: DataFrame) -> None:
    """Raises unless inbox and labels have the same keys, once each."""
    counts = label_mismatches(inbox, labels).groupBy("problem").count().collect()
    if counts:
        seen = ", ".join(sorted(f"{r['problem']} x{r['count']}" for r in counts))
        raise validation.ContractError(seen)


def leaked(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training rows whose source id is on the held-out list."""
    return train.join(held_out.select("source_id"), "source_id", "left_semi")


def drop_leaked(train: DataFrame, held_out: DataFrame) -> DataFrame:
    return train.join(held_out.select("source_id"), "source_id", "left_anti")


def leaked_ids(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Ids on both sides, as a set."""
    return train.select("source_id").intersect(held_out.select("source_id"))


def require_no_leak(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """The training rows, if all have an id and none is held out."""
    if not train.where(F.col("source_id").isNull()).isEmpty():
        raise validation.ContractError("training rows without a source id")
    if not leaked(train, held_out).isEmpty():
        raise validation.ContractError("held-out rows among the training rows")
    return train


def resolve_rules(judgments: DataFrame, slug: str, rules: str, catalog: DataFrame) -> DataFrame:
    """One row per violated rule with the rule text; unknown rules keep a null text."""
    named = judgments.withColumn("rule_id", F.explode(rules))
    texts = catalog.select(
        F.col("slug").alias(slug), "rule_id", F.col("rule_text").alias("rule_text")
    )
    return named.join(texts, [slug, "rule_id"], "left")


def pair_with_rule_sets(content: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """Every content row with every rule set of a compatible regime.

    A rule set takes the content of one regime, which makes this an equality join.
    """
    takers = rule_sets.select("slug", text.content_regime(F.col("regime")).alias("regime"))
    return content.join(takers, "regime")


def rank_pairings(
    content: DataFrame, rule_sets: DataFrame, key: str, per_row: int, seed: int
) -> DataFrame:
    """Up to `per_row` compatible rule sets per content row, drawn by hash.

    The slugs of a regime travel as one list, so the draw happens inside the row.
    """
    takers = rule_sets.groupBy(text.content_regime(F.col("regime")).alias("regime")).agg(
        F.collect_set("slug").alias("_slugs")
    )
    drawn = F.slice(
        F.array_sort(
            F.transform(
                "_slugs",
                lambda s: F.struct(
                    F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), s), 256),
                    s.alias("slug"),
                ),
            )
        ),
        1,
        per_row,
    )
    return (
        content.join(takers, "regime")
        .withColumn("slug", F.explode(F.transform(drawn, lambda d: d.slug)))
        .drop("_slugs")
    )


WORD = 63  # rule sets of one word of a verdict bitmap


def foils(judgments: DataFrame, content: Sequence[str]) -> DataFrame:
    """Content judged differently under different rule sets, with the slugs on each side.

    Rule sets are numbered in the order of their slugs, whatever and however many they are. The
    verdicts on a content row become two bitmaps, a word of each for every 63 rule sets, which sum
    up before the shuffle, so copies of a content row add nothing. Verdicts without a slug or
    without an answer are no verdicts.
    """
    stated = judgments.where(F.col("slug").isNotNull() & F.col("violates_policy").isNotNull())
    place = F.row_number().over(Window.orderBy("slug")) - 1
    catalog = stated.select("slug").distinct().withColumn("_place", place)
    bit = F.expr(f"shiftleft(1L, _place % {WORD})")

    def bits(side: Column, name: str) -> Column:
        return F.bit_or(F.when(side, bit).otherwise(F.lit(0).cast("bigint"))).alias(name)

    violates, no = F.col("violates_policy"), F.lit(0)
    words = (
        stated.join(catalog, "slug")
        .groupBy(*content, F.floor(F.col("_place") / WORD).cast("int").alias("_word"))
        .agg(bits(violates, "_v"), bits(~violates, "_a"))
    )
    both = (
        words.groupBy(*content)
        .agg(
            F.collect_list(F.struct("_word", "_v", "_a")).alias("_words"),
            F.max(F.col("_v") != no).alias("_violating"),
            F.max(F.col("_a") != no).alias("_allowing"),
        )
        .where(F.col("_violating") & F.col("_allowing"))
    )
    slugs = catalog.agg(F.array_sort(F.collect_set("slug")).alias("s")).scalar()

    def named(side: str) -> Column:
        each = F.transform(
            "_words",
            lambda w: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.lit(WORD - 1)),
                    lambda i: F.getbit(w[side], i) == 1,
                ),
                lambda i: F.get(F.col("_slugs"), w["_word"] * WORD + i),
            ),
        )
        return F.array_sort(F.flatten(each))

    return both.withColumn("_slugs", slugs).select(
        *content, named("_v").alias("violating"), named("_a").alias("allowing")
    )


def foil_matrix(
    judgments: DataFrame, content: Sequence[str], catalog: Sequence[str] = ()
) -> DataFrame:
    """One verdict column per rule set; a violation wins where verdicts conflict.

    There is a column for every rule set with a verdict, and for those of the catalog without one.
    """
    found = judgments.where(F.col("slug").isNotNull()).select("slug").distinct().collect()
    slugs = sorted({*catalog, *(r["slug"] for r in found)})
    return judgments.groupBy(*content).pivot("slug", slugs).agg(F.max("violates_policy"))


def join_raters(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict counts of two raters on the items that both judged.

    Counting each side before they meet gives the same totals as joining row by row, and keeps
    an item with very many ratings from multiplying.
    """
    sides = a.select(*keys, F.lit(0).alias("_side"), "violates_policy").unionByName(
        b.select(*keys, F.lit(1).alias("_side"), "violates_policy")
    )

    def count(side: int, verdict: Column) -> Column:
        return F.count_if((F.col("_side") == side) & verdict)

    yes, no = F.col("violates_policy"), ~F.col("violates_policy")
    return (
        sides.groupBy(*keys)
        .agg(
            count(0, yes).alias("a_yes"),
            count(0, no).alias("a_no"),
            count(1, yes).alias("b_yes"),
            count(1, no).alias("b_no"),
        )
        .where((F.col("a_yes") + F.col("a_no") > 0) & (F.col("b_yes") + F.col("b_no") > 0))
    )


def derive_labels(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Violated rules of each (content, rule set) pair from the scores and its thresholds.

    Thresholds are folded to one row per rule set, so a pair meets one row and needs no regroup.
    """
    rules = thresholds.groupBy(F.col("slug").alias("_slug")).agg(
        F.array_sort(F.collect_set(F.struct("rule_id", "feature", "min_score"))).alias("_rules")
    )

    score = " ".join(
        f"WHEN '{s}' THEN coalesce(nanvl(CAST({s} AS DOUBLE), 0D), 0D)" for s in C.SCORES
    )
    joined = pairs.join(rules, F.col("slug") == F.col("_slug"), "left")
    hit = f"filter(_rules, r -> CASE r.feature {score} END >= r.min_score)"
    ids = F.expr(f"array_sort(array_distinct(transform({hit}, r -> r.rule_id)))")
    return (
        joined.withColumn(
            "violated_rules", F.coalesce(ids, F.array().cast("array<string>"))
        )
        .withColumn("violates_policy", F.size("violated_rules") > 0)
        .drop("_slug", "_rules")
    )


def derive_labels_binary(pairs: DataFrame, flag: str, positive_rules: DataFrame) -> DataFrame:
    """Flat mapping of a 0/1 flag: a flagged row breaks the rule its rule set names for it."""
    rules = positive_rules.select(F.col("slug").alias("_slug"), F.col("rule_id").alias("_rule"))
    joined = pairs.join(rules, F.col("slug") == F.col("_slug"), "left")
    hit = (F.col(flag) != 0) & F.col("_rule").isNotNull()
    return (
        joined.withColumn(
            "violated_rules",
            F.when(hit, F.array("_rule")).otherwise(F.array().cast("array<string>")),
        )
        .withColumn("violates_policy", F.coalesce(F.col(flag) != 0, F.lit(False)))
        .drop("_slug", "_rule")
    )


def build_audit_row(
    labelled: DataFrame, session_id: Column, timestamp: Column, slug: Column, regime: Column,
    source: str, dev_mode: Column, audited_by: str = "human",
) -> DataFrame:
    """Candidate with scores and judgment -> nested audit row. Missing scores stay null."""
    return labelled.select(
        session_id.alias("session_id"),
        timestamp.cast("timestamp").alias("timestamp"),
        F.lit(audited_by).alias("audited_by"),
        slug.alias("rule_set_slug"),
        F.struct(
            F.col("text"),
            text.content_regime(regime).alias("regime"),
            F.lit(source).alias("source"),
            F.col("stream_idx").alias("source_stream_idx"),
            F.col("hf_id").alias("source_hf_id"),
            scores.source_features().alias("source_features"),
        ).alias("content"),
        F.col("judgment"),
        dev_mode.alias("dev_mode"),
    )


def build_approved_row(
    labelled: DataFrame, session_id: str, timestamp: Column, slug: str, regime: str, source: str,
    author: str,
) -> DataFrame:
    """Inbox row with judgment -> approved row: an audit row with bucket and provenance."""
    when = timestamp.cast("timestamp")
    return labelled.select(
        F.lit(session_id).alias("session_id"),
        when.alias("timestamp"),
        F.lit("human_approved").alias("audited_by"),
        F.struct(
            F.lit(author).alias("initial_author"),
            F.lit("human").alias("reviewed_by"),
            when.alias("drafted_at"),
            when.alias("reviewed_at"),
        ).alias("provenance"),
        F.lit(slug).alias("rule_set_slug"),
        F.struct(
            F.col("text"),
            F.lit(regime).alias("regime"),
            F.lit(source).alias("source"),
            F.col("stream_idx").alias("source_stream_idx"),
            F.col("hf_id").alias("source_hf_id"),
            F.struct(*[F.col(f"features.{f}").alias(f) for f in C.FEATURES]).alias(
                "source_features"
            ),
            F.col("bucket"),
        ).alias("content"),
        F.col("judgment"),
        F.lit(False).alias("dev_mode"),
    )


def review_row(approved: DataFrame, targets: Sequence[str] = tuple(C.BUCKET_TARGETS)) -> DataFrame:
    """What a reviewer scans, one row per approved row, numbered in bucket and stream order.

    Takes a quota sample: the numbering runs in one task.
    """
    place = Window.orderBy(
        scores.position_of(F.col("content.bucket"), targets), "content.source_stream_idx"
    )
    features = [
        F.concat(F.lit(f"{f}="), scores.show_score(F.col(f"content.source_features.{f}")))
        for f in C.FEATURES
    ]
    return approved.select(
        F.row_number().over(place).alias("number"),
        F.col("content.bucket").alias("bucket"),
        F.when(F.col("judgment.violates_policy"), "violation").otherwise("allow").alias("tag"),
        scores.two_decimals(F.col("judgment.confidence")).alias("confidence"),
        F.concat_ws("  ", *features).alias("features"),
        F.col("content.text").alias("text"),
        F.col("judgment.reasoning").alias("reasoning"),
    )


def union_rows(*parts: DataFrame) -> DataFrame:
    """Rows of several producers; columns one of them lacks become null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
