"""Bounded samples: per bucket, per band, per source, per rule set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden import contracts as C
from tidewarden.functions import scores, text
from tidewarden.operators import ordered, ordering
from tidewarden.operators.tables import literal_table


def _quota_of(group: Column, quotas: Mapping[str, int]) -> Column:
    pairs = [F.lit(x) for name, quota in quotas.items() for x in (name, quota)]
    return F.element_at(F.create_map(*pairs), group)


def first_n_per_group(
    df: DataFrame, group: str, quotas: Mapping[str, int], order: Sequence[str]
) -> DataFrame:
    """The first `quota` rows of each group in the given order, with their rank.

    The bound by the largest quota lets Spark drop rows before the shuffle.
    """
    quotas = {name: quota for name, quota in quotas.items() if quota > 0}
    if not quotas:
        return df.withColumn("rank", F.lit(0)).limit(0)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    top = df.where(F.col(group).isin(*quotas)).withColumn("rank", rank)
    top = top.where(F.col("rank") <= max(quotas.values()))
    return top.where(F.col("rank") <= _quota_of(F.col(group), quotas))


def apportion(
    n: int, shares: Mapping[str, float], supply: Mapping[str, int] | None = None
) -> dict[str, int]:
    """n rows dealt over the names by share: quotas that add up to n.

    Largest remainders, ties to the earlier name. What a name with too little supply cannot give
    is dealt to the others in the same way; only where all are exhausted do the quotas fall short.
    """
    weights = {name: Fraction(str(share)) for name, share in shares.items()}
    got = dict.fromkeys(shares, 0)

    def left(name: str) -> float:
        return float("inf") if supply is None else supply.get(name, 0) - got[name]

    while rest := n - sum(got.values()):
        open_ = [name for name in shares if left(name) > 0 and weights[name] > 0]
        if not open_:
            break
        whole = sum(weights[name] for name in open_)
        exact = {name: rest * weights[name] / whole for name in open_}
        part = {name: int(x) for name, x in exact.items()}
        by_rest = sorted(open_, key=lambda name: part[name] - exact[name])
        for name in by_rest[: rest - sum(part.values())]:
            part[name] += 1
        for name in open_:
            got[name] += int(min(part[name], left(name)))
    return got


def hashed_sample(
    df: DataFrame, group: str, quotas: Mapping[str, int], key: str, seed: int
) -> DataFrame:
    """Quota sample over the whole table in the order of the seed, of any quota size."""
    hashed = df.withColumn(ordering.HASH, ordering.order_hash(seed, F.col(key)))
    quotas = {name: quota for name, quota in quotas.items() if quota > 0}
    if not quotas:
        return df.withColumn("rank", F.lit(0).cast("bigint")).limit(0)
    return ordering.ranked(hashed, quotas, key, F.col(group)).drop(ordering.HASH)


def stratified_sample(
    corpus: DataFrame,
    key: str,
    seed: int = C.SAMPLE_SEED,
    scan_rows: int = C.SAMPLE_SCAN_ROWS,
    targets: Mapping[str, int] = C.BUCKET_TARGETS,
    regime: str = "chat",
) -> DataFrame:
    """The inbox: stream prefix -> length filter -> bucket -> first rows per bucket.

    Rows come in the order of the targets and, within one, of the stream.
    """
    seen = ordering.stream(corpus, scan_rows, key, seed)
    eligible = seen.where(text.passes_length(F.col("text"), regime)).withColumn(
        "bucket", scores.bucket()
    )
    picked = first_n_per_group(eligible, "bucket", targets, ["stream_idx"])
    rows = picked.select(
        "stream_idx",
        "bucket",
        "text",
        F.col(key).cast("string").alias("hf_id"),
        scores.filled_features().alias("features"),
        scores.score_or_zero(F.col("sexual_explicit")).alias("sexual_explicit"),
    )
    # The limit drops nothing; it spares the sampling job of a global sort.
    place = scores.position_of(F.col("bucket"), list(targets))
    return rows.orderBy(place, "stream_idx").limit(sum(targets.values()))


def uniform_candidates(
    corpus: DataFrame, key: str, seed: int, regime: str, scan_rows: int = C.CANDIDATE_SCAN_ROWS
) -> DataFrame:
    """A short stream prefix, length-filtered after the positions were given."""
    seen = ordering.stream(corpus, scan_rows, key, seed)
    return seen.where(text.passes_length(F.col("text"), regime))


def resume_slice(candidates: DataFrame, cursor: int, parts: int | None = None) -> DataFrame:
    """What is left of a session: the cursor counts filtered candidates, not stream positions."""
    before = ordered.with_scan(
        candidates, ["stream_idx"], F.lit(1).cast("bigint"), "place", "sum", parts=parts
    )
    return before.where(F.col("place") >= cursor)


def example_or_max(seen: DataFrame, score: str, above: float) -> DataFrame:
    """One row: the first above the threshold, else the first with the highest score."""
    columns = F.struct(*[F.col(c) for c in seen.columns])
    place = F.col("stream_idx")
    value = F.nanvl(F.col(score), F.lit(None).cast("double"))
    found = F.min_by(columns, F.when(value > above, place))
    best = F.max_by(columns, F.when(value.isNotNull(), F.struct(value, -place)))
    return (
        seen.agg(found.alias("found"), best.alias("best"))
        .select(
            F.coalesce("found", "best").alias("row"),
            F.col("found").isNotNull().alias("above_threshold"),
        )
        .where(F.col("row").isNotNull())
        .select("row.*", "above_threshold")
    )


def first_flagged(df: DataFrame, flags: Sequence[str], place: str) -> DataFrame:
    """The first row of each flag, one output row per flag that occurs."""
    columns = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.agg(
        *[F.min_by(columns, F.when(F.col(f) != 0, F.col(place))).alias(f) for f in flags]
    )
    tagged = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("row")) for f in flags])
    return (
        firsts.select(F.inline(tagged))
        .where(F.col("row").isNotNull())
        .select("flag", "row.*")
    )


def quota_report(
    df: DataFrame, group: str, n: int, shares: Mapping[str, float]
) -> tuple[dict[str, int], DataFrame]:
    """The quotas of n rows over the groups, and a table of what was planned, is there and is
    taken, with groups that the plan lacks."""
    counts = df.groupBy(F.col(group).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    supply = {r["name"]: r["n_rows"] for r in counts.where(F.col("name").isin(*shares)).collect()}
    planned, taken = apportion(n, shares), apportion(n, shares, supply)
    rows = [(name, planned[name], taken[name]) for name in shares]
    plan = df.sparkSession.createDataFrame(rows, "name string, planned bigint, taken bigint")
    report = plan.join(counts, "name", "full_outer").select(
        F.col("name").alias(group),
        F.coalesce("planned", F.lit(0)).alias("planned"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("taken", F.lit(0)).alias("taken"),
    )
    return taken, report.withColumn("short", F.greatest(F.lit(0), F.col("planned") - F.col("n_rows")))


def band_sample(
    corpus: DataFrame, key: str, seed: int, n: int, shares: Mapping[str, float] = C.BAND_SHARES
) -> DataFrame:
    """n rows split over the training bands, from the whole corpus.

    A band with fewer rows than its quota gives all of them, and the others give the rest.
    """
    banded = corpus.withColumn("band", scores.band())
    quotas, _ = quota_report(banded, "band", n, shares)
    return hashed_sample(banded, "band", quotas, key, seed)


def golden_sample(
    corpus: DataFrame, key: str, seed: int, targets: Mapping[str, int] = C.GOLDEN_TARGETS
) -> DataFrame:
    """The evaluation sample over the same buckets as the inbox, from the whole corpus."""
    return hashed_sample(corpus.withColumn("bucket", scores.bucket()), "bucket", targets, key, seed)


def source_mix(
    sources: Mapping[str, tuple[DataFrame, float]], n: int, key: str, seed: int
) -> DataFrame:
    """n rows mixed from several corpora by share; columns missing from one become null.

    A corpus with fewer rows than its quota gives all of them, and the others give the rest.
    """
    supply = {name: df.count() for name, (df, _) in sources.items()}
    quotas = apportion(n, {name: share for name, (_, share) in sources.items()}, supply)
    parts = [
        ordering.scan_prefix(df, quotas[name], key, seed)
        .drop(ordering.HASH)
        .withColumn("source", F.lit(name))
        for name, (df, _) in sources.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cap_source(
    main: DataFrame, extra: DataFrame, max_share: float, key: str, seed: int
) -> DataFrame:
    """All of `main`, and of `extra` no more than `max_share` of the total."""
    share = F.floor(F.count(F.lit(1)) * F.lit(max_share) / F.lit(1.0 - max_share))
    allowed = main.agg(share.alias("n")).scalar()
    hashed = extra.withColumn(ordering.HASH, ordering.order_hash(seed, F.col(key)))
    some = ordering.ranked(hashed, {"": allowed}, key).drop("rank", ordering.HASH)
    return main.unionByName(some, allowMissingColumns=True)


def spot_check(df: DataFrame, group: str, per_group: int, key: str, seed: int) -> DataFrame:
    """The same number of rows from every group, however many groups and rows of each there are."""
    hashed = df.withColumn(ordering.HASH, ordering.order_hash(seed, F.col(key)))
    return ordering.ranked_each(hashed, group, per_group, key).drop(ordering.HASH)


def share_check(df: DataFrame, group: str, shares: Mapping[str, float]) -> DataFrame:
    """Rows and share of each group beside the planned share.

    Groups of the plan without rows are shown, and so are groups that the plan lacks, with a
    planned share of zero. The table is read once.
    """
    counts = df.groupBy(F.col(group).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    plan = literal_table(df.sparkSession, shares, "name", "planned")
    every = plan.join(counts, "name", "full_outer").withColumn("n_rows", F.coalesce("n", F.lit(0)))
    total = F.sum("n_rows").over(Window.partitionBy())
    return every.withColumn("_total", total).select(
        F.col("name").alias(group),
        "n_rows",
        F.when(F.col("_total") > 0, F.col("n_rows") / F.col("_total")).alias("share"),
        F.coalesce("planned", F.lit(0.0)).alias("planned"),
    )


def mix_by_rule(
    rows: DataFrame, rules: str, kind: str, shares: Mapping[str, float], planned: Sequence[str] = ()
) -> DataFrame:
    """The mix of kinds within each rule beside the planned one: rule_id, kind, n_rows, share,
    planned; the null kind is the whole rule.

    A row counts once for each rule of its list. Rules and kinds of the plan without rows are
    shown, and so are those that the plan lacks. Both grains come from one pass.
    """
    named = rows.select(F.explode(F.array_distinct(rules)).alias("rule_id"), F.col(kind).alias("kind"))
    named = named.withColumn("kind", F.coalesce("kind", F.lit("")))
    counts = (
        named.groupingSets([["rule_id", "kind"], ["rule_id"]], "rule_id", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("rule_id").alias("_rule"), F.col("kind").alias("_kind"), "n")
    )
    wanted = [(None, 1.0), *shares.items()]
    cells = [
        F.struct(F.lit(r).alias("rule_id"), F.lit(k).cast("string").alias("kind"), F.lit(s).alias("planned"))
        for r in planned
        for k, s in wanted
    ]
    plan = rows.sparkSession.range(1).select(F.inline(F.array(*cells))) if cells else None
    if plan is None:
        every = counts.select(
            F.col("_rule").alias("rule_id"), F.col("_kind").alias("kind"), "n",
            F.lit(None).cast("double").alias("planned"),
        )
    else:
        same = (F.col("rule_id") == F.col("_rule")) & F.col("kind").eqNullSafe(F.col("_kind"))
        every = plan.join(counts, same, "full_outer").select(
            F.coalesce("rule_id", "_rule").alias("rule_id"),
            F.coalesce("kind", "_kind").alias("kind"), "n", "planned",
        )
    n_rows = F.coalesce("n", F.lit(0))
    whole = F.max(F.when(F.col("kind").isNull(), n_rows)).over(Window.partitionBy("rule_id"))
    return every.withColumn("_whole", whole).select(
        "rule_id",
        "kind",
        n_rows.alias("n_rows"),
        F.when(F.col("_whole") > 0, n_rows / F.col("_whole")).alias("share"),
        F.coalesce("planned", F.lit(0.0)).alias("planned"),
    )
