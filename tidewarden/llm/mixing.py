"""Mixing sources to target weights.

A classifier that is trained on the labelled rows gives each document a posterior over the domains.
Rates between 0 and 1 are fitted so that the expected tokens of each domain meet its target, by
projected gradient descent on the squared relative misses. A gradient step needs one sum per
domain; the rates follow from the steps by plain arithmetic and are stored once in STEPS steps. The
length of a step comes from the last two (their moves and the change of the misses between them).

Only DataFrame and ML functions of Spark are used.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import forget, keep

FEATURES = 4096
EVIDENCE = 50.0  # words that a text counts as, so that long texts keep soft posteriors
STEPS = 20  # after so many the rates are written
SAMPLE = 20_000  # labelled documents at most that the classifier is fitted on
LONGEST = 50.0  # of a step length
SHORT = 0.02  # by which the totals may be below what the scarcest domain holds
CLOSE = 1e-4  # relative miss of every domain at which the steps end
STILL = 24  # they also end, with a warning, after so many without a lower greatest miss


def _features(df: DataFrame) -> DataFrame:
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}]+"), "")
    df = df.withColumn("words", words)
    df = HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="counts").transform(df)
    df = Normalizer(p=1.0, inputCol="counts", outputCol="shares").transform(df)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([EVIDENCE] * FEATURES), inputCol="shares", outputCol="features")
    return scale.transform(df)


def posteriors(documents: DataFrame, labelled: DataFrame, domains: list[str], carried: list[str]) -> DataFrame:
    """The carried columns of `documents` with tokens and p0, p1, ..., the posterior over `domains`.

    The classifier is fitted on at most SAMPLE labelled documents, drawn by a hash of doc_id; only
    their texts leave their place.
    """
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    known = labelled.where("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.withColumn("label", number.cast("double")).where("label >= 0").drop("domain")
    known = known.join(documents.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    tokens = F.regexp_count("text", F.lit(r"\S+"))
    rows = documents.select("text", *carried, F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # SAMPLE bounds it
    train = keep(_features(texts).select("label", "features"), "train")
    # The model has one class per label that occurs, in order: its labels are numbered without gaps.
    present = sorted(int(r["label"]) for r in train.select("label").distinct().collect())
    if not present:
        even = [F.lit(1.0 / len(domains)).alias(f"p{i}") for i in range(len(domains))]
        return rows.select(*carried, "tokens", *even)
    if lost := [d for i, d in enumerate(domains) if i not in present]:
        warnings.warn(f"no labelled rows of {', '.join(lost)}: posteriors of 0", stacklevel=2)
    place = F.array_position(F.array(*[F.lit(float(i)) for i in present]), F.col("label")) - 1
    model = NaiveBayes(smoothing=0.1).fit(train.withColumn("label", place.cast("double")))
    forget(train)
    scored = model.transform(_features(rows)).withColumn("_p", vector_to_array("probability"))
    full = {f"p{i}": F.col("_p")[present.index(i)] if i in present else F.lit(0.0) for i in range(len(domains))}
    return scored.withColumns(full).select(*carried, "tokens", *full)


def rate(steps: list[list[float]], start: Column) -> Column:
    """The rate after these steps from `start`: each moves it against the misses, back into 0..1."""
    for step in steps:
        move = sum((F.col(f"p{i}") * F.lit(x) for i, x in enumerate(step)), F.lit(0.0))
        start = F.least(F.lit(1.0), F.greatest(F.lit(0.0), start - move))
    return start


def drawn(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], seed: int = 17, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns of `documents`, tokens, p0, p1, ..., rate and taken; see `mix`.

    Carried columns are written once with the posteriors; the steps do not read them.
    """
    domains, total = list(weights), sum(weights.values())
    k = range(len(domains))
    rows = keep(posteriors(documents, labelled, domains, ["doc_id", *carried]), "posteriors")
    start = F.lit(1.0)

    def sums(w: Column, before: Column) -> tuple[list[float], float]:
        """Expected tokens of each domain at the rates w, and the squared length of the last move."""
        got = rows.agg(
            *[F.sum(F.col("tokens") * F.col(f"p{i}") * w) for i in k],
            F.sum(F.col("tokens") * (w - before) * (w - before)),
        ).first()
        return [x or 0.0 for x in got[:-1]], got[-1] or 0.0

    have, _ = sums(start, start)
    share = [weights[d] / total for d in domains]
    parts = lambda sums: [h / s for h, s in zip(sums, share, strict=True) if s > 0]
    fill = top = min((x for x in parts(have) if x > 0), default=0.0)
    # Scaled by what each domain has, the step length 1 is safe: posteriors sum to one.
    misses = lambda got: [(g - fill * s) / h if h > 0 else 0.0 for g, s, h in zip(got, share, have, strict=True)]
    got, length, steps = have, 1.0, []
    miss = misses(got)
    best, since, slow = max(map(abs, miss), default=0.0), 0, 0
    while max(map(abs, miss), default=0.0) >= CLOSE:
        if since > STILL:
            told = ", ".join(f"{d} {m:+.4f}" for d, m in zip(domains, miss, strict=True))
            warnings.warn(f"the rates do not meet the targets; misses relative to what is there: {told}", stacklevel=2)
            break
        if len(steps) == STEPS:
            moved = keep(rows.withColumn("start", rate(steps, start)), "rates")
            forget(rows)
            rows, start, steps = moved, F.col("start"), []
        before = rate(steps, start)
        steps = [*steps, [round(length * m, 9) for m in miss]]
        new, move = sums(rate(steps, start), before)
        bend = sum((x - y) ** 2 / h for x, y, h in zip(new, got, have, strict=True) if h > 0)
        length = min(LONGEST, max(1.0, move / bend)) if bend > 0 else 1.0
        got, last, miss = new, max(map(abs, miss)), misses(new)
        slow = slow + 1 if max(map(abs, miss)) > 0.9 * last else 0
        reached = min((x for x in parts(got) if x > 0), default=0.0)
        if slow == 2 and reached < fill and reached >= (1 - SHORT) * top:  # as full as it gets: the others come down
            fill = reached
            miss, length, slow = misses(got), 1.0, 0
        most = max(map(abs, miss))
        best, since = (most, 0) if most < best else (best, since + 1)
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("rate", rate(steps, start)).withColumn("taken", chance < F.col("rate")).drop("start")


def mix(documents: DataFrame, labelled: DataFrame, weights: dict[str, float], seed: int = 17) -> DataFrame:
    """One row per document: doc_id, tokens, p (posterior by domain in the order of `weights`),
    rate (0 to 1) and taken (drawn with that rate by a hash of doc_id).

    `labelled` holds doc_id and domain. The targets are totals in the wanted proportion: at first as
    large as the scarcest domain allows at rates of 1, and where the steps leave a domain short by
    SHORT at most that is as full as it gets, as large as it is then. A domain with weight 0 gets rates near 0. A domain
    without any expected tokens cannot bound the others. Steps go on until every domain is CLOSE to
    its target, or, where soft posteriors admit no such rates or only after very many steps, until
    the greatest miss no longer falls; then a warning names each miss. Without labelled rows all
    posteriors are even. Null and empty texts have no tokens and do not affect the sums; they get a
    rate like others. Repeated rows get the same rate and draw; a null doc_id draws as one. An empty
    table gives no rows; other columns are not read.
    """
    rows = drawn(documents, labelled, weights, seed)
    p = F.array(*[f"p{i}" for i in range(len(weights))])
    return rows.select("doc_id", "tokens", p.alias("p"), "rate", "taken")
