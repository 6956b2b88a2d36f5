"""Agreement, F1, slices and calibration over derived and human verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import scores, text
from tidewarden.operators import evaluation, labels
from tidewarden.plans import views
from tidewarden.plans.label_plans import strict_verdicts, verdicts
from tidewarden.plans.registry import query

_CELLS = """count(*) FILTER (WHERE {g} AND {p}) AS tp, count(*) FILTER (WHERE NOT {g} AND {p}) AS fp,
            count(*) FILTER (WHERE {g} AND NOT {p}) AS fn"""
_PRECISION = "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision"
_RECALL = "CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall"
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END"
_BIN = "CAST(least(floor(confidence * 10), 9) AS INTEGER)"


def cells(gold: str, pred: str) -> str:
    return _CELLS.format(g=gold, p=pred)


@query(
    "agreement",
    """SELECT slug, n_pairs, n_equal, CAST(n_equal AS DOUBLE) / n_pairs AS agreement,
              CAST(n_equal AS DOUBLE) / n_pairs >= 0.85 AS passes
       FROM (SELECT a.slug, count(*) AS n_pairs,
                    count(*) FILTER (WHERE a.violates_policy = b.violates_policy) AS n_equal
             FROM verdicts a JOIN strict_verdicts b ON a.doc_id = b.doc_id AND a.slug = b.slug
             GROUP BY ROLLUP (a.slug))""",
    "verdicts strict_verdicts",
)
def _(spark, d):
    both = labels.join_raters(verdicts(spark, d), strict_verdicts(spark, d), ["doc_id", "slug"])
    return evaluation.agreement(both, "slug")


@query(
    "binary_f1",
    f"""SELECT *, {_PRECISION}, {_RECALL}, {_F1} AS f1
        FROM (SELECT {cells('gold', 'pred')},
                     count(*) FILTER (WHERE NOT gold AND NOT pred) AS tn FROM scored)""",
    "scored",
)
def _(spark, d):
    return evaluation.binary_f1(views.scored(spark, d), "gold", "pred")


# Buckets as human classes; the predicted class takes the score buckets without `threat`.
_CLASSES = """
    SELECT bucket AS gold, CASE WHEN identity_attack >= 0.4 THEN 'identity_attack'
                                WHEN sexual_explicit >= 0.3 THEN 'sexual_explicit'
                                WHEN toxicity >= 0.6 THEN 'high_tox'
                                WHEN toxicity >= 0.3 THEN 'mid_tox' ELSE 'low_tox' END AS pred
    FROM buckets"""
_CLASS_F1 = f"""
    SELECT label, tp, fp, fn, {_F1} AS f1
    FROM (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
                 CAST(sum(fn) AS BIGINT) AS fn
          FROM (SELECT gold AS label, CAST(gold = pred AS INTEGER) AS tp, 0 AS fp,
                       CAST(gold <> pred AS INTEGER) AS fn FROM ({_CLASSES})
                UNION ALL
                SELECT pred, 0, 1, 0 FROM ({_CLASSES}) WHERE gold <> pred)
          GROUP BY label)"""


def _classes(spark, d):
    score = F.col
    pred = (
        F.when(score("identity_attack") >= 0.4, "identity_attack")
        .when(score("sexual_explicit") >= 0.3, "sexual_explicit")
        .when(score("toxicity") >= 0.6, "high_tox")
        .when(score("toxicity") >= 0.3, "mid_tox")
        .otherwise("low_tox")
    )
    return views.corpus(spark, d).select(scores.bucket().alias("gold"), pred.alias("pred"))


@query("class_f1", _CLASS_F1, "buckets")
def _(spark, d):
    return evaluation.class_f1(_classes(spark, d), "gold", "pred")


@query(
    "macro_f1",
    f"SELECT count(*) AS n_classes, round(avg(f1), 6) AS macro_f1 FROM ({_CLASS_F1})",
    "buckets",
)
def _(spark, d):
    return evaluation.macro_f1(_classes(spark, d), "gold", "pred")


@query(
    "rule_slice_metrics",
    f"""SELECT slug, rule_id, tp, fp, fn, {_PRECISION}, {_RECALL}
        FROM (SELECT slug, rule_id, {cells('in_gold', 'in_pred')}
              FROM (SELECT coalesce(g.slug, p.slug) AS slug,
                           coalesce(g.rule_id, p.rule_id) AS rule_id,
                           g.rule_id IS NOT NULL AS in_gold, p.rule_id IS NOT NULL AS in_pred
                    FROM (SELECT doc_id, slug, unnest(string_split(rules, ',')) AS rule_id
                          FROM strict_verdicts WHERE rules <> '') g
                    FULL JOIN (SELECT doc_id, slug, unnest(string_split(rules, ',')) AS rule_id
                               FROM verdicts WHERE rules <> '') p
                      ON g.doc_id = p.doc_id AND g.slug = p.slug AND g.rule_id = p.rule_id)
              GROUP BY slug, rule_id)""",
    "verdicts strict_verdicts",
)
def _(spark, d):
    return evaluation.rule_slice_metrics(
        strict_verdicts(spark, d), verdicts(spark, d), ["doc_id", "slug"]
    )


@query(
    "edge_slice_metrics",
    f"""SELECT edge_tested, tp, fp, fn, {_PRECISION}, {_RECALL}
        FROM (SELECT 'R' || (doc_id % 8 + 1) || ':' || lang AS edge_tested, {cells('gold', 'pred')}
              FROM scored GROUP BY 1)""",
    "scored",
)
def _(spark, d):
    tag = F.concat(F.lit("R"), (F.col("doc_id") % 8 + 1).cast("string"), F.lit(":"), "lang")
    rows = views.scored(spark, d).withColumn("edge_tested", tag)
    return evaluation.edge_slice_metrics(rows, "edge_tested", "gold", "pred")


@query(
    "edge_rule_metrics",
    f"""SELECT rule_id, tp, fp, fn, {_PRECISION}, {_RECALL}
        FROM (SELECT 'R' || (doc_id % 8 + 1) AS rule_id, {cells('gold', 'pred')}
              FROM scored GROUP BY 1)""",
    "scored",
)
def _(spark, d):
    tag = F.concat(F.lit("R"), (F.col("doc_id") % 8 + 1).cast("string"), F.lit(":"), "lang")
    rows = views.scored(spark, d).withColumn("rule_id", text.edge_rule(tag))
    return evaluation.edge_slice_metrics(rows, "rule_id", "gold", "pred")


# Some rows have no confidence, or one above 1.
_ODD = "CASE WHEN doc_id % 7 > 0 THEN confidence + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END END"
_PART_SCORED = f"SELECT * REPLACE ({_ODD} AS confidence) FROM scored"
_PART_BIN = f"CASE WHEN confidence BETWEEN 0 AND 1 THEN {_BIN} END"


def _part_scored(spark, d):
    return views.scored(spark, d).withColumn("confidence", F.expr(_ODD))


@query(
    "reliability_bins",
    f"""SELECT {_PART_BIN} AS bin, count(*) AS n_rows, count(*) FILTER (WHERE correct) AS n_correct,
               round(sum(confidence) FILTER (WHERE confidence BETWEEN 0 AND 1) / count(*), 6)
                   AS mean_confidence,
               round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy
        FROM ({_PART_SCORED}) GROUP BY 1""",
    "scored",
)
def _(spark, d):
    return evaluation.reliability_bins(_part_scored(spark, d), "confidence", "correct")


_ECE = f"""
    SELECT {{by}}CAST(sum(CASE WHEN bin IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_rows,
           CAST(sum(CASE WHEN bin IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_left_out,
           round(sum(gap) FILTER (WHERE bin IS NOT NULL) / sum(n) FILTER (WHERE bin IS NOT NULL), 6)
               AS ece
    FROM (SELECT {{by}}{_PART_BIN} AS bin, count(*) AS n,
                 abs(count(*) FILTER (WHERE correct) - sum(confidence)) AS gap
          FROM ({_PART_SCORED}) GROUP BY ALL) GROUP BY ALL"""


@query("ece", _ECE.format(by=""), "scored")
def _(spark, d):
    return evaluation.ece(_part_scored(spark, d), "confidence", "correct")


@query("ece_by_category", _ECE.format(by="lang, "), "scored")
def _(spark, d):
    return evaluation.ece(_part_scored(spark, d), "confidence", "correct", by=["lang"])


# Least-squares monotone fit as max over starts of min over ends of the weighted mean.
@query(
    "isotonic_calibration",
    """SELECT confidence, n_rows, n_correct, round(max(lower), 6) AS calibrated
       FROM (SELECT i.confidence, i.n_rows, i.n_correct, j.place,
                    min((k.hits - j.hits + j.n_correct) / CAST(k.n - j.n + j.n_rows AS DOUBLE))
                        AS lower
             FROM points i JOIN points j ON j.place <= i.place JOIN points k ON k.place >= i.place
             GROUP BY ALL)
       GROUP BY ALL""",
    "points",
)
def _(spark, d):
    fine = ((F.col("doc_id") * 271129 + 5) % 1000000).cast("double") / 1000000
    rows = views.scored(spark, d).withColumn("confidence", fine)
    return evaluation.isotonic_calibration(rows, "confidence", "correct")


@query(
    "classifier_disagreement",
    """SELECT slug, count(*) AS n_rows, count(*) FILTER (WHERE differ) AS n_differ,
              CAST(count(*) FILTER (WHERE differ) AS DOUBLE) / count(*) AS share
       FROM (SELECT v.slug, (c.toxicity >= 0.5) <> v.violates_policy AS differ
             FROM verdicts v JOIN corpus c USING (doc_id)) GROUP BY slug""",
    "verdicts",
)
def _(spark, d):
    return evaluation.classifier_disagreement(
        verdicts(spark, d), "toxicity", "violates_policy", 0.5, "slug"
    )


@query(
    "rater_disagreement",
    """SELECT doc_id, slug, CAST(sum(CAST(v AS INTEGER)) AS BIGINT) AS n_yes,
              CAST(sum(CAST(NOT v AS INTEGER)) AS BIGINT) AS n_no
       FROM (SELECT doc_id, slug, violates_policy AS v FROM verdicts
             UNION ALL SELECT doc_id, slug, violates_policy FROM strict_verdicts
             UNION ALL SELECT p.doc_id, p.slug, l.toxic = 1 FROM pairs p JOIN labels l USING (doc_id))
       GROUP BY doc_id, slug HAVING count(DISTINCT v) = 2""",
    "verdicts strict_verdicts pairs",
)
def _(spark, d):
    first, second = verdicts(spark, d), strict_verdicts(spark, d)
    human = first.join(views.table(spark, d, "labels"), "doc_id").withColumn(
        "violates_policy", F.col("toxic") == 1
    )
    votes = labels.union_rows(
        *[v.select("doc_id", "slug", "violates_policy") for v in (first, second, human)]
    )
    return evaluation.rater_disagreement(votes, ["doc_id", "slug"])


@query(
    "category_polarity",
    """SELECT *, n_violating > 0 AND n_allowed > 0 AS both
       FROM (SELECT primary_category, count(*) FILTER (WHERE violates_policy) AS n_violating,
                    count(*) FILTER (WHERE NOT violates_policy) AS n_allowed
             FROM judged GROUP BY primary_category)""",
    "judged",
)
def _(spark, d):
    return evaluation.category_polarity(views.judged(spark, d).select("judgment.*"))


_WHOLE_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END"
_QUALITY = f"""
    SELECT {{by}}, tp + fp + fn + tn AS n_rows, {_PRECISION}, {_RECALL}, round(f1_yes, 6) AS f1,
           round((coalesce(f1_yes, 0) + coalesce(f1_no, 0)) / 2, 6) AS macro_f1,
           round(gap / (tp + fp + fn + tn), 6) AS ece
    FROM (SELECT *, {_WHOLE_F1} AS f1_yes, {_WHOLE_F1.replace('tp', 'tn')} AS f1_no
          FROM (SELECT {{by}}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
                       CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn,
                       sum(gap) AS gap
                FROM (SELECT {{by}}, {_BIN} AS bin, {cells('gold', 'pred')},
                             count(*) FILTER (WHERE NOT gold AND NOT pred) AS tn,
                             abs(count(*) FILTER (WHERE correct) - sum(confidence)) AS gap
                      FROM ({{rel}}) GROUP BY ALL)
                GROUP BY {{by}}))"""
_EDGE = """CASE WHEN doc_id % 5 > 0
                THEN 'R' || CAST(doc_id % 4 + 1 AS {string}) || ':' || lang END"""
_NAMED = """CASE WHEN gold THEN {list}('R' || CAST(doc_id % 9 + 1 AS {string}),
                                       'R' || CAST(doc_id % 4 + 1 AS {string})) END"""


@query(
    "identity_slices",
    _QUALITY.format(
        by="attribute, grain, value",
        rel=f"""
            WITH base AS (
                SELECT gold, pred, correct, confidence, attribute, {_BIN} AS bin,
                       {_EDGE.format(string='VARCHAR')} AS edge,
                       {_NAMED.format(string='VARCHAR', list='list_value')} AS rules
                FROM (SELECT *, 'english' AS attribute FROM scored WHERE lang = 'en'
                      UNION ALL SELECT *, 'long' FROM scored WHERE length(text) > 1000
                      UNION ALL SELECT *, 'early' FROM scored WHERE source < 'src15'))
            SELECT * EXCLUDE (edge, rules, bin), 'all' AS grain, 'all' AS value FROM base
            UNION ALL SELECT * EXCLUDE (edge, rules, bin), 'bin', CAST(bin AS VARCHAR) FROM base
            UNION ALL SELECT * EXCLUDE (edge, rules, bin), 'edge', edge FROM base
                      WHERE edge IS NOT NULL
            UNION ALL SELECT * EXCLUDE (edge, rules, bin), 'rule', unnest(list_distinct(rules))
                      FROM base""",
    ),
    "scored",
)
def _(spark, d):
    rows = views.scored(spark, d).withColumns(
        {
            "english": F.col("lang") == "en",
            "long": F.length("text") > 1000,
            "early": F.col("source") < "src15",
            "edge": F.expr(_EDGE.format(string="STRING")),
            "rules": F.expr(_NAMED.format(string="STRING", list="array")),
        }
    )
    return evaluation.identity_slices(
        rows, ["english", "long", "early"], "gold", "pred", "confidence", "correct", "rules", "edge"
    )


@query(
    "compare_scorers",
    _QUALITY.format(
        by="scorer",
        rel="""SELECT gold, score >= 0.5 AS pred, gold AS correct, score AS confidence, scorer
               FROM (SELECT gold, unnest([toxicity, insult, confidence]) AS score,
                            unnest(['toxicity', 'insult', 'model']) AS scorer
                     FROM scored WHERE gold IS NOT NULL AND toxicity BETWEEN 0 AND 1
                       AND insult BETWEEN 0 AND 1 AND confidence BETWEEN 0 AND 1)""",
    ),
    "scored",
)
def _(spark, d):
    return evaluation.compare_scorers(
        views.scored(spark, d),
        {"toxicity": "toxicity", "insult": "insult", "model": "confidence"},
        "gold",
        0.5,
    )
