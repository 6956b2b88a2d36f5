"""Views of the driver tables in the shapes the operators take, in Spark and in SQL.

The tables have no scores, verdicts or sessions. They are derived row by row with integer
arithmetic and single divisions, so both engines give the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions import text as tx

# A small rule catalog: slug, regime, rule id, text.
RULES = (
    ("arena_chat", "chat", "R1", "Rough banter about the match is fine."),
    ("arena_chat", "chat", "R2", "No insults about who somebody is."),
    ("arena_chat", "chat", "R3", "No sexual messages."),
    ("harbor_market", "chat", "R1", "No threats against buyers or sellers."),
    ("harbor_market", "chat", "R2", "No advertising for other shops."),
    ("harbor_market", "chat", "R3", "Stay polite when a deal falls through."),
    ("town_comments", "comment", "R1", "No threats against neighbours or officials."),
    ("town_comments", "comment", "R2", "No insults about origin or belief."),
    ("town_comments", "comment", "R3", "Criticise the plan, not the person."),
    ("book_circle", "comment", "R1", "Keep explicit scenes out of reviews."),
    ("book_circle", "comment", "R2", "No personal attacks on authors."),
    ("book_circle", "comment", "R3", "Do not post a review twice."),
    ("study_hub", "hybrid", "R1", "No swearing at all."),
    ("study_hub", "hybrid", "R2", "No mocking of other learners."),
    ("study_hub", "hybrid", "R3", "No threats, not even as a joke."),
    ("study_hub", "hybrid", "R4", "No sexual content."),
)
SLUGS = ("arena_chat", "book_circle", "harbor_market", "study_hub", "town_comments")

# Lowest score at which a rule counts as broken: slug, rule id, score, bound.
THRESHOLDS = (
    ("arena_chat", "R2", "identity_attack", 0.4),
    ("arena_chat", "R3", "sexual_explicit", 0.5),
    ("harbor_market", "R1", "threat", 0.3),
    ("harbor_market", "R3", "toxicity", 0.8),
    ("town_comments", "R1", "threat", 0.3),
    ("town_comments", "R2", "identity_attack", 0.3),
    ("town_comments", "R3", "insult", 0.6),
    ("book_circle", "R1", "sexual_explicit", 0.4),
    ("book_circle", "R2", "insult", 0.7),
    ("study_hub", "R1", "toxicity", 0.3),
    ("study_hub", "R2", "insult", 0.4),
    ("study_hub", "R3", "threat", 0.2),
    ("study_hub", "R4", "sexual_explicit", 0.2),
)
# The rule a flagged row of a 0/1 corpus breaks.
POSITIVE_RULES = (
    ("arena_chat", "R2"),
    ("harbor_market", "R3"),
    ("town_comments", "R3"),
    ("book_circle", "R2"),
    ("study_hub", "R2"),
)


def _values(rows: tuple, columns: str) -> str:
    def literal(x: object) -> str:
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else f"'{x}'"

    body = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


RULES_SQL = _values(RULES, "slug, regime, rule_id, rule_text")
THRESHOLDS_SQL = _values(THRESHOLDS, "slug, rule_id, feature, min_score")
# A stricter second labeller.
STRICT_SQL = _values(
    tuple((s, r, f, round(m - 0.1, 1)) for s, r, f, m in THRESHOLDS),
    "slug, rule_id, feature, min_score",
)
POSITIVE_SQL = _values(POSITIVE_RULES, "slug, rule_id")

CTES = {
    "rules": RULES_SQL,
    "rule_sets": "SELECT DISTINCT slug, regime FROM rules",
    "thresholds": THRESHOLDS_SQL,
    "strict": STRICT_SQL,
    "positive": POSITIVE_SQL,
    "units": """
        SELECT doc_id, text, lang, source,
               CAST((doc_id * 7919 + 13) % 1000 AS DOUBLE) / 1000 AS a,
               CAST((doc_id * 6101 + 29) % 1000 AS DOUBLE) / 1000 AS b,
               CAST((doc_id * 4421 + 71) % 1000 AS DOUBLE) / 1000 AS c,
               CAST((doc_id * 3457 + 97) % 1000 AS DOUBLE) / 1000 AS t
        FROM documents""",
    "corpus": """
        SELECT doc_id, text, lang, source,
               t * t AS toxicity, t * t * t * t AS severe_toxicity,
               CASE WHEN lang = 'en' THEN b * t END AS obscene, b * b * b * b AS threat,
               a * t AS insult, a * a * a * a AS identity_attack,
               c * c * c * c AS sexual_explicit
        FROM units""",
    "buckets": """
        SELECT *, CASE WHEN identity_attack >= 0.4 THEN 'identity_attack'
                       WHEN threat >= 0.4 THEN 'threat'
                       WHEN sexual_explicit >= 0.4 THEN 'sexual_explicit'
                       WHEN toxicity >= 0.7 THEN 'high_tox'
                       WHEN toxicity >= 0.3 THEN 'mid_tox' ELSE 'low_tox' END AS bucket
        FROM corpus""",
    "stream": """
        SELECT *, row_number() OVER (
                   ORDER BY sha256('4096:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS stream_idx
        FROM buckets""",
    "inbox": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY stream_idx) AS rn
            FROM stream WHERE stream_idx < 25000 AND length(text) BETWEEN 5 AND 1000)
        WHERE rn <= CASE bucket WHEN 'identity_attack' THEN 10 WHEN 'threat' THEN 7
                                WHEN 'sexual_explicit' THEN 5 WHEN 'high_tox' THEN 13
                                WHEN 'mid_tox' THEN 10 ELSE 5 END""",
    "chat": """
        SELECT conv_id * 1000 + turn AS row_id, text AS user_input
        FROM conversations WHERE role = 'user'""",
    "flags": """
        SELECT d.doc_id, d.text AS user_input, l.toxic AS toxicity, 1 - l.quality AS jailbreaking
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "content": """
        SELECT *, CASE WHEN length(text) < 150 THEN 'chat' ELSE 'comment' END AS regime
        FROM corpus""",
    "pairs": """
        SELECT c.*, r.slug FROM content c JOIN rule_sets r
        ON c.regime = CASE WHEN r.regime = 'chat' THEN 'chat' ELSE 'comment' END""",
    "long_scores": """
        SELECT doc_id, slug, lang, source, unnest(['toxicity', 'severe_toxicity', 'obscene',
                   'threat', 'insult', 'identity_attack', 'sexual_explicit']) AS feature,
               unnest([toxicity, severe_toxicity, coalesce(obscene, 0), threat, insult,
                   identity_attack, sexual_explicit]) AS score
        FROM pairs""",
    "verdicts": """
        SELECT s.doc_id, s.slug, any_value(s.lang) AS lang, any_value(s.source) AS source,
               coalesce(string_agg(DISTINCT t.rule_id, ',' ORDER BY t.rule_id), '') AS rules,
               count(t.rule_id) > 0 AS violates_policy
        FROM long_scores s LEFT JOIN thresholds t
          ON s.slug = t.slug AND s.feature = t.feature AND s.score >= t.min_score
        GROUP BY s.doc_id, s.slug""",
    "strict_verdicts": """
        SELECT s.doc_id, s.slug,
               coalesce(string_agg(DISTINCT t.rule_id, ',' ORDER BY t.rule_id), '') AS rules,
               count(t.rule_id) > 0 AS violates_policy
        FROM long_scores s LEFT JOIN strict t
          ON s.slug = t.slug AND s.feature = t.feature AND s.score >= t.min_score
        GROUP BY s.doc_id, s.slug""",
    "judged": """
        SELECT d.doc_id, ['arena_chat', 'book_circle', 'harbor_market', 'study_hub',
                'town_comments'][d.doc_id % 5 + 1] AS slug, l.toxic = 1 AS violates_policy,
               CASE WHEN l.toxic = 1
                    THEN ['R' || (d.doc_id % 9 + 1), 'R' || (d.doc_id % 4 + 1)]
                    WHEN l.toxic = 0 AND d.doc_id % 7 = 0 THEN ['R' || (d.doc_id * 13)]
                    WHEN l.toxic = 0 THEN CAST([] AS VARCHAR[]) END AS violated_rules,
               CASE d.lang WHEN 'en' THEN 'low' WHEN 'de' THEN 'moderate'
                           WHEN 'fr' THEN 'high' ELSE 'HIGH' END AS severity,
               ['harassment', 'hate_speech', 'sexual', 'violence', 'spam', 'self_harm', 'other',
                'none', 'rude'][d.doc_id % 9 + 1] AS primary_category,
               string_split(d.text, chr(10)) AS evidence_spans,
               ['no_action', 'warn', 'hide', 'remove', 'escalate', 'ban',
                'mute'][d.doc_id % 7 + 1] AS suggested_action,
               CAST((d.doc_id * 2711 + 5) % 1100 AS DOUBLE) / 1000 AS confidence,
               d.text AS reasoning
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "scored": """
        SELECT l.doc_id, c.lang, c.source, l.toxic = 1 AS gold, c.toxicity >= 0.3 AS pred,
               (l.toxic = 1) = (c.toxicity >= 0.3) AS correct,
               CAST((l.doc_id * 2711 + 5) % 1000 AS DOUBLE) / 1000 AS confidence,
               c.toxicity, c.insult, c.identity_attack, c.text
        FROM labels l JOIN corpus c ON l.doc_id = c.doc_id""",
    "points": """
        SELECT *, row_number() OVER (ORDER BY confidence) AS place,
               sum(n_rows) OVER (ORDER BY confidence) AS n,
               sum(n_correct) OVER (ORDER BY confidence) AS hits
        FROM (SELECT CAST((doc_id * 271129 + 5) % 1000000 AS DOUBLE) / 1000000 AS confidence,
                     count(*) AS n_rows, count(*) FILTER (WHERE correct) AS n_correct
              FROM scored GROUP BY 1)""",
    "messages": """
        SELECT event_id, ts, user_id,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS target_id,
               event_type AS text, event_type = 'error' AS is_stop,
               event_type = 'purchase' AS is_promo,
               event_type IN ('view', 'click') AS is_off_topic, value
        FROM events""",
    "sessions": """
        SELECT event_id AS session_id, user_id AS auditor,
               ['arena_chat', 'book_circle', 'harbor_market', 'study_hub',
                'town_comments'][k % 5 + 1] AS rule_set_slug,
               15 AS target_n, k % 17 AS n_completed, k % 6 AS skips_used,
               k % 17 + k % 6 AS cursor, ts AS started_at,
               ts + to_microseconds(CAST(round(value * 60) AS BIGINT) * 1000000)
                   AS last_activity_at,
               CASE WHEN text <> 'view'
                    THEN ts + to_microseconds(CAST(round(value * 60) AS BIGINT) * 1000000)
                    END AS ended_at,
               text = 'signup' AS dev_mode,
               CASE WHEN text = 'error' THEN 'quit' ELSE 'judge' END AS last_action
        FROM messages""",
    "action_log": """
        SELECT user_id AS auditor, CAST(ts AS DATE) AS day, ts, event_id,
               CASE text WHEN 'purchase' THEN 'judge' WHEN 'click' THEN 'judge'
                         WHEN 'error' THEN 'skip' WHEN 'view' THEN 'skip'
                         ELSE 'discard' END AS action
        FROM messages""",
}
_NEEDS = {
    "rule_sets": ("rules",),
    "corpus": ("units",),
    "buckets": ("corpus",),
    "stream": ("buckets",),
    "inbox": ("stream",),
    "content": ("corpus",),
    "pairs": ("content", "rule_sets"),
    "long_scores": ("pairs",),
    "verdicts": ("long_scores", "thresholds"),
    "strict_verdicts": ("long_scores", "strict"),
    "scored": ("corpus",),
    "points": ("scored",),
    "sessions": ("messages",),
    "action_log": ("messages",),
}


def with_views(names: str, body: str) -> str:
    """SQL of a query over the named views, and the views they are made of."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    return spark.sql(RULES_SQL)


def rule_sets(spark: SparkSession) -> DataFrame:
    return rules(spark).select("slug", "regime").distinct()


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.sql(THRESHOLDS_SQL)


def strict_thresholds(spark: SparkSession) -> DataFrame:
    return spark.sql(STRICT_SQL)


def positive_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(POSITIVE_SQL)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    # SQL text, as in the view: hundreds of single column calls take longer than the query.
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            "doc_id",
            "text",
            "lang",
            "source",
            "CAST((doc_id * 7919 + 13) % 1000 AS DOUBLE) / 1000 AS a",
            "CAST((doc_id * 6101 + 29) % 1000 AS DOUBLE) / 1000 AS b",
            "CAST((doc_id * 4421 + 71) % 1000 AS DOUBLE) / 1000 AS c",
            "CAST((doc_id * 3457 + 97) % 1000 AS DOUBLE) / 1000 AS t",
        )
        .selectExpr(
            "doc_id",
            "text",
            "lang",
            "source",
            "t * t AS toxicity",
            "t * t * t * t AS severe_toxicity",
            "CASE WHEN lang = 'en' THEN b * t END AS obscene",
            "b * b * b * b AS threat",
            "a * t AS insult",
            "a * a * a * a AS identity_attack",
            "c * c * c * c AS sexual_explicit",
        )
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
            F.col("text").alias("user_input"),
        )
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("user_input"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id",
        "user_input",
        F.col("toxic").alias("toxicity"),
        (1 - F.col("quality")).alias("jailbreaking"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn(
        "regime", F.when(F.length("text") < 150, "chat").otherwise("comment")
    )


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids of the rows that carry a human label."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled.select(tx.source_id(F.col("text"), F.col("doc_id")).alias("source_id"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        tx.source_id(F.col("text"), F.col("doc_id")).alias("source_id"), "doc_id", "source"
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgment per document, with the faults a hand-made label file has."""
    doc = F.col("doc_id")

    def numbered(n) -> Column:
        return F.concat(F.lit("R"), n.cast("string"))

    def pick(*values: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (doc % len(values)).cast("int"))

    toxic = F.col("toxic")
    judgment = F.struct(
        (toxic == 1).alias("violates_policy"),
        F.when(toxic == 1, F.array(numbered(doc % 9 + 1), numbered(doc % 4 + 1)))
        .when((toxic == 0) & (doc % 7 == 0), F.array(numbered(doc * 13)))
        .when(toxic == 0, F.array().cast("array<string>"))
        .alias("violated_rules"),
        F.when(F.col("lang") == "en", "low")
        .when(F.col("lang") == "de", "moderate")
        .when(F.col("lang") == "fr", "high")
        .otherwise("HIGH")
        .alias("severity"),
        pick(
            "harassment", "hate_speech", "sexual", "violence", "spam", "self_harm", "other",
            "none", "rude",
        ).alias("primary_category"),
        F.split("text", "\n").alias("evidence_spans"),
        pick("no_action", "warn", "hide", "remove", "escalate", "ban", "mute").alias(
            "suggested_action"
        ),
        (((doc * 2711 + 5) % 1100).cast("double") / 1000).alias("confidence"),
        F.col("text").alias("reasoning"),
    )
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    return docs.select("doc_id", pick(*SLUGS).alias("slug"), judgment.alias("judgment"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a predicted verdict and its confidence."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    gold, pred = F.col("toxic") == 1, F.col("toxicity") >= 0.3
    return corpus(spark, sf_dir).join(labelled, "doc_id").select(
        "doc_id",
        "lang",
        "source",
        gold.alias("gold"),
        pred.alias("pred"),
        (gold == pred).alias("correct"),
        (((F.col("doc_id") * 2711 + 5) % 1000).cast("double") / 1000).alias("confidence"),
        "toxicity",
        "insult",
        "identity_attack",
        "text",
    )


def messages_from(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        k.alias("k"),
        (k % 20).alias("target_id"),
        kind.alias("text"),
        (kind == "error").alias("is_stop"),
        (kind == "purchase").alias("is_promo"),
        kind.isin("view", "click").alias("is_off_topic"),
        "value",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(table(spark, sf_dir, "events"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read as the record of one session that lasted `value` minutes."""
    k = F.col("k")
    end = F.timestamp_micros(
        F.unix_micros("ts") + F.round(F.col("value") * 60).cast("bigint") * 1_000_000
    )
    return messages(spark, sf_dir).select(
        F.col("event_id").alias("session_id"),
        F.col("user_id").alias("auditor"),
        F.get(F.array(*[F.lit(s) for s in SLUGS]), k % 5).alias("rule_set_slug"),
        F.lit(15).alias("target_n"),
        (k % 17).alias("n_completed"),
        (k % 6).alias("skips_used"),
        (k % 17 + k % 6).alias("cursor"),
        F.col("ts").alias("started_at"),
        end.alias("last_activity_at"),
        F.when(F.col("text") != "view", end).alias("ended_at"),
        F.lit(None).cast("string").alias("ended_reason"),
        (F.col("text") == "signup").alias("dev_mode"),
        F.when(F.col("text") == "error", "quit").otherwise("judge").alias("last_action"),
    )


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("text")
    return messages(spark, sf_dir).select(
        F.col("user_id").alias("auditor"),
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        F.when(kind.isin("purchase", "click"), "judge")
        .when(kind.isin("error", "view"), "skip")
        .otherwise("discard")
        .alias("action"),
    )
