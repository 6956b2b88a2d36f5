"""Contracts of the moderation data model: enumerations, limits and Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: enumerations, patterns and limits every producer and consumer agrees on. ---

SEVERITIES = ("low", "moderate", "high", "critical")
CATEGORIES = (
    "harassment",
    "hate_speech",
    "sexual",
    "violence",
    "spam",
    "self_harm",
    "other",
    "none",
)
ACTIONS = ("no_action", "warn", "hide", "remove", "escalate", "ban")
REGIMES = ("chat", "comment", "hybrid")
CONTENT_REGIMES = ("chat", "comment")

RULE_ID_PATTERN = r"^R\p{Nd}{1,3}\z"
SLUG_PATTERN = r"^[a-z0-9_]+\z"

MAX_VIOLATED_RULES = 10
MAX_SPANS = 5
MAX_SPAN_CHARS = 300
MAX_REASONING_CHARS = 400
MAX_RULE_CHARS = 300
MAX_SLUG_CHARS = 64
MAX_NAME_CHARS = 120
MIN_DESCRIPTION_CHARS, MAX_DESCRIPTION_CHARS = 20, 500
MIN_RULES, MAX_RULES = 3, 20
MAX_CONTENT_CHARS = 4000
MAX_TITLE_CHARS = 300

MIN_TEXT_CHARS, MAX_TEXT_CHARS, CHAT_TEXT_BELOW = 5, 1000, 150
CHAT_TRACK_MAX_CHARS = 120

SCORES = (
    "toxicity",
    "severe_toxicity",
    "obscene",
    "threat",
    "insult",
    "identity_attack",
    "sexual_explicit",
)
FEATURES = ("toxicity", "threat", "obscene", "insult", "identity_attack", "severe_toxicity")

# bucket -> (score, lower bound); the first that holds wins, rows without a match are low_tox.
BUCKET_BOUNDS = (
    ("identity_attack", "identity_attack", 0.4),
    ("threat", "threat", 0.4),
    ("sexual_explicit", "sexual_explicit", 0.4),
    ("high_tox", "toxicity", 0.7),
    ("mid_tox", "toxicity", 0.3),
)
BUCKET_TARGETS = {
    "identity_attack": 10,
    "threat": 7,
    "sexual_explicit": 5,
    "high_tox": 13,
    "mid_tox": 10,
    "low_tox": 5,
}
GOLDEN_TARGETS = {
    "identity_attack": 25,
    "threat": 20,
    "sexual_explicit": 15,
    "high_tox": 30,
    "mid_tox": 30,
    "low_tox": 30,
}
BAND_SHARES = {"high": 0.35, "mid": 0.25, "category": 0.25, "clean": 0.15}
GENERATOR_SHARES = {"clean": 0.40, "borderline": 0.30, "violation": 0.20, "obfuscated": 0.10}
CALL_SHARES = {"clear_violation": 0.40, "lookalike": 0.30, "borderline": 0.30}
SLICE_QUOTAS = {
    "R1": 12,
    "R2": 15,
    "R3": 10,
    "R4": 12,
    "R5": 10,
    "R6": 10,
    "R7": 8,
    "R8": 8,
    "clean": 10,
    "foil": 5,
}

SAMPLE_SEED, SAMPLE_SCAN_ROWS = 4096, 25_000
CANDIDATE_SCAN_ROWS, PROFILE_SCAN_ROWS, CHAT_PROFILE_ROWS = 200, 1_000, 5_080
HIGH_TOXICITY = 0.7
LOW_CONFIDENCE = 0.7
AGREEMENT_GATE = 0.85

SESSION_WARN_MINUTES, SESSION_CAP_MINUTES, COOLDOWN_MINUTES, MAX_SKIPS = 25, 30, 90, 3

TRUE_WORDS = ("y", "yes", "true", "1")
FALSE_WORDS = ("n", "no", "false", "0")

JUDGMENT_FIELDS = (
    "violates_policy",
    "violated_rules",
    "severity",
    "primary_category",
    "evidence_spans",
    "suggested_action",
    "confidence",
    "reasoning",
)
JUDGMENT_DEFAULTED = ("violated_rules", "evidence_spans")
JUDGMENT_REQUIRED = tuple(f for f in JUDGMENT_FIELDS if f not in JUDGMENT_DEFAULTED)
RULE_SET_FIELDS = ("slug", "name", "regime", "description", "rules", "version", "created")
CONTENT_FIELDS = ("text", "regime", "article_title", "language")
ADVERSARIAL_AUDITOR, ADVERSARIAL_SOURCE = "adversarial", "handcrafted"
EDGE_PATTERN = r"^R\p{Nd}{1,3}:\S"

# --- end of fixed values ---

_STR, _DBL, _LONG, _INT, _BOOL, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


JUDGMENT = _struct(
    violates_policy=_BOOL,
    violated_rules=T.ArrayType(_STR),
    severity=_STR,
    primary_category=_STR,
    evidence_spans=T.ArrayType(_STR),
    suggested_action=_STR,
    confidence=_DBL,
    reasoning=_STR,
)
RULE_SET = _struct(
    slug=_STR,
    name=_STR,
    regime=_STR,
    description=_STR,
    rules=T.ArrayType(_struct(id=_STR, text=_STR)),
    version=_INT,
    created=T.DateType(),
)
CONTENT = _struct(**dict.fromkeys(CONTENT_FIELDS, _STR))
CORPUS_SCORES = _struct(id=_STR, text=_STR, **dict.fromkeys(SCORES, _DBL))
CORPUS_FLAGS = _struct(id=_STR, user_input=_STR, toxicity=_INT, jailbreaking=_INT)
FEATURE_STRUCT = _struct(**dict.fromkeys(FEATURES, _DBL))
INBOX = _struct(
    stream_idx=_LONG,
    bucket=_STR,
    text=_STR,
    hf_id=_STR,
    features=FEATURE_STRUCT,
    sexual_explicit=_DBL,
)
LABELS = _struct(stream_idx=_LONG, judgment=JUDGMENT)
AUDIT_CONTENT = _struct(
    text=_STR,
    regime=_STR,
    source=_STR,
    source_stream_idx=_LONG,
    source_hf_id=_STR,
    source_features=FEATURE_STRUCT,
)
AUDIT_ROW = _struct(
    session_id=_STR,
    timestamp=_TS,
    audited_by=_STR,
    rule_set_slug=_STR,
    content=AUDIT_CONTENT,
    judgment=JUDGMENT,
    dev_mode=_BOOL,
)
APPROVED_ROW = T.StructType(
    [
        *(f for f in AUDIT_ROW.fields if f.name != "content"),
        T.StructField(
            "content", T.StructType([*AUDIT_CONTENT.fields, T.StructField("bucket", _STR)])
        ),
        T.StructField(
            "provenance",
            _struct(initial_author=_STR, reviewed_by=_STR, drafted_at=_TS, reviewed_at=_TS),
        ),
    ]
)
ADVERSARIAL_ROW = T.StructType(
    [
        *(f for f in AUDIT_ROW.fields if f.name != "content"),
        T.StructField(
            "content",
            T.StructType(
                [
                    *AUDIT_CONTENT.fields,
                    T.StructField("prior_context", T.ArrayType(_STR)),
                    T.StructField("rule_set_foil", _STR),
                    T.StructField("edge_tested", _STR),
                ]
            ),
        ),
        T.StructField("expected_classifier_disagreement", _BOOL),
    ]
)
SESSION = _struct(
    session_id=_STR,
    rule_set_slug=_STR,
    target_n=_INT,
    n_completed=_INT,
    cursor=_INT,
    skips_used=_INT,
    seed=_LONG,
    started_at=_TS,
    last_activity_at=_TS,
    ended_at=_TS,
    ended_reason=_STR,
    warned_25min=_BOOL,
    dev_mode=_BOOL,
)
# What may be left out of a JSON document, and what may be null in it, by path.
_FEATURES_NULL = tuple(f"content.source_features.{f}" for f in FEATURES)
CONTENT_OPTIONAL, CONTENT_NULLABLE = ("article_title", "language"), ("article_title",)
AUDIT_OPTIONAL = tuple(f"judgment.{f}" for f in JUDGMENT_DEFAULTED)
AUDIT_NULLABLE = ("content.source_stream_idx", "content.source_hf_id", *_FEATURES_NULL)
ADVERSARIAL_OPTIONAL = (
    *AUDIT_OPTIONAL,
    "content.source_hf_id",
    "content.source_features",
    "content.prior_context",
    "content.rule_set_foil",
    "expected_classifier_disagreement",
)
ADVERSARIAL_NULLABLE = (
    *AUDIT_NULLABLE, "content.source_features", "content.rule_set_foil", "content.prior_context"
)
HELD_OUT = _struct(source_id=_STR)
RATINGS = _struct(
    content_id=_STR, slug=_STR, rater=_STR, violates_policy=_BOOL, confidence=_DBL
)
MESSAGES = _struct(
    ts=_TS,
    user_id=_STR,
    target_id=_STR,
    thread_id=_STR,
    text=_STR,
    is_stop=_BOOL,
    is_promo=_BOOL,
    is_off_topic=_BOOL,
)
