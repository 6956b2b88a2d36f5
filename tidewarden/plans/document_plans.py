"""Nested JSON documents against their contracts: content, audit rows, hand-written test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden import contracts as C
from tidewarden.functions import checks
from tidewarden.operators import validation
from tidewarden.plans import views
from tidewarden.plans.registry import query

_KINDS = {
    T.StringType: "'VARCHAR'",
    T.BooleanType: "'BOOLEAN'",
    T.LongType: "'BIGINT', 'UBIGINT'",
    T.IntegerType: "'BIGINT', 'UBIGINT'",
    T.DoubleType: "'DOUBLE', 'BIGINT', 'UBIGINT'",
}


def shape_sql(kind: T.DataType, optional: Sequence[str], nullable: Sequence[str], path: str = "") -> list[str]:
    """SQL expressions that give the faults in the shape of a document x as lists of words."""
    at = f"$.{path}" if path else "$"
    found = []
    if path:
        if path not in nullable:
            found.append(f"[CASE WHEN json_type(x, '{at}') = 'NULL' THEN '{path}:null' END]")
        if isinstance(kind, (T.TimestampType, T.DateType)):
            bad = f"TRY_CAST(json_extract_string(x, '{at}') AS TIMESTAMP) IS NULL AND json_exists(x, '{at}')"
            bad += f" AND json_type(x, '{at}') <> 'NULL'"
        else:
            right = "'OBJECT'" if isinstance(kind, T.StructType) else "'ARRAY'" if isinstance(kind, T.ArrayType) else _KINDS[type(kind)]
            bad = f"json_type(x, '{at}') NOT IN ({right}, 'NULL')"
        found.append(f"[CASE WHEN {bad} THEN '{path}:type' END]")
    if isinstance(kind, T.ArrayType):
        found.append(
            f"""list_transform(range(CAST(coalesce(json_array_length(x, '{at}'), 0) AS BIGINT)), lambda i:
                   CASE json_type(x, '{at}[' || i || ']') WHEN 'VARCHAR' THEN NULL
                        WHEN 'NULL' THEN '{path}[' || i || ']:null' ELSE '{path}[' || i || ']:type' END)"""
        )
    if isinstance(kind, T.StructType):
        below = f"{path}." if path else ""
        names = ", ".join(f"'{n}'" for n in kind.names)
        known = f"CASE WHEN json_type(x, '{at}') = 'OBJECT' THEN json_keys(x, '{at}') END"
        found.append(
            f"""list_transform(list_filter(coalesce({known}, []), lambda k: k NOT IN ({names})),
                               lambda k: '{below}' || k || ':extra')"""
        )
        for f in kind.fields:
            if below + f.name not in optional:
                found.append(
                    f"""[CASE WHEN json_type(x, '{at}') = 'OBJECT' AND NOT json_exists(x, '{at}.{f.name}')
                              THEN '{below}{f.name}:missing' END]"""
                )
            found += shape_sql(f.dataType, optional, nullable, below + f.name)
    return found


def _words(parts: list[str]) -> str:
    """Words of several lists, sorted, in one text."""
    joined = "flatten([" + ", ".join(f"CAST({p} AS VARCHAR[])" for p in parts) + "])"
    return f"array_to_string(list_sort(list_filter({joined}, lambda w: w IS NOT NULL)), ',')"


def _errors_sql(lines: str, shape: list[str], values: list[str]) -> str:
    own = _words([f"[CASE WHEN {broken} THEN '{word}' END]" for word, broken in values])
    return f"""
        SELECT doc_id, CASE WHEN NOT valid THEN ':malformed' WHEN shape <> '' THEN shape
                            ELSE vals END AS errors
        FROM (SELECT doc_id, valid, {_words(shape)} AS shape, {own} AS vals
              FROM (SELECT doc_id, json_valid(line) AS valid,
                           CASE WHEN json_valid(line) THEN line ELSE '{{}}' END AS x
                    FROM (SELECT doc_id, {lines} AS line
                          FROM (SELECT *, coalesce(text, '') AS body FROM documents))))"""


def _string(path: str) -> str:
    return f"json_extract_string(x, '$.{path}')"


def _text_faults(path: str) -> list[tuple[str, str]]:
    return [
        (f"{path}:too_short", f"length({_string(path)}) < 1"),
        (f"{path}:too_long", f"length({_string(path)}) > 4000"),
    ]


_QUOTED = {
    "SQL": "CAST(to_json(body) AS VARCHAR)",
    "Spark": "substring(to_json(named_struct('t', body)), 6, length(to_json(named_struct('t', body))) - 6)",
}


def _content_line(engine: str) -> str:
    """A content document; the remainder by nine says what is odd about it."""
    return f"""
        '{{"text":' || CASE WHEN doc_id % 9 = 4 THEN '17' ELSE {_QUOTED[engine]} END
        || CASE WHEN doc_id % 9 = 2 THEN ''
                WHEN length(body) < 150 THEN ',"regime":"chat"' ELSE ',"regime":"comment"' END
        || CASE doc_id % 9 WHEN 0 THEN ',"article_title":"On lines"' WHEN 1 THEN ',"language":"de"'
                WHEN 3 THEN ',"article_title":"On lines","note":1,"more":null'
                WHEN 5 THEN ',"article_title":null' WHEN 6 THEN ',"language":null'
                WHEN 8 THEN ',"article_title":"","language":["en"]' ELSE '' END
        || CASE WHEN doc_id % 9 = 7 THEN '' ELSE '}}' END"""


_CONTENT_VALUES = [
    *_text_faults("text"),
    ("regime:enum", f"{_string('regime')} NOT IN ('chat', 'comment')"),
    ("article_title:title_length", f"NOT length({_string('article_title')}) BETWEEN 1 AND 300"),
    ("article_title:title_required", f"{_string('regime')} = 'comment' AND {_string('article_title')} IS NULL"),
    ("article_title:title_forbidden", f"{_string('regime')} = 'chat' AND {_string('article_title')} IS NOT NULL"),
]


def _judgment(odd: str) -> str:
    """The judgment of a row; `odd` is a number that says what is wrong with it."""
    return f"""
        '{{"violates_policy":' || CASE WHEN {odd} = 1 THEN '"yes"' ELSE 'true' END
        || CASE WHEN {odd} = 2 THEN '' ELSE ',"violated_rules":["R1"'
             || CASE WHEN {odd} = 3 THEN ',7,null' WHEN {odd} = 4 THEN ',"R1"' ELSE '' END || ']' END
        || ',"severity":"' || CASE WHEN {odd} = 5 THEN 'HIGH' ELSE 'low' END
        || '","primary_category":"other","evidence_spans":[],"suggested_action":"warn"'
        || CASE WHEN {odd} = 6 THEN '' WHEN {odd} = 7 THEN ',"confidence":1.5' ELSE ',"confidence":0.5' END
        || ',"reasoning":' || CASE WHEN {odd} = 8 THEN 'null' ELSE '"as the rule says"' END || '}}'"""


_JUDGMENT_VALUES = [
    ("judgment.violated_rules:duplicate", "json_extract_string(x, '$.judgment.violated_rules[0]') = json_extract_string(x, '$.judgment.violated_rules[1]')"),
    ("judgment.severity:enum", f"{_string('judgment.severity')} NOT IN ('low', 'moderate', 'high', 'critical')"),
    ("judgment.confidence:range", "NOT CAST(json_extract_string(x, '$.judgment.confidence') AS DOUBLE) BETWEEN 0 AND 1"),
]


def _features(odd: str) -> str:
    return f"""
        '{{"toxicity":0.25,"threat":0,"obscene":null,"insult":1e-3,"identity_attack":0.5'
        || CASE WHEN {odd} = 1 THEN ',"severe_toxicity":"high"' WHEN {odd} = 2 THEN ''
                ELSE ',"severe_toxicity":0.0625' END
        || CASE WHEN {odd} = 3 THEN ',"kindness":1' ELSE '' END || '}}'"""


def _row_line(engine: str, head: str, content: str, tail: str) -> str:
    return f"""
        '{{"session_id":"s1","timestamp":'
        || CASE WHEN doc_id % 17 = 5 THEN '"in May"' WHEN doc_id % 17 = 6 THEN '1779000000'
                ELSE '"2026-05-21T10:00:00Z"' END
        || {head} || ',"rule_set_slug":"arena_chat","content":'
        || CASE WHEN doc_id % 17 = 7 THEN '"gone"' ELSE '{{"text":' || {_QUOTED[engine]}
             || ',"regime":"chat"' || {content} || '}}' END
        || ',"judgment":' || {_judgment('doc_id % 11')} || {tail}
        || CASE WHEN doc_id % 17 = 8 THEN '' ELSE ',"dev_mode":false' END || '}}'"""


def _audit_line(engine: str) -> str:
    string = "VARCHAR" if engine == "SQL" else "STRING"
    content = f"""',"source":"corpus","source_stream_idx":'
        || CASE doc_id % 7 WHEN 1 THEN 'null' WHEN 2 THEN '1.5' ELSE CAST(doc_id AS {string}) END
        || ',"source_hf_id":' || CASE WHEN doc_id % 7 = 3 THEN 'null' ELSE '"h"' END
        || CASE WHEN doc_id % 7 = 4 THEN '' ELSE ',"source_features":' || {_features('doc_id % 5')} END"""
    return _row_line(engine, """',"audited_by":"human"'""", content, "''")


def _adversarial_line(engine: str) -> str:
    head = """CASE doc_id % 13 WHEN 1 THEN ',"audited_by":"human"' WHEN 2 THEN ''
                   ELSE ',"audited_by":"adversarial"' END"""
    content = """',"source":"' || CASE WHEN doc_id % 13 = 3 THEN 'corpus' ELSE 'handcrafted' END
        || '","source_stream_idx":' || CASE WHEN doc_id % 13 = 4 THEN '9' ELSE 'null' END
        || CASE doc_id % 6 WHEN 1 THEN ',"prior_context":["hi",3,"you there?",null,{"a":1}]'
                WHEN 2 THEN ',"prior_context":["hi"]' WHEN 3 THEN ',"prior_context":"hi"'
                WHEN 4 THEN ',"prior_context":null' ELSE '' END
        || CASE doc_id % 5 WHEN 1 THEN ',"rule_set_foil":"arena_chat"'
                WHEN 2 THEN ',"rule_set_foil":"study_hub"' ELSE '' END
        || CASE doc_id % 13 WHEN 5 THEN '' WHEN 6 THEN ',"edge_tested":"banter"'
                ELSE ',"edge_tested":"R1:banter"' END"""
    tail = """CASE doc_id % 4 WHEN 1 THEN ',"expected_classifier_disagreement":true'
                   WHEN 2 THEN ',"expected_classifier_disagreement":"maybe"' ELSE '' END"""
    return _row_line(engine, head, content, tail)


_ROW_VALUES = [*_text_faults("content.text"), *_JUDGMENT_VALUES]
_OWN_VALUES = [
    ("audited_by:enum", f"{_string('audited_by')} <> 'adversarial'"),
    ("content.source:enum", f"{_string('content.source')} <> 'handcrafted'"),
    ("content.source_stream_idx:forbidden", "json_type(x, '$.content.source_stream_idx') <> 'NULL'"),
    ("content.edge_tested:pattern", f"NOT regexp_matches({_string('content.edge_tested')}, '^R[0-9]{{1,3}}:[^ ]')"),
    ("content.rule_set_foil:same", f"{_string('content.rule_set_foil')} = {_string('rule_set_slug')}"),
]


def _lines(spark, d, line: str) -> DataFrame:
    docs = views.table(spark, d, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.expr(line).alias("line"))


def _shown(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", checks.error_text(F.col("errors")).alias("errors"))


@query(
    "content_documents",
    _errors_sql(
        _content_line("SQL"),
        shape_sql(C.CONTENT, C.CONTENT_OPTIONAL, C.CONTENT_NULLABLE),
        _CONTENT_VALUES,
    ),
)
def _(spark, d):
    return _shown(validation.parse_content(_lines(spark, d, _content_line("Spark")), "line"))


@query(
    "audit_documents",
    _errors_sql(
        _audit_line("SQL"), shape_sql(C.AUDIT_ROW, C.AUDIT_OPTIONAL, C.AUDIT_NULLABLE), _ROW_VALUES
    ),
)
def _(spark, d):
    return _shown(validation.parse_audit_row(_lines(spark, d, _audit_line("Spark")), "line"))


@query(
    "adversarial_documents",
    _errors_sql(
        _adversarial_line("SQL"),
        shape_sql(C.ADVERSARIAL_ROW, C.ADVERSARIAL_OPTIONAL, C.ADVERSARIAL_NULLABLE),
        [*_ROW_VALUES, *_OWN_VALUES],
    ),
)
def _(spark, d):
    return _shown(validation.parse_adversarial_row(_lines(spark, d, _adversarial_line("Spark")), "line"))
