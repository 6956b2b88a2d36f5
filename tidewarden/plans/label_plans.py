"""Contract checks, normalisers, label joins, pairing and derived labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import checks, scores, text
from tidewarden.operators import labels, ordering, profile, sampling, validation
from tidewarden.plans import views
from tidewarden.plans.corpus_plans import inbox
from tidewarden.plans.registry import query
from tidewarden.sources import rule_sets as rule_set_files

RULE_ID = r"R\p{Nd}{1,3}"
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _joined(cases: str, sort: bool = True) -> str:
    words = f"list_filter([{cases}], lambda x: x IS NOT NULL)"
    return f"array_to_string({f'list_sort({words})' if sort else words}, ',')"


JUDGMENT_CASES = f"""
    CASE WHEN violates_policy IS NULL THEN 'violates_policy:missing' END,
    CASE WHEN violated_rules IS NULL THEN 'violated_rules:missing' END,
    CASE WHEN len(violated_rules) > 10 THEN 'violated_rules:too_many' END,
    CASE WHEN len(list_filter(violated_rules,
              lambda r: NOT regexp_full_match(r, '{RULE_ID}'))) > 0
         THEN 'violated_rules:pattern' END,
    CASE WHEN len(violated_rules) <= 10
          AND len(list_filter(violated_rules,
              lambda r: NOT regexp_full_match(r, '{RULE_ID}'))) = 0
          AND len(list_distinct(violated_rules)) < len(violated_rules)
         THEN 'violated_rules:duplicate' END,
    CASE WHEN severity IS NULL THEN 'severity:missing' END,
    CASE WHEN severity NOT IN ('low', 'moderate', 'high', 'critical') THEN 'severity:enum' END,
    CASE WHEN primary_category IS NULL THEN 'primary_category:missing' END,
    CASE WHEN primary_category NOT IN ('harassment', 'hate_speech', 'sexual', 'violence', 'spam',
              'self_harm', 'other', 'none') THEN 'primary_category:enum' END,
    CASE WHEN evidence_spans IS NULL THEN 'evidence_spans:missing' END,
    CASE WHEN len(evidence_spans) > 5 THEN 'evidence_spans:too_many' END,
    CASE WHEN len(list_filter(evidence_spans,
              lambda s: NOT length(s) BETWEEN 1 AND 300)) > 0
         THEN 'evidence_spans:span_length' END,
    CASE WHEN suggested_action IS NULL THEN 'suggested_action:missing' END,
    CASE WHEN suggested_action NOT IN ('no_action', 'warn', 'hide', 'remove', 'escalate', 'ban')
         THEN 'suggested_action:enum' END,
    CASE WHEN confidence IS NULL THEN 'confidence:missing' END,
    CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence:range' END,
    CASE WHEN reasoning IS NULL THEN 'reasoning:missing' END,
    CASE WHEN length(reasoning) < 1 THEN 'reasoning:too_short' END,
    CASE WHEN length(reasoning) > 400 THEN 'reasoning:too_long' END"""
JUDGMENT_ERRORS = _joined(JUDGMENT_CASES)


def checked(spark, d):
    return validation.validate_judgment(views.judged(spark, d))


@query(
    "validate_judgment", f"SELECT doc_id, {JUDGMENT_ERRORS} AS errors FROM judged", "judged"
)
def _(spark, d):
    return checked(spark, d).select("doc_id", checks.error_text(F.col("errors")).alias("errors"))


@query(
    "failing_fields",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(
               string_split({JUDGMENT_ERRORS}, ','), lambda e: split_part(e, ':', 1)))), ',')
               AS fields
        FROM judged""",
    "judged",
)
def _(spark, d):
    return checked(spark, d).select(
        "doc_id", F.array_join(checks.failing_fields(F.col("errors")), ",").alias("fields")
    )


@query(
    "split_valid",
    f"""SELECT doc_id, CASE WHEN {JUDGMENT_ERRORS} = '' THEN 'valid' ELSE 'quarantine' END AS part
        FROM judged""",
    "judged",
)
def _(spark, d):
    valid, quarantine = validation.split_valid(checked(spark, d))
    return valid.select("doc_id", F.lit("valid").alias("part")).unionByName(
        quarantine.select("doc_id", F.lit("quarantine").alias("part"))
    )


@query(
    "error_report",
    f"""SELECT split_part(e, ':', 1) AS loc, split_part(e, ':', 2) AS type, count(*) AS n_rows
        FROM (SELECT unnest(string_split({JUDGMENT_ERRORS}, ',')) AS e FROM judged)
        WHERE e <> '' GROUP BY ALL""",
    "judged",
)
def _(spark, d):
    return validation.error_report(checked(spark, d))


@query(
    "rule_id_uniqueness",
    """SELECT doc_id, len(list_distinct(violated_rules)) < len(violated_rules) AS repeated
       FROM judged WHERE violated_rules IS NOT NULL""",
    "judged",
)
def _(spark, d):
    ids = F.col("judgment.violated_rules")
    return (
        views.judged(spark, d)
        .where(ids.isNotNull())
        .select("doc_id", (F.size(F.array_distinct(ids)) < F.size(ids)).alias("repeated"))
    )


# Every document read as a content row; the title stands for the article of a comment.
_CONTENT_ERRORS = _joined(
    """
    CASE WHEN length(text) < 1 THEN 'text:too_short' END,
    CASE WHEN length(text) > 4000 THEN 'text:too_long' END,
    CASE WHEN regime NOT IN ('chat', 'comment') THEN 'regime:enum' END,
    CASE WHEN regime = 'comment' AND title IS NULL THEN 'article_title:title_required' END,
    CASE WHEN regime = 'chat' AND title IS NOT NULL THEN 'article_title:title_forbidden' END,
    CASE WHEN NOT length(title) BETWEEN 1 AND 300 THEN 'article_title:title_length' END"""
)


_CONTENT_CHECKED = f"""
    SELECT doc_id, {_CONTENT_ERRORS} AS errors
    FROM (SELECT doc_id, text,
                 CASE WHEN length(text) < 150 THEN 'chat' WHEN lang = 'zh' THEN 'hybrid'
                      ELSE 'comment' END AS regime,
                 CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN '' END AS title
          FROM documents)"""


def _content_rows(spark, d):
    regime = (
        F.when(F.length("text") < 150, "chat")
        .when(F.col("lang") == "zh", "hybrid")
        .otherwise("comment")
    )
    title = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", "")
    return views.table(spark, d, "documents").select(
        "doc_id",
        F.struct(
            "text",
            regime.alias("regime"),
            title.alias("article_title"),
            F.col("lang").alias("language"),
        ).alias("content"),
    )


@query("validate_content", _CONTENT_CHECKED)
def _(spark, d):
    return validation.validate_content(_content_rows(spark, d)).select(
        "doc_id", checks.error_text(F.col("errors")).alias("errors")
    )


# Every document read as a rule set: its lines are the rules.
_SETS = """
    SELECT doc_id, source || '.yaml' AS file_name,
           CASE WHEN doc_id % 6 = 0 THEN upper(source) ELSE source END AS slug,
           CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Rules of ' || source END AS name,
           CASE lang WHEN 'en' THEN 'chat' WHEN 'de' THEN 'comment' WHEN 'fr' THEN 'hybrid'
                     ELSE lang END AS regime,
           text AS description, string_split(text, chr(10)) AS lines,
           doc_id % 5 AS clash
    FROM documents"""
_SET_ERRORS = _joined(
    """
    CASE WHEN NOT regexp_full_match(slug, '[a-z0-9_]+') THEN 'slug:pattern' END,
    CASE WHEN length(slug) > 64 THEN 'slug:too_long' END,
    CASE WHEN length(name) < 1 THEN 'name:too_short' END,
    CASE WHEN length(name) > 120 THEN 'name:too_long' END,
    CASE WHEN regime NOT IN ('chat', 'comment', 'hybrid') THEN 'regime:enum' END,
    CASE WHEN length(description) < 20 THEN 'description:too_short' END,
    CASE WHEN length(description) > 500 THEN 'description:too_long' END,
    CASE WHEN len(lines) < 3 THEN 'rules:too_few' END,
    CASE WHEN len(lines) > 20 THEN 'rules:too_many' END,
    CASE WHEN len(lines) > 999 THEN 'rules:pattern' END,
    CASE WHEN len(list_filter(lines, lambda s: NOT length(s) BETWEEN 1 AND 300)) > 0
         THEN 'rules:text_length' END,
    CASE WHEN clash = 0 AND len(lines) > 1 THEN 'rules:duplicate' END"""
)


def _rule_set_rows(spark, d):
    source, doc = F.col("source"), F.col("doc_id")
    rules = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.concat(F.lit("R"), F.when((doc % 5 == 0) & (i == 1), 1).otherwise(i + 1)).alias("id"),
            line.alias("text"),
        ),
    )
    regime = (
        F.when(F.col("lang") == "en", "chat")
        .when(F.col("lang") == "de", "comment")
        .when(F.col("lang") == "fr", "hybrid")
        .otherwise(F.col("lang"))
    )
    rule_set = F.struct(
        F.when(doc % 6 == 0, F.upper(source)).otherwise(source).alias("slug"),
        F.when(doc % 7 == 0, "").otherwise(F.concat(F.lit("Rules of "), source)).alias("name"),
        regime.alias("regime"),
        F.col("text").alias("description"),
        rules.alias("rules"),
        F.lit(1).alias("version"),
        F.lit("2026-01-05").cast("date").alias("created"),
    )
    return views.table(spark, d, "documents").select(
        "doc_id", F.concat(source, F.lit(".yaml")).alias("file_name"), rule_set.alias("rule_set")
    )


@query("validate_rule_set", f"SELECT doc_id, {_SET_ERRORS} AS errors FROM ({_SETS})")
def _(spark, d):
    return validation.validate_rule_set(_rule_set_rows(spark, d)).select(
        "doc_id", checks.error_text(F.col("errors")).alias("errors")
    )


@query(
    "check_slug_matches_file",
    f"""SELECT doc_id, CASE WHEN slug || '.yaml' <> file_name THEN 'slug:file_mismatch' ELSE ''
               END AS errors
        FROM ({_SETS})""",
)
def _(spark, d):
    rows = validation.check_slug_matches_file(
        _rule_set_rows(spark, d), "rule_set.slug", "file_name"
    )
    return rows.select("doc_id", checks.error_text(F.col("errors")).alias("errors"))


@query(
    "catalog_report",
    f"""SELECT doc_id, file_name, regime, CAST(len(lines) AS INTEGER) AS n_rules,
               CASE WHEN {_SET_ERRORS} = '' AND slug || '.yaml' = file_name THEN 'OK'
                    ELSE 'FAIL' END AS outcome
        FROM ({_SETS})""",
)
def _(spark, d):
    documents = _rule_set_rows(spark, d).select(
        "doc_id", "file_name", F.to_json("rule_set").alias("document")
    )
    return profile.catalog_report(rule_set_files.rule_sets_from_json(documents))


# Pieces of a judgment as JSON text; both engines read them. The kind of fault goes by doc_id.
_JSON_PIECES = (
    """ '{"violates_policy":' || CASE WHEN doc_id % 12 = 4 THEN '1' ELSE 'false' END """,
    """ CASE WHEN doc_id % 12 = 6 THEN '' WHEN doc_id % 12 = 9 THEN ',"violated_rules":[1,2]'
             ELSE ',"violated_rules":["R1","R' || CAST(doc_id % 3 + 1 AS {string}) || '"]' END """,
    """ CASE WHEN doc_id % 12 = 10 THEN ',"severity":"HIGH"' ELSE ',"severity":"low"' END """,
    """ CASE WHEN doc_id % 12 = 2 THEN ',"note":1' ELSE '' END """,
    """ ',"primary_category":"none","suggested_action":"no_action"' """,
    """ CASE WHEN doc_id % 12 = 5 THEN ',"evidence_spans":null' ELSE ',"evidence_spans":[]' END """,
    """ CASE WHEN doc_id % 12 = 1 THEN '' WHEN doc_id % 12 = 3 THEN ',"confidence":"0.5"'
             ELSE ',"confidence":0.' || CAST(doc_id % 90 + 10 AS {string}) END """,
    """ ',"reasoning":' || CASE WHEN doc_id % 12 = 7 THEN '5' ELSE {quoted} END """,
    """ CASE WHEN doc_id % 12 = 8 THEN '' ELSE '}}' END """,
)


def _json_line(string: str, quoted: str) -> str:
    pieces = " || ".join(
        p.replace("{string}", string).replace("{quoted}", quoted).replace("}}", "}")
        for p in _JSON_PIECES
    )
    return f"CASE WHEN doc_id % 12 = 11 THEN '[1]' ELSE {pieces} END"


def json_labels(docs):
    """A judgment per document as JSON text, most of them faulty in one way or another."""
    wrapped = "to_json(named_struct('t', text))"  # {"t":"..."}
    quoted = f"substring({wrapped}, 6, length({wrapped}) - 6)"
    return docs.select("doc_id", F.expr(_json_line("STRING", quoted)).alias("line"))


_JSON_SQL = f"""
    SELECT doc_id, {_json_line('VARCHAR', 'CAST(to_json(text) AS VARCHAR)')} AS line
    FROM documents"""
# What is wrong with each kind of line above; the other checks see well-typed lines only.
_SHAPE = _joined(
    """
    CASE WHEN json_exists(x, '$.note') THEN 'note:extra' END,
    CASE WHEN NOT json_exists(x, '$.confidence') THEN 'confidence:missing' END,
    CASE WHEN json_type(x, '$.violates_policy') <> 'BOOLEAN' THEN 'violates_policy:type' END,
    CASE WHEN json_type(x, '$.violated_rules[0]') <> 'VARCHAR' THEN 'violated_rules:type' END,
    CASE WHEN json_type(x, '$.evidence_spans') <> 'ARRAY' THEN 'evidence_spans:type' END,
    CASE WHEN json_type(x, '$.confidence') = 'VARCHAR' THEN 'confidence:type' END,
    CASE WHEN json_type(x, '$.reasoning') <> 'VARCHAR' THEN 'reasoning:type' END"""
)
_VALUES = _joined(
    """
    CASE WHEN json_extract_string(x, '$.severity') = 'HIGH' THEN 'severity:enum' END,
    CASE WHEN json_extract_string(x, '$.violated_rules[0]')
            = json_extract_string(x, '$.violated_rules[1]') THEN 'violated_rules:duplicate' END,
    CASE WHEN length(json_extract_string(x, '$.reasoning')) < 1 THEN 'reasoning:too_short' END,
    CASE WHEN length(json_extract_string(x, '$.reasoning')) > 400 THEN 'reasoning:too_long' END"""
)
JSON_ERRORS_SQL = f"""
    SELECT doc_id, CASE WHEN json_type(x) <> 'OBJECT' THEN ':malformed'
                        WHEN shape <> '' THEN shape ELSE vals END AS errors
    FROM (SELECT doc_id, x, {_SHAPE} AS shape, {_VALUES} AS vals
          FROM (SELECT doc_id, CASE WHEN json_valid(line) THEN line ELSE 'null' END AS x
                FROM ({_JSON_SQL})))"""


@query("parse_judgment", JSON_ERRORS_SQL)
def _(spark, d):
    lines = json_labels(views.table(spark, d, "documents"))
    return validation.parse_judgment(lines, "line").select(
        "doc_id", checks.error_text(F.col("errors")).alias("errors")
    )


@query(
    "parse_judgment_lax",
    f"""SELECT doc_id, CASE WHEN doc_id % 12 IN (3, 4) AND errors LIKE '%:type' THEN
               CASE WHEN length(text) > 400 AND doc_id % 3 = 0 THEN
                         'reasoning:too_long,violated_rules:duplicate'
                    WHEN length(text) > 400 THEN 'reasoning:too_long'
                    WHEN doc_id % 3 = 0 THEN 'violated_rules:duplicate' ELSE '' END
               ELSE errors END AS errors
        FROM ({JSON_ERRORS_SQL}) JOIN documents USING (doc_id)""",
)
def _(spark, d):
    lines = json_labels(views.table(spark, d, "documents"))
    return validation.parse_judgment(lines, "line", lax=True).select(
        "doc_id", checks.error_text(F.col("errors")).alias("errors")
    )


# Three documents make a content file; one invalid document holds back its file.
@query(
    "gate_all_or_nothing",
    f"""SELECT doc_id, doc_id // 3 AS file_no FROM documents
        WHERE doc_id // 3 NOT IN (SELECT doc_id // 3 FROM ({_CONTENT_CHECKED}) WHERE errors <> '')""",
)
def _(spark, d):
    files = validation.validate_content(_content_rows(spark, d))
    files = files.select("doc_id", "errors", F.expr("doc_id div 3").alias("file_no"))
    return validation.gate_each(files, ["file_no"])


@query(
    "gate_report",
    f"""SELECT file_no, n_rows, n_failing, n_failing = 0 AS passes,
               coalesce(failures, '') AS failures
        FROM (SELECT doc_id // 3 AS file_no, count(*) AS n_rows,
                     count(*) FILTER (WHERE errors <> '') AS n_failing
              FROM ({_CONTENT_CHECKED}) GROUP BY 1)
        LEFT JOIN (SELECT file_no, string_agg(e || ':' || n, ',' ORDER BY e || ':' || n) AS failures
                   FROM (SELECT file_no, e, count(*) AS n
                         FROM (SELECT doc_id // 3 AS file_no,
                                      unnest(string_split(errors, ',')) AS e
                               FROM ({_CONTENT_CHECKED}))
                         WHERE e <> '' GROUP BY ALL) GROUP BY 1) USING (file_no)""",
)
def _(spark, d):
    files = validation.validate_content(_content_rows(spark, d))
    files = files.select("doc_id", "errors", F.expr("doc_id div 3").alias("file_no"))
    return validation.gate_report(files, ["file_no"])


@query(
    "forbid_extra",
    f"""SELECT doc_id, CASE WHEN doc_id % 12 = 2 THEN 'note' ELSE '' END AS extra FROM ({_JSON_SQL})
        WHERE json_valid(line) AND line <> '[1]'""",
)
def _(spark, d):
    lines = json_labels(views.table(spark, d, "documents"))
    keyed = lines.withColumn("keys", F.json_object_keys("line")).where(F.col("keys").isNotNull())
    extra = checks.extra_keys(F.col("keys"), C.JUDGMENT_FIELDS)
    return keyed.select("doc_id", F.array_join(extra, ",").alias("extra"))


@query(
    "required_fields",
    f"""SELECT doc_id, CASE WHEN json_exists(line, '$.confidence') THEN '' ELSE 'confidence' END
               AS missing
        FROM ({_JSON_SQL}) WHERE json_valid(line) AND line <> '[1]'""",
)
def _(spark, d):
    lines = json_labels(views.table(spark, d, "documents"))
    keyed = lines.withColumn("keys", F.json_object_keys("line")).where(F.col("keys").isNotNull())
    missing = checks.missing_keys(F.col("keys"), C.JUDGMENT_REQUIRED)
    return keyed.select("doc_id", F.array_join(missing, ",").alias("missing"))


@query(
    "check_rule_membership",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(violated_rules,
                  lambda r: NOT list_contains(k.ids, r)))), ',') AS unknown
       FROM judged JOIN (SELECT slug, list(rule_id) AS ids FROM rules GROUP BY slug) k USING (slug)
       WHERE violated_rules IS NOT NULL""",
    "judged rules",
)
def _(spark, d):
    rows = views.judged(spark, d).select(
        "doc_id", "slug", F.col("judgment.violated_rules").alias("violated_rules")
    )
    judged = rows.where(F.col("violated_rules").isNotNull())
    found = validation.check_rule_membership(judged, "slug", "violated_rules", views.rules(spark))
    return found.select(
        "doc_id", F.array_join(F.array_sort("unknown_rules"), ",").alias("unknown")
    )


@query(
    "check_source_row",
    """SELECT page_id, CASE WHEN TRY_CAST(split_part(url, '/', 4) AS DOUBLE) IS NULL
                            THEN 'flag:not_a_number' ELSE '' END AS errors
       FROM pages""",
)
def _(spark, d):
    pages = views.table(spark, d, "pages").withColumn(
        "flag", F.split_part("url", F.lit("/"), F.lit(4))
    )
    return validation.check_source_row(pages, "html", ["flag"]).select(
        "page_id", checks.error_text(F.col("errors")).alias("errors")
    )


@query(
    "warn_short",
    """SELECT count(*) AS found, CAST(100 AS BIGINT) AS wanted, count(*) < 100 AS short
       FROM stream WHERE stream_idx < 200 AND length(text) BETWEEN 5 AND 1000""",
    "stream",
)
def _(spark, d):
    candidates = sampling.uniform_candidates(
        views.corpus(spark, d), "doc_id", C.SAMPLE_SEED, "comment"
    )
    return validation.warn_short(candidates, 100)


@query(
    "check_unique",
    """SELECT sha256(text) AS text_hash, count(*) AS n_rows FROM documents
       GROUP BY text HAVING count(*) > 1""",
)
def _(spark, d):
    hashed = views.table(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash"))
    return validation.check_unique(hashed, ["text_hash"])


# --- normalisers: answers are made from the tables, one kind of answer per row ---


def _answers(spark, d, *answers):
    doc = F.col("doc_id")
    chain = F.lit(None).cast("string")
    for i, answer in enumerate(answers):
        chain = F.when(doc % (len(answers) + 1) == i, answer).otherwise(chain)
    return views.table(spark, d, "documents").withColumn("answer", chain)


@query(
    "normalise_flag",
    """SELECT doc_id, CASE WHEN doc_id % 10 < 4 THEN 'true' WHEN doc_id % 10 < 7 THEN 'false' END
              AS flag
       FROM documents""",
)
def _(spark, d):
    words = [" Yes\t", "y", "TRUE", " 1", "no ", "N", "0", "maybe", ""]
    rows = _answers(spark, d, *[F.lit(w) for w in words])
    return rows.select("doc_id", text.normalise_flag(F.col("answer")).cast("string").alias("flag"))


@query(
    "normalise_enum",
    """SELECT doc_id, CASE WHEN n BETWEEN 1 AND 4 AND kind IN (0, 1)
                             THEN ['low', 'moderate', 'high', 'critical'][n]
                           WHEN kind = 2 THEN 'critical' END AS severity
       FROM (SELECT doc_id, doc_id % 5 AS kind, doc_id % 7 AS n FROM documents)""",
)
def _(spark, d):
    n = (F.col("doc_id") % 7).cast("string")
    padded, negative = F.concat(F.lit(" 0"), n, F.lit("\n")), F.concat(F.lit("-"), n)
    rows = _answers(spark, d, n, padded, F.lit(" Critical"), negative)
    severity = text.normalise_enum(F.col("answer"), C.SEVERITIES)
    return rows.select("doc_id", severity.alias("severity"))


@query(
    "normalise_rule_list",
    """SELECT doc_id,
              CASE WHEN a = b THEN NULL WHEN greatest(a, b) > 8 THEN NULL
                   ELSE 'R' || a || ',R' || b END AS rules,
              CASE WHEN greatest(a, b) > 8 THEN 'unknown' WHEN a = b THEN 'duplicate' END AS error
       FROM (SELECT doc_id, doc_id % 10 + 1 AS a, doc_id % 3 + 1 AS b FROM documents)""",
)
def _(spark, d):
    a, b = ((F.col("doc_id") % n + 1).cast("string") for n in (10, 3))
    answer = F.concat(F.lit(" R"), a, F.lit(",, R"), b, F.lit(" ,"))
    known = F.array(*[F.lit(f"R{i}") for i in range(1, 9)])
    parsed = text.normalise_rule_list(answer, known)
    return views.table(spark, d, "documents").select(
        "doc_id", F.array_join(parsed["value"], ",").alias("rules"), parsed["error"].alias("error")
    )


@query(
    "normalise_spans",
    f"""SELECT doc_id, CASE WHEN too_long THEN NULL ELSE array_to_string(spans, '|') END AS spans,
               CASE WHEN too_long THEN 'too_long' END AS error
        FROM (SELECT doc_id, spans,
                     len(list_filter(spans, lambda s: length(s) > 300)) > 0 AS too_long
              FROM (SELECT doc_id, list_slice(clean, 1, least(5, CASE
                               WHEN list_position(clean, '') IS NULL
                                 OR list_position(clean, '') = 0 THEN len(clean)
                               ELSE list_position(clean, '') - 1 END)) AS spans
                    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)),
                                 lambda s: {strip_sql('s')}) AS clean FROM documents)))""",
)
def _(spark, d):
    parsed = text.normalise_spans(F.split("text", "\n"))
    return views.table(spark, d, "documents").select(
        "doc_id", F.array_join(parsed["value"], "|").alias("spans"), parsed["error"].alias("error")
    )


@query(
    "normalise_confidence",
    """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN CAST(doc_id % 1000 AS DOUBLE) / 1000
                                      WHEN 1 THEN 0.5 WHEN 2 THEN 0.1 WHEN 3 THEN 1.0 END
                      AS confidence
       FROM documents""",
)
def _(spark, d):
    three = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    rows = _answers(
        spark,
        d,
        F.concat(F.lit(" 0."), three),
        *[F.lit(x) for x in (".5", "1e-1", " 1.0\n", "1.001", "nan", "0.5d", "half")],
    )
    return rows.select("doc_id", text.normalise_confidence(F.col("answer")).alias("confidence"))


@query(
    "normalise_reasoning",
    f"""SELECT doc_id, CASE WHEN length({strip_sql('text')}) BETWEEN 1 AND 400
                            THEN {strip_sql('text')} END AS reasoning
        FROM documents""",
)
def _(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", text.normalise_reasoning(F.col("text")).alias("reasoning")
    )


# --- label joins ---

# Labels of the documents that people labelled, keyed like the inbox by stream position.
_STREAM_LABELS = """
    SELECT s.stream_idx, j.* FROM stream s JOIN judged j USING (doc_id)
    WHERE j.violates_policy IS NOT NULL"""


def _stream(spark, d):
    """The whole corpus with its places in the seeded order."""
    seen = ordering.stream(views.corpus(spark, d), None, "doc_id", C.SAMPLE_SEED)
    return seen.withColumn("bucket", scores.bucket())


def _stream_labels(spark, d):
    judged = views.judged(spark, d).where(F.col("judgment.violates_policy").isNotNull())
    places = _stream(spark, d).select("stream_idx", "doc_id")
    return places.join(judged, "doc_id").select("stream_idx", "judgment")


@query(
    "attach_labels",
    f"""SELECT i.stream_idx, i.bucket, l.violates_policy, l.confidence
        FROM inbox i JOIN ({_STREAM_LABELS}) l ON i.stream_idx = l.stream_idx""",
    "inbox judged",
)
def _(spark, d):
    return labels.attach_labels(inbox(spark, d), _stream_labels(spark, d)).select(
        "stream_idx", "bucket", "judgment.violates_policy", "judgment.confidence"
    )


@query(
    "unlabelled",
    f"""SELECT stream_idx, bucket FROM inbox
        WHERE stream_idx NOT IN (SELECT stream_idx FROM ({_STREAM_LABELS}))""",
    "inbox judged",
)
def _(spark, d):
    return labels.unlabelled(inbox(spark, d), _stream_labels(spark, d)).select(
        "stream_idx", "bucket"
    )


@query(
    "orphan_labels",
    f"""SELECT stream_idx FROM ({_STREAM_LABELS})
        WHERE stream_idx NOT IN (SELECT stream_idx FROM inbox)""",
    "inbox judged",
)
def _(spark, d):
    return labels.orphan_labels(inbox(spark, d), _stream_labels(spark, d)).select("stream_idx")


@query(
    "label_mismatches",
    f"""SELECT coalesce(i.stream_idx, l.stream_idx) AS stream_idx,
               CASE WHEN l.stream_idx IS NULL THEN 'unlabelled' ELSE 'orphan_label' END AS problem
        FROM inbox i FULL JOIN ({_STREAM_LABELS}) l ON i.stream_idx = l.stream_idx
        WHERE i.stream_idx IS NULL OR l.stream_idx IS NULL""",
    "inbox judged",
)
def _(spark, d):
    return labels.label_mismatches(inbox(spark, d), _stream_labels(spark, d))


def _audit(spark, d):
    rows = (
        _stream(spark, d)
        .withColumn("hf_id", F.col("doc_id").cast("string"))
        .join(views.judged(spark, d), "doc_id")
        .join(views.rule_sets(spark), "slug")
    )
    return labels.build_audit_row(
        rows,
        session_id=F.concat(F.lit("audit-"), "slug"),
        timestamp=F.lit("2026-01-05 09:00:00"),
        slug=F.col("slug"),
        regime=F.col("regime"),
        source="documents",
        dev_mode=F.col("slug") == "study_hub",
    )


@query(
    "build_audit_row",
    """SELECT 'audit-' || j.slug AS session_id, '2026-01-05T09:00:00Z' AS at, 'human' AS audited_by,
              j.slug AS rule_set_slug, j.text,
              CASE WHEN r.regime = 'chat' THEN 'chat' ELSE 'comment' END AS regime,
              'documents' AS source, j.stream_idx AS source_stream_idx,
              CAST(j.doc_id AS VARCHAR) AS source_hf_id, j.obscene,
              CAST(j.violates_policy AS VARCHAR) AS violates_policy, j.severity,
              j.slug = 'study_hub' AS dev_mode
       FROM (SELECT s.stream_idx, s.obscene, s.text, j.* FROM stream s JOIN judged j USING (doc_id)) j JOIN rule_sets r ON j.slug = r.slug""",
    "stream judged rule_sets",
)
def _(spark, d):
    audit = _audit(spark, d)
    return audit.select(
        "session_id",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        "audited_by",
        "rule_set_slug",
        "content.text",
        "content.regime",
        "content.source",
        "content.source_stream_idx",
        "content.source_hf_id",
        "content.source_features.obscene",
        F.col("judgment.violates_policy").cast("string").alias("violates_policy"),
        "judgment.severity",
        "dev_mode",
    )


def _approved(spark, d):
    labelled = labels.attach_labels(
        inbox(spark, d),
        _stream(spark, d).select("stream_idx", "doc_id").join(views.judged(spark, d), "doc_id"),
    )
    at = F.lit("2026-01-05 09:00:00")
    return labels.build_approved_row(
        labelled, "batch-1", at, "arena_chat", "chat", "documents", "draft"
    )


_APPROVED = """
    SELECT i.stream_idx, i.bucket, i.text, i.toxicity, i.threat, coalesce(i.obscene, 0) AS obscene,
           i.insult, i.identity_attack, i.severe_toxicity, j.violates_policy, j.confidence,
           j.reasoning
    FROM inbox i JOIN judged j USING (doc_id)"""


@query(
    "build_approved_row",
    f"""SELECT 'batch-1' AS session_id, 'human_approved' AS audited_by, 'draft' AS initial_author,
               'human' AS reviewed_by, '2026-01-05T09:00:00Z' AS drafted_at, bucket, text, obscene,
               stream_idx, CAST(violates_policy AS VARCHAR) AS violates_policy, false AS dev_mode
        FROM ({_APPROVED})""",
    "inbox judged",
)
def _(spark, d):
    return _approved(spark, d).select(
        "session_id",
        "audited_by",
        "provenance.initial_author",
        "provenance.reviewed_by",
        F.date_format("provenance.drafted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("drafted_at"),
        "content.bucket",
        "content.text",
        "content.source_features.obscene",
        F.col("content.source_stream_idx").alias("stream_idx"),
        F.col("judgment.violates_policy").cast("string").alias("violates_policy"),
        "dev_mode",
    )


@query(
    "union_audit_rows",
    f"""SELECT 'human' AS audited_by, stream_idx, NULL::VARCHAR AS bucket,
               CAST(violates_policy AS VARCHAR) AS violates_policy,
               NULL::VARCHAR AS initial_author
        FROM stream JOIN judged USING (doc_id) JOIN rule_sets USING (slug)
        UNION ALL
        SELECT 'human_approved', stream_idx, bucket, CAST(violates_policy AS VARCHAR), 'draft'
        FROM ({_APPROVED})""",
    "inbox judged rule_sets",
)
def _(spark, d):
    both = labels.union_rows(_audit(spark, d), _approved(spark, d))
    return both.select(
        "audited_by",
        F.col("content.source_stream_idx").alias("stream_idx"),
        "content.bucket",
        F.col("judgment.violates_policy").cast("string").alias("violates_policy"),
        "provenance.initial_author",
    )


_TARGET_PLACE = """CASE bucket WHEN 'identity_attack' THEN 0 WHEN 'threat' THEN 1
                   WHEN 'sexual_explicit' THEN 2 WHEN 'high_tox' THEN 3 WHEN 'mid_tox' THEN 4
                   ELSE 5 END"""


@query(
    "review_row",
    f"""SELECT CAST(row_number() OVER (ORDER BY {_TARGET_PLACE}, stream_idx) AS INTEGER) AS number,
               bucket, CASE WHEN violates_policy THEN 'violation' ELSE 'allow' END AS tag,
               printf('%.2f', confidence) AS confidence,
               'toxicity=' || printf('%.2f', toxicity) || '  threat=' || printf('%.2f', threat)
               || '  obscene=' || printf('%.2f', obscene) || '  insult=' || printf('%.2f', insult)
               || '  identity_attack=' || printf('%.2f', identity_attack)
               || '  severe_toxicity=' || printf('%.2f', severe_toxicity) AS features,
               text, reasoning
        FROM ({_APPROVED})""",
    "inbox judged",
)
def _(spark, d):
    return labels.review_row(_approved(spark, d))


@query(
    "audit_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE violates_policy) AS violations,
              count(*) FILTER (WHERE confidence < 0.7) AS low_confidence
       FROM judged""",
    "judged",
)
def _(spark, d):
    return profile.audit_summary(views.judged(spark, d))


@query(
    "bucket_breakdown",
    f"""SELECT *, CASE WHEN bucket IS NULL THEN NULL ELSE CAST({_TARGET_PLACE} AS BIGINT) END
               AS position
        FROM (SELECT b.bucket, count(*) AS n_rows,
                     count(*) FILTER (WHERE j.violates_policy) AS n_flagged
              FROM buckets b JOIN judged j USING (doc_id) GROUP BY ROLLUP (b.bucket))""",
    "buckets judged",
)
def _(spark, d):
    rows = views.corpus(spark, d).select("doc_id", scores.bucket().alias("bucket"))
    verdicts = views.judged(spark, d).select("doc_id", "judgment.violates_policy")
    return profile.bucket_breakdown(rows.join(verdicts, "doc_id"), "bucket", "violates_policy")


# --- leak check ---

_TRAIN = "SELECT sha256(text || CAST(doc_id AS VARCHAR)) AS source_id, doc_id FROM documents"
_HELD = f"""SELECT source_id FROM ({_TRAIN})
            WHERE doc_id IN (SELECT doc_id FROM labels)"""


@query(
    "leak_check",
    f"SELECT source_id, doc_id FROM ({_TRAIN}) WHERE source_id IN ({_HELD})",
)
def _(spark, d):
    return labels.leaked(views.train(spark, d), views.held_out(spark, d)).select(
        "source_id", "doc_id"
    )


@query(
    "drop_leaked",
    f"SELECT source_id, doc_id FROM ({_TRAIN}) WHERE source_id NOT IN ({_HELD})",
)
def _(spark, d):
    return labels.drop_leaked(views.train(spark, d), views.held_out(spark, d)).select(
        "source_id", "doc_id"
    )


@query(
    "leaked_ids",
    f"SELECT source_id FROM ({_TRAIN}) INTERSECT SELECT source_id FROM ({_HELD})",
)
def _(spark, d):
    return labels.leaked_ids(views.train(spark, d), views.held_out(spark, d))


# --- pairing and derived labels ---


def pairs(spark, d):
    return labels.pair_with_rule_sets(views.content(spark, d), views.rule_sets(spark))


def verdicts(spark, d):
    return labels.derive_labels(pairs(spark, d), views.thresholds(spark))


def strict_verdicts(spark, d):
    return labels.derive_labels(pairs(spark, d), views.strict_thresholds(spark))


@query("pair_with_rule_sets", "SELECT doc_id, regime, slug FROM pairs", "pairs")
def _(spark, d):
    return pairs(spark, d).select("doc_id", "regime", "slug")


@query(
    "rank_pairings",
    """SELECT doc_id, slug FROM (
           SELECT doc_id, slug, row_number() OVER (PARTITION BY doc_id
                      ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR) || ':' || slug)) AS rn
           FROM pairs)
       WHERE rn <= 2""",
    "pairs",
)
def _(spark, d):
    return labels.rank_pairings(
        views.content(spark, d), views.rule_sets(spark), "doc_id", 2, 7
    ).select("doc_id", "slug")


@query(
    "derive_labels", "SELECT doc_id, slug, rules, violates_policy FROM verdicts", "verdicts"
)
def _(spark, d):
    return verdicts(spark, d).select(
        "doc_id", "slug", F.array_join("violated_rules", ",").alias("rules"), "violates_policy"
    )


@query(
    "derive_labels_binary",
    """SELECT f.doc_id, r.slug, CASE WHEN f.toxicity = 1 THEN p.rule_id ELSE '' END AS rules,
              f.toxicity = 1 AS violates_policy
       FROM flags f JOIN rule_sets r
         ON (length(f.user_input) < 150) = (r.regime = 'chat')
       LEFT JOIN positive p ON p.slug = r.slug""",
    "flags rule_sets positive",
)
def _(spark, d):
    regime = F.when(F.length("user_input") < 150, "chat").otherwise("comment")
    rows = views.flags(spark, d).withColumn("regime", regime)
    paired = labels.pair_with_rule_sets(rows, views.rule_sets(spark))
    return labels.derive_labels_binary(paired, "toxicity", views.positive_rules(spark)).select(
        "doc_id", "slug", F.array_join("violated_rules", ",").alias("rules"), "violates_policy"
    )


@query(
    "resolve_rules",
    """SELECT v.doc_id, v.slug, v.rule_id, r.rule_text
       FROM (SELECT doc_id, slug, unnest(string_split(rules, ',')) AS rule_id
             FROM verdicts WHERE rules <> '') v
       LEFT JOIN rules r ON v.slug = r.slug AND v.rule_id = r.rule_id""",
    "verdicts rules",
)
def _(spark, d):
    return labels.resolve_rules(
        verdicts(spark, d).select("doc_id", "slug", "violated_rules"),
        "slug",
        "violated_rules",
        views.rules(spark),
    ).select("doc_id", "slug", "rule_id", "rule_text")


@query(
    "foils",
    """SELECT doc_id,
              string_agg(slug, ',' ORDER BY slug) FILTER (WHERE violates_policy) AS violating,
              string_agg(slug, ',' ORDER BY slug) FILTER (WHERE NOT violates_policy) AS allowing
       FROM verdicts GROUP BY doc_id
       HAVING count(DISTINCT violates_policy) = 2""",
    "verdicts",
)
def _(spark, d):
    found = labels.foils(verdicts(spark, d), ["doc_id"])
    return found.select(
        "doc_id",
        F.array_join("violating", ",").alias("violating"),
        F.array_join("allowing", ",").alias("allowing"),
    )


@query(
    "foil_matrix",
    "SELECT doc_id, "
    + ", ".join(
        f"CAST(bool_or(violates_policy) FILTER (WHERE slug = '{s}') AS VARCHAR) AS {s}"
        for s in views.SLUGS
    )
    + " FROM verdicts GROUP BY doc_id",
    "verdicts",
)
def _(spark, d):
    matrix = labels.foil_matrix(verdicts(spark, d), ["doc_id"], views.SLUGS)
    return matrix.withColumns({s: F.col(s).cast("string") for s in views.SLUGS})


@query(
    "join_raters",
    """SELECT a.doc_id, a.slug, CAST(a.violates_policy AS BIGINT) AS a_yes,
              CAST(NOT a.violates_policy AS BIGINT) AS a_no,
              CAST(b.violates_policy AS BIGINT) AS b_yes,
              CAST(NOT b.violates_policy AS BIGINT) AS b_no
       FROM verdicts a JOIN strict_verdicts b ON a.doc_id = b.doc_id AND a.slug = b.slug""",
    "verdicts strict_verdicts",
)
def _(spark, d):
    return labels.join_raters(verdicts(spark, d), strict_verdicts(spark, d), ["doc_id", "slug"])
