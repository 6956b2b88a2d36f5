"""Order, prefixes, row expressions and corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden import contracts as C
from tidewarden.functions import scores, text
from tidewarden.operators import labels, ordering, profile, sampling
from tidewarden.plans import views
from tidewarden.plans.registry import query
from tidewarden.session import scratch_dir
from tidewarden.sources import tables

STREAM = "sha256('4096:' || CAST(doc_id AS VARCHAR))"


@query("scan_corpus", "SELECT doc_id, text, lang FROM documents")
def _(spark, d):
    schema = views.table(spark, d, "documents").select("doc_id", "text", "lang").schema
    return tables.scan_corpus(spark, f"{d}/documents.parquet", schema)


@query(
    "seeded_shuffle",
    f"SELECT doc_id, {STREAM} AS order_hash FROM documents ORDER BY order_hash",
)
def _(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id")
    shuffled = ordering.seeded_shuffle(docs, "doc_id", C.SAMPLE_SEED)
    return shuffled.select(
        "doc_id", ordering.order_hash(C.SAMPLE_SEED, F.col("doc_id")).alias("order_hash")
    )


@query(
    "scan_prefix",
    f"SELECT doc_id, text FROM documents ORDER BY {STREAM}, doc_id LIMIT 200",
)
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return ordering.scan_prefix(docs, C.CANDIDATE_SCAN_ROWS, "doc_id", C.SAMPLE_SEED).select(
        "doc_id", "text"
    )


@query(
    "with_stream_idx",
    """SELECT doc_id, stream_idx, toxicity FROM stream WHERE stream_idx < 1000""",
    "stream",
)
def _(spark, d):
    corpus = views.corpus(spark, d)
    return ordering.stream(corpus, C.PROFILE_SCAN_ROWS, "doc_id", C.SAMPLE_SEED).select(
        "doc_id", "stream_idx", "toxicity"
    )


@query(
    "jsonl_round_trip",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text, toxicity, obscene FROM corpus",
    "corpus",
)
def _(spark, d):
    path = scratch_dir(spark, "jsonl")
    rows = views.corpus(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    tables.write_jsonl(rows.select("id", "text", *C.SCORES), path)
    return tables.read_jsonl(spark, path, C.CORPUS_SCORES).select(
        "id", "text", "toxicity", "obscene"
    )


@query(
    "append_jsonl",
    """SELECT doc_id, regime, lang FROM content WHERE regime = 'chat'
       UNION ALL SELECT doc_id, regime, lang FROM content WHERE regime = 'comment'""",
    "content",
)
def _(spark, d):
    path = scratch_dir(spark, "log")
    rows = views.content(spark, d).select("doc_id", "regime", "lang")
    tables.append_jsonl(rows.where(F.col("regime") == "chat"), path)
    tables.append_jsonl(rows.where(F.col("regime") == "comment"), path)
    return tables.read_jsonl(spark, path, rows.schema)


@query(
    "read_held_out",
    """SELECT sha256(text || CAST(doc_id AS VARCHAR)) AS source_id
       FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def _(spark, d):
    path = scratch_dir(spark, "held-out")
    tables.write_held_out(views.held_out(spark, d), path)
    return tables.read_held_out(spark, path)


@query(
    "write_manifest",
    """SELECT sha256('generator-' || lang || ':' || sha256(source) || ':' || text) AS id,
              'generator-' || lang AS generator, sha256(source) AS prompt_hash,
              '2026-01-05T09:00:00Z' AS made_at
       FROM documents WHERE length(text) BETWEEN 20 AND 80""",
)
def _(spark, d):
    path = scratch_dir(spark, "manifest")
    docs = views.table(spark, d, "documents").where(text.length_band(F.col("text"), 20, 80))
    rows = tables.manifest(
        docs,
        "text",
        F.concat(F.lit("generator-"), F.col("lang")),
        F.col("source"),
        F.lit("2026-01-05 09:00:00"),
    )
    tables.write_manifest(rows, path)
    back = tables.read_jsonl(spark, path, rows.schema)
    return back.select(
        "id",
        "generator",
        "prompt_hash",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("made_at"),
    )


@query(
    "passes_length",
    """SELECT doc_id, length(text) BETWEEN 5 AND 1000 AND length(text) < 150 AS chat_ok,
              length(text) BETWEEN 5 AND 1000 AS comment_ok
       FROM documents""",
)
def _(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id",
        text.passes_length(F.col("text"), "chat").alias("chat_ok"),
        text.passes_length(F.col("text"), "comment").alias("comment_ok"),
    )


@query(
    "chat_track_filter",
    """SELECT 'comments' AS track, doc_id AS row_id, text FROM documents WHERE length(text) <= 120
       UNION ALL
       SELECT 'chat', row_id, user_input FROM chat WHERE length(user_input) <= 120""",
    "chat",
)
def _(spark, d):
    docs = views.table(spark, d, "documents").select(
        F.lit("comments").alias("track"), F.col("doc_id").alias("row_id"), "text"
    )
    chat = views.chat(spark, d).select(
        F.lit("chat").alias("track"), "row_id", F.col("user_input").alias("text")
    )
    short = F.length("text") <= C.CHAT_TRACK_MAX_CHARS
    return docs.where(short).unionByName(chat.where(short))


@query(
    "score_or_zero",
    "SELECT doc_id, coalesce(obscene, 0) AS obscene, threat FROM corpus",
    "corpus",
)
def _(spark, d):
    return views.corpus(spark, d).select(
        "doc_id", *[scores.score_or_zero(F.col(s)).alias(s) for s in ("obscene", "threat")]
    )


@query(
    "source_features",
    """SELECT doc_id, toxicity, threat, obscene, insult, identity_attack, severe_toxicity
       FROM corpus""",
    "corpus",
)
def _(spark, d):
    rows = views.corpus(spark, d).select("doc_id", scores.source_features().alias("features"))
    return rows.select("doc_id", "features.*")


@query("bucket", "SELECT doc_id, bucket FROM buckets", "buckets")
def _(spark, d):
    return views.corpus(spark, d).select("doc_id", scores.bucket().alias("bucket"))


@query(
    "content_regime",
    """SELECT doc_id, slug, CASE WHEN r.regime = 'chat' THEN 'chat' ELSE 'comment' END AS regime
       FROM judged JOIN rule_sets r USING (slug)""",
    "judged rule_sets",
)
def _(spark, d):
    rows = views.judged(spark, d).select("doc_id", "slug").join(views.rule_sets(spark), "slug")
    return rows.select("doc_id", "slug", text.content_regime(F.col("regime")).alias("regime"))


@query(
    "source_id",
    "SELECT doc_id, sha256(text || CAST(doc_id AS VARCHAR)) AS source_id FROM documents",
)
def _(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", text.source_id(F.col("text"), F.col("doc_id")).alias("source_id")
    )


@query("threshold_match", "SELECT doc_id, toxicity FROM corpus WHERE toxicity > 0.7", "corpus")
def _(spark, d):
    high = F.col("toxicity") > C.HIGH_TOXICITY
    return views.corpus(spark, d).where(high).select("doc_id", "toxicity")


@query(
    "prefix_tag",
    """SELECT doc_id, 'R' || (doc_id % 8 + 1) AS rule_id, lang || '-' || source AS edge
       FROM documents""",
)
def _(spark, d):
    rule = (F.col("doc_id") % 8 + 1).cast("string")
    tag = F.concat(F.lit("R"), rule, F.lit(":"), "lang", F.lit("-"), "source")
    return views.table(spark, d, "documents").select(
        "doc_id", text.edge_rule(tag).alias("rule_id"), text.edge_name(tag).alias("edge")
    )


@query(
    "mine_flagged",
    "SELECT doc_id, user_input FROM flags WHERE jailbreaking = 1",
    "flags",
)
def _(spark, d):
    return views.flags(spark, d).where(F.col("jailbreaking") == 1).select("doc_id", "user_input")


@query(
    "proxy_score",
    """SELECT doc_id, coalesce(obscene, toxicity) AS score,
              CASE WHEN obscene IS NULL THEN 'self' ELSE 'outside' END AS origin
       FROM corpus""",
    "corpus",
)
def _(spark, d):
    outside = F.col("obscene")
    return views.corpus(spark, d).select(
        "doc_id",
        scores.proxy_score(outside, F.col("toxicity")).alias("score"),
        scores.proxy_origin(outside).alias("origin"),
    )


@query(
    "length_band",
    """SELECT doc_id, length(text) BETWEEN 20 AND 80 AS short_form,
              length(text) BETWEEN 800 AND 1500 AS long_form
       FROM documents""",
)
def _(spark, d):
    body = F.col("text")
    return views.table(spark, d, "documents").select(
        "doc_id",
        text.length_band(body, 20, 80).alias("short_form"),
        text.length_band(body, 800, 1500).alias("long_form"),
    )


_PROFILE = """
    SELECT count(*) AS n_rows, min({v}) AS {min}, median({v}) AS {median}{shown}{mean},
           (list_sort(list({v}))[greatest(1, least(19 * (count(*) + 1) // 20, count(*) - 1))]
              * (20 - (19 * (count(*) + 1)
                 - 20 * greatest(1, least(19 * (count(*) + 1) // 20, count(*) - 1))))
            + list_sort(list({v}))[greatest(1, least(19 * (count(*) + 1) // 20, count(*) - 1)) + 1]
              * (19 * (count(*) + 1)
                 - 20 * greatest(1, least(19 * (count(*) + 1) // 20, count(*) - 1)))
           ) / 20 AS {p95}{max}
    FROM {rel}"""


def _length_sql(rel: str, column: str) -> str:
    v = f"length({column})"
    return _PROFILE.format(
        v=v,
        rel=rel,
        min="min_length",
        median="median_length",
        shown=f", CAST(floor(median({v})) AS BIGINT) AS median_shown",
        mean=f", sum({v}) / count(*) AS mean_length",
        p95="p95_length",
        max=f", max({v}) AS max_length",
    )


def _score_sql(rel: str, column: str) -> str:
    return _PROFILE.format(
        v=column, rel=rel, min="min_score", median="median_score", shown="", mean="",
        p95="p95_score", max="",
    )


@query("length_profile", _length_sql("documents", "text"))
def _(spark, d):
    return profile.length_profile(views.table(spark, d, "documents"), "text")


@query("length_profile_chat", _length_sql("chat", "user_input"), "chat")
def _(spark, d):
    return profile.length_profile(views.chat(spark, d), "user_input")


@query(
    "length_profile_prefix",
    _length_sql("(SELECT text FROM stream WHERE stream_idx < 1000)", "text"),
    "stream",
)
def _(spark, d):
    docs = views.table(spark, d, "documents")
    seen = ordering.scan_prefix(docs, C.PROFILE_SCAN_ROWS, "doc_id", C.SAMPLE_SEED)
    return profile.length_profile(seen, "text")


@query("score_profile", _score_sql("corpus", "toxicity"), "corpus")
def _(spark, d):
    return profile.score_profile(views.corpus(spark, d), "toxicity")


@query(
    "score_profile_values",
    _score_sql("(SELECT value FROM events)", "value"),
)
def _(spark, d):
    return profile.score_profile(views.table(spark, d, "events"), "value", 0.0, 500.0)


@query(
    "label_rates",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE toxicity = 1) AS n_toxicity,
              count(*) FILTER (WHERE jailbreaking = 1) AS n_jailbreaking,
              count(*) FILTER (WHERE toxicity = 1 AND jailbreaking = 1) AS n_both,
              CAST(100 * count(*) FILTER (WHERE toxicity = 1) AS DOUBLE) / count(*) AS pct_toxicity,
              CAST(100 * count(*) FILTER (WHERE jailbreaking = 1) AS DOUBLE) / count(*)
                  AS pct_jailbreaking
       FROM flags""",
    "flags",
)
def _(spark, d):
    return profile.label_rates(views.flags(spark, d), "toxicity", "jailbreaking")


@query(
    "flag_subset",
    """SELECT count(*) FILTER (WHERE jailbreaking = 1 AND toxicity = 0) AS n_outside,
              count(*) FILTER (WHERE jailbreaking = 1 AND toxicity = 0) = 0 AS is_subset
       FROM flags""",
    "flags",
)
def _(spark, d):
    return profile.flag_subset(views.flags(spark, d), "jailbreaking", "toxicity")


@query(
    "yield_estimate",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE length(text) <= 120) AS n_kept,
              CAST(count(*) FILTER (WHERE length(text) <= 120) AS DOUBLE) / count(*) AS share
       FROM documents""",
)
def _(spark, d):
    return profile.yield_estimate(
        views.table(spark, d, "documents"), "text", C.CHAT_TRACK_MAX_CHARS
    )


@query(
    "union_sources",
    """SELECT 'comments' AS origin, text, toxicity, NULL::INTEGER AS jailbreaking FROM corpus
       UNION ALL
       SELECT 'chat', user_input, toxicity, jailbreaking FROM flags""",
    "corpus flags",
)
def _(spark, d):
    comments = views.corpus(spark, d).select(
        F.lit("comments").alias("origin"), "text", "toxicity"
    )
    chat = views.flags(spark, d).select(
        F.lit("chat").alias("origin"),
        F.col("user_input").alias("text"),
        F.col("toxicity").cast("double").alias("toxicity"),
        "jailbreaking",
    )
    return labels.union_rows(comments, chat)


# --- samples ---

_INBOX = """
    SELECT stream_idx, bucket, text, CAST(doc_id AS VARCHAR) AS hf_id, toxicity, threat,
           coalesce(obscene, 0) AS obscene, insult, identity_attack, severe_toxicity,
           sexual_explicit
    FROM inbox"""


def inbox(spark, d, regime="comment"):
    return sampling.stratified_sample(views.corpus(spark, d), "doc_id", regime=regime)


def _flat(rows):
    return rows.select(
        "stream_idx", "bucket", "text", "hf_id", "features.*", "sexual_explicit"
    )


def flagship(spark, d):
    """The inbox for the comment length rule, flat."""
    return _flat(inbox(spark, d))


query("stratified_sample", _INBOX, "inbox")(flagship)


@query(
    "stratified_sample_chat",
    """SELECT stream_idx, bucket, text, CAST(doc_id AS VARCHAR) AS hf_id, toxicity, threat,
              coalesce(obscene, 0) AS obscene, insult, identity_attack, severe_toxicity,
              sexual_explicit
       FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY stream_idx) AS rn
             FROM stream WHERE stream_idx < 25000 AND length(text) BETWEEN 5 AND 149)
       WHERE rn <= CASE bucket WHEN 'identity_attack' THEN 10 WHEN 'threat' THEN 7
                               WHEN 'sexual_explicit' THEN 5 WHEN 'high_tox' THEN 13
                               WHEN 'mid_tox' THEN 10 ELSE 5 END""",
    "stream",
)
def _(spark, d):
    return _flat(inbox(spark, d, "chat"))


@query(
    "first_n_per_bucket",
    """SELECT doc_id, bucket, CAST(rn AS INTEGER) AS rank
       FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rn FROM buckets)
       WHERE rn <= CASE bucket WHEN 'identity_attack' THEN 10 WHEN 'threat' THEN 7
                               WHEN 'sexual_explicit' THEN 5 WHEN 'high_tox' THEN 13
                               WHEN 'mid_tox' THEN 10 ELSE 5 END""",
    "buckets",
)
def _(spark, d):
    rows = views.corpus(spark, d).withColumn("bucket", scores.bucket())
    top = sampling.first_n_per_group(rows, "bucket", C.BUCKET_TARGETS, ["doc_id"])
    return top.select("doc_id", "bucket", "rank")


@query(
    "bucket_fill",
    """SELECT t.bucket, coalesce(i.got, 0) AS got, t.target
       FROM (VALUES ('identity_attack', 10), ('threat', 7), ('sexual_explicit', 5),
                    ('high_tox', 13), ('mid_tox', 10), ('low_tox', 5)) AS t(bucket, target)
       LEFT JOIN (SELECT bucket, count(*) AS got FROM inbox GROUP BY bucket) i USING (bucket)""",
    "inbox",
)
def _(spark, d):
    return profile.bucket_fill(inbox(spark, d))


@query(
    "uniform_candidates",
    """SELECT doc_id, stream_idx FROM stream
       WHERE stream_idx < 200 AND length(text) BETWEEN 5 AND 1000""",
    "stream",
)
def _(spark, d):
    return sampling.uniform_candidates(
        views.corpus(spark, d), "doc_id", C.SAMPLE_SEED, "comment"
    ).select("doc_id", "stream_idx")


@query(
    "resume_slice",
    """SELECT doc_id, stream_idx, CAST(place AS INTEGER) AS place FROM (
           SELECT doc_id, stream_idx, row_number() OVER (ORDER BY stream_idx) - 1 AS place
           FROM stream WHERE stream_idx < 200 AND length(text) BETWEEN 5 AND 1000)
       WHERE place >= 7""",
    "stream",
)
def _(spark, d):
    candidates = sampling.uniform_candidates(
        views.corpus(spark, d), "doc_id", C.SAMPLE_SEED, "comment"
    )
    return sampling.resume_slice(candidates, 7).select(
        "doc_id", "stream_idx", F.col("place").cast("int")
    )


@query(
    "example_or_max",
    """SELECT doc_id, stream_idx, toxicity, toxicity > 0.7 AS above_threshold FROM stream
       WHERE stream_idx < 1000
       ORDER BY (toxicity > 0.7) DESC, CASE WHEN toxicity > 0.7 THEN 0 ELSE -toxicity END,
                stream_idx
       LIMIT 1""",
    "stream",
)
def _(spark, d):
    seen = ordering.stream(views.corpus(spark, d), C.PROFILE_SCAN_ROWS, "doc_id", C.SAMPLE_SEED)
    return sampling.example_or_max(
        seen.select("doc_id", "stream_idx", "toxicity"), "toxicity", C.HIGH_TOXICITY
    )


@query(
    "first_flagged",
    """SELECT * FROM (SELECT 'toxicity' AS flag, doc_id, toxicity, jailbreaking
                      FROM flags WHERE toxicity = 1 ORDER BY doc_id LIMIT 1)
       UNION ALL
       SELECT * FROM (SELECT 'jailbreaking', doc_id, toxicity, jailbreaking
                      FROM flags WHERE jailbreaking = 1 ORDER BY doc_id LIMIT 1)""",
    "flags",
)
def _(spark, d):
    rows = views.flags(spark, d).drop("user_input")
    return sampling.first_flagged(rows, ["toxicity", "jailbreaking"], "doc_id")


_BAND = """CASE WHEN toxicity > 0.5 THEN 'high' WHEN toxicity BETWEEN 0.2 AND 0.5 THEN 'mid'
                WHEN greatest(severe_toxicity, coalesce(obscene, 0), threat, insult,
                              identity_attack, sexual_explicit) >= 0.3 THEN 'category'
                WHEN toxicity < 0.1 THEN 'clean' ELSE 'unassigned' END"""


@query("band", f"SELECT doc_id, {_BAND} AS band FROM corpus", "corpus")
def _(spark, d):
    return views.corpus(spark, d).select("doc_id", scores.band().alias("band"))


def dealt(supply: str, n: int) -> str:
    """SQL for quotas that add up to n: name, quota. `supply` gives name, pct, place, supply.

    Each round deals what is left by largest remainder over the names that have rows left.
    """
    return f"""
        SELECT name, got AS quota FROM (
            WITH RECURSIVE deal AS (
                SELECT 0 AS round, name, pct, place, supply, CAST(0 AS BIGINT) AS got
                FROM ({supply})
                UNION ALL
                SELECT round + 1, name, pct, place, supply,
                       CASE WHEN got < supply
                            THEN least(supply, got + base
                                       + CASE WHEN by_rest <= rest - total THEN 1 ELSE 0 END)
                            ELSE got END
                FROM (SELECT *, sum(base) OVER () AS total,
                             row_number() OVER (ORDER BY over DESC, place) AS by_rest
                      FROM (SELECT *, CASE WHEN got < supply THEN (rest * pct) // open ELSE 0 END
                                          AS base,
                                   CASE WHEN got < supply THEN (rest * pct) % open ELSE -1 END
                                          AS over
                            FROM (SELECT *, {n} - sum(got) OVER () AS rest,
                                         sum(CASE WHEN got < supply THEN pct ELSE 0 END) OVER ()
                                             AS open
                                  FROM deal)
                            WHERE rest > 0 AND open > 0)))
            SELECT name, CAST(arg_max(got, round) AS BIGINT) AS got FROM deal GROUP BY name)"""


_BANDS = f"""
    SELECT p.name, p.pct, p.place, coalesce(b.n, 0) AS supply
    FROM (VALUES ('high', 35, 1), ('mid', 25, 2), ('category', 25, 3), ('clean', 15, 4))
             AS p(name, pct, place)
    LEFT JOIN (SELECT {_BAND} AS name, count(*) AS n FROM corpus GROUP BY 1) b USING (name)"""


@query(
    "band_sample",
    f"""SELECT doc_id, band, CAST(rn AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY band
                       ORDER BY sha256('17:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
            FROM (SELECT *, {_BAND} AS band FROM corpus))
        JOIN ({dealt(_BANDS, 601)}) q ON band = q.name WHERE rn <= quota""",
    "corpus",
)
def _(spark, d):
    return sampling.band_sample(views.corpus(spark, d), "doc_id", 17, 601).select(
        "doc_id", "band", F.col("rank").cast("int")
    )


@query(
    "band_quotas",
    f"""SELECT coalesce(p.name, b.name) AS band, coalesce(p.planned, 0) AS planned,
               coalesce(b.n, 0) AS n_rows, coalesce(q.quota, 0) AS taken,
               greatest(0, coalesce(p.planned, 0) - coalesce(b.n, 0)) AS short
        FROM (SELECT name, CAST(quota AS BIGINT) AS planned FROM (
                  {dealt("SELECT name, pct, place, 1000000 AS supply FROM (" + _BANDS + ")", 601)})) p
        FULL JOIN (SELECT {_BAND} AS name, count(*) AS n FROM corpus GROUP BY 1) b
             ON p.name = b.name
        LEFT JOIN ({dealt(_BANDS, 601)}) q ON p.name = q.name""",
    "corpus",
)
def _(spark, d):
    banded = views.corpus(spark, d).select(scores.band().alias("band"))
    return sampling.quota_report(banded, "band", 601, C.BAND_SHARES)[1]


@query(
    "golden_sample",
    """SELECT doc_id, bucket, CAST(rn AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY bucket
                      ORDER BY sha256('23:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
           FROM buckets)
       WHERE rn <= CASE bucket WHEN 'identity_attack' THEN 25 WHEN 'threat' THEN 20
                               WHEN 'sexual_explicit' THEN 15 ELSE 30 END""",
    "buckets",
)
def _(spark, d):
    return sampling.golden_sample(views.corpus(spark, d), "doc_id", 23).select(
        "doc_id", "bucket", F.col("rank").cast("int")
    )


_MIX = """SELECT source, row_id, text FROM (
              SELECT '{name}' AS source, {key} AS row_id, {column} AS text,
                     row_number() OVER (ORDER BY sha256('31:' || CAST({key} AS VARCHAR)), {key}) AS rn
              FROM {rel})
          JOIN quotas ON source = name WHERE rn <= quota"""
_MIXED = """
    SELECT 'chat' AS name, 50 AS pct, 1 AS place, (SELECT count(*) FROM chat) AS supply
    UNION ALL SELECT 'comments', 35, 2, (SELECT count(*) FROM documents)
    UNION ALL SELECT 'pages', 15, 3, (SELECT count(*) FROM pages)"""


# More than the smallest source can give.
@query(
    "source_mix",
    f"SELECT * FROM (WITH quotas AS ({dealt(_MIXED, 2001)}) "
    + " UNION ALL ".join(
        [
            _MIX.format(name="chat", key="row_id", column="user_input", rel="chat"),
            _MIX.format(name="comments", key="doc_id", column="text", rel="documents"),
            _MIX.format(name="pages", key="page_id", column="html", rel="pages"),
        ]
    )
    + ")",
    "chat",
)
def _(spark, d):
    chat = views.chat(spark, d).withColumnRenamed("user_input", "text")
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    pages = views.table(spark, d, "pages").select(
        F.col("page_id").alias("row_id"), F.col("html").alias("text")
    )
    parts = {"chat": (chat, 0.50), "comments": (docs, 0.35), "pages": (pages, 0.15)}
    return sampling.source_mix(parts, 2001, "row_id", 31)


@query(
    "cap_source",
    """SELECT row_id, user_input AS text FROM chat
       UNION ALL
       SELECT doc_id, text FROM (
           SELECT doc_id, text, row_number() OVER (
                      ORDER BY sha256('37:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
           FROM documents)
       WHERE rn <= floor((SELECT count(*) FROM chat) * CAST(0.2 AS DOUBLE)
                         / (1 - CAST(0.2 AS DOUBLE)))""",
    "chat",
)
def _(spark, d):
    chat = views.chat(spark, d).withColumnRenamed("user_input", "text")
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return sampling.cap_source(chat, docs, 0.2, "row_id", 37)


@query(
    "spot_check",
    """SELECT doc_id, slug, CAST(rn AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY slug
                      ORDER BY sha256('41:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
           FROM judged)
       WHERE rn <= 20""",
    "judged",
)
def _(spark, d):
    rows = views.judged(spark, d).select("doc_id", "slug")
    return sampling.spot_check(rows, "slug", 20, "doc_id", 41).withColumn(
        "rank", F.col("rank").cast("int")
    )


@query(
    "generator_mix_check",
    f"""SELECT coalesce(p.kind, k.kind) AS kind, coalesce(k.n, 0) AS n_rows,
               CAST(coalesce(k.n, 0) AS DOUBLE) / (SELECT count(*) FROM corpus) AS share,
               coalesce(p.planned, 0) AS planned
        FROM (VALUES ('clean', CAST(0.4 AS DOUBLE)), ('borderline', 0.3), ('violation', 0.2),
                     ('obfuscated', 0.1)) AS p(kind, planned)
        FULL JOIN (SELECT CASE {_BAND} WHEN 'clean' THEN 'clean' WHEN 'mid' THEN 'borderline'
                               WHEN 'high' THEN 'violation' ELSE 'other' END AS kind, count(*) AS n
                   FROM corpus GROUP BY 1) k ON p.kind = k.kind""",
    "corpus",
)
def _(spark, d):
    band = scores.band()
    kind = (
        F.when(band == "clean", "clean")
        .when(band == "mid", "borderline")
        .when(band == "high", "violation")
        .otherwise("other")
    )
    rows = views.corpus(spark, d).select(kind.alias("kind"))
    return sampling.share_check(rows, "kind", C.GENERATOR_SHARES)


@query(
    "call_mix_check",
    """SELECT p.call, coalesce(k.n, 0) AS n_rows,
              CAST(coalesce(k.n, 0) AS DOUBLE) / (SELECT count(*) FROM corpus) AS share, p.planned
       FROM (VALUES ('clear_violation', CAST(0.4 AS DOUBLE)), ('lookalike', 0.3),
                    ('borderline', 0.3)) AS p(call, planned)
       LEFT JOIN (SELECT CASE WHEN toxicity >= 0.5 THEN 'clear_violation'
                              WHEN insult >= 0.2 THEN 'lookalike' ELSE 'borderline' END AS call,
                         count(*) AS n FROM corpus GROUP BY 1) k ON p.call = k.call""",
    "corpus",
)
def _(spark, d):
    call = (
        F.when(F.col("toxicity") >= 0.5, "clear_violation")
        .when(F.col("insult") >= 0.2, "lookalike")
        .otherwise("borderline")
    )
    rows = views.corpus(spark, d).select(call.alias("call"))
    return sampling.share_check(rows, "call", C.CALL_SHARES)


@query(
    "slice_quota",
    """SELECT slice, coalesce(n.n, 0) AS n_rows, coalesce(q.planned, 0) AS planned,
              greatest(0, coalesce(q.planned, 0) - coalesce(n.n, 0)) AS missing
       FROM (VALUES ('R1', 12), ('R2', 15), ('R3', 10), ('R4', 12), ('R5', 10), ('R6', 10),
                    ('R7', 8), ('R8', 8), ('clean', 10), ('foil', 5)) AS q(slice, planned)
       FULL JOIN (SELECT slice, count(*) AS n
                  FROM (SELECT unnest(CASE WHEN len(violated_rules) = 0 THEN ['clean']
                                           ELSE list_distinct(violated_rules) END) AS slice
                        FROM judged WHERE violated_rules IS NOT NULL)
                  GROUP BY 1) n USING (slice)""",
    "judged",
)
def _(spark, d):
    rules = F.col("judgment.violated_rules")
    rows = views.judged(spark, d).where(rules.isNotNull())
    slices = F.when(F.size(rules) == 0, F.array(F.lit("clean"))).otherwise(F.array_distinct(rules))
    return profile.slice_quota(
        rows.select(F.explode(slices).alias("slice")), "slice", C.SLICE_QUOTAS
    )


_CALL = """CASE WHEN confidence >= 0.7 THEN 'clear_violation' WHEN confidence >= 0.4 THEN 'lookalike'
                WHEN confidence >= 0.1 THEN 'borderline' ELSE 'unread' END"""


@query(
    "mix_by_rule",
    f"""SELECT coalesce(p.rule_id, k.rule_id) AS rule_id, coalesce(p.kind, k.kind) AS kind,
               coalesce(k.n, 0) AS n_rows, CAST(coalesce(k.n, 0) AS DOUBLE) / whole AS share,
               coalesce(p.planned, 0) AS planned
        FROM (SELECT * FROM (VALUES ('R1'), ('R2'), ('R3'), ('R4'), ('R5'), ('R6'), ('R7'), ('R8'))
                                AS r(rule_id),
                       (VALUES (NULL, CAST(1 AS DOUBLE)), ('clear_violation', 0.4),
                               ('lookalike', 0.3), ('borderline', 0.3)) AS c(kind, planned)) p
        FULL JOIN (SELECT rule_id, kind, count(*) AS n
                   FROM (SELECT unnest(list_distinct(violated_rules)) AS rule_id, {_CALL} AS kind
                         FROM judged)
                   GROUP BY GROUPING SETS ((rule_id, kind), (rule_id))) k
             ON p.rule_id = k.rule_id AND p.kind IS NOT DISTINCT FROM k.kind
        LEFT JOIN (SELECT rule_id AS of_rule, count(*) AS whole
                   FROM (SELECT unnest(list_distinct(violated_rules)) AS rule_id FROM judged)
                   GROUP BY 1) w ON coalesce(p.rule_id, k.rule_id) = of_rule""",
    "judged",
)
def _(spark, d):
    c = F.col("judgment.confidence")
    call = (
        F.when(c >= 0.7, "clear_violation")
        .when(c >= 0.4, "lookalike")
        .when(c >= 0.1, "borderline")
        .otherwise("unread")
    )
    rows = views.judged(spark, d).select(F.col("judgment.violated_rules").alias("rules"), call.alias("call"))
    planned = [s for s in C.SLICE_QUOTAS if s.startswith("R")]
    return sampling.mix_by_rule(rows, "rules", "call", C.CALL_SHARES, planned)
