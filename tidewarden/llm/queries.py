"""The registered queries of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import (
    bpe,
    embedding_dedup,
    html,
    infill,
    licenses,
    line_dedup,
    minhash,
    mixing,
    neighbours,
    pii,
    products,
    quality,
    whitening,
)
from tidewarden.llm.common import table
from tidewarden.llm.registry import query


def public_ranks() -> tuple[list[bytes], str]:
    """The ranks of the public 50k vocabulary, and its pattern."""
    import public_tokenizers

    return bpe.rank_lines(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), *public_ranks())


@query("op8_html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op10_pii")
def find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query("op9_quality_neighbours")
def quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out)
    scored = quality.score(documents, labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op6_minmax_near_dedup")
def minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op1_collision_counting")
def collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op7_multi_index_near_dedup")
def multi_index_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op2_line_dedup")
def removed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(documents, min_words=50)


#: The mix wanted by language, as shares of all tokens.
WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def languages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The language of the labelled documents."""
    known = documents.select("doc_id", F.col("lang").alias("domain")).where("domain is not null")
    return known.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


@query("op5_soft_mixing")
def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mixing.mix(documents, languages(documents, table(spark, sf_dir, "labels")), WEIGHTS)
    return mixed.select("doc_id", "tokens", F.transform("p", lambda x: F.round(x, 6)).alias("p"), F.round("rate", 6).alias("rate"), "taken")


@query("op4_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


@query(
    "op12_norm_buckets",
    """WITH whole AS (
           SELECT vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
       scored AS (
           SELECT q.vec_id AS query_id, v.vec_id,
                  CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
           FROM whole q JOIN whole v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
       SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
             FROM scored) WHERE place <= 20""",
)
def norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@query(
    "op13_fill_in_middle",
    r"""WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
        units AS (
            SELECT *, regexp_extract_all(text, '[^
]*
|[^
]+') AS unit,
                   [CAST('0x' || substr(digest, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h
            FROM drawn),
        cut AS (
            SELECT *, len(unit) AS n, least(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) AS a,
                   greatest(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) AS b FROM units),
        parts AS (
            SELECT doc_id, text, n,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                             OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                        WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(unit[1:a], '') AS prefix,
                   array_to_string(unit[a + 1:b], '') AS middle,
                   array_to_string(unit[b + 1:], '') AS suffix FROM cut)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                                ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(infill.rebuilt(F.col("output"), F.col("form")), 256)}
    return rows.withColumns(digests).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
