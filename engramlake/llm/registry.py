"""The thin queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


def op5_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_template import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated_passages

    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import digest

    return digest(table(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import TARGETS, document_domains, mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), document_domains(table(spark, sf_dir, "labels")), TARGETS)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_kmeans import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def op12_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_links import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.v) = len(q.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_license_scan": op4_license_scan,
    "op5_html_template": op5_html_template,
    "op6_decontamination": op6_decontamination,
    "op7_token_records": op7_token_records,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_topk": op10_topk,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_lattice_links": op12_lattice_links,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op10_topk": OP10_SQL,
    "op11_ball_kmeans": oracles.product_codes(),
    "op12_lattice_links": oracles.CLOSE_VECTORS,
    "op13_merkle_manifest": oracles.MANIFEST,
}
