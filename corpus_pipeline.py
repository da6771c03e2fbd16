"""From raw documents to training records: five stages, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns a table, which is written and reread as the next
one's documents.  All but the last return the columns of documents.  SQL can express none of them
in full (language models, min-hashes, edit distances, a tokenizer), hence ORACLE_SQL is None and
tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramlake.llm import decontamination, language_id, mixing, ngram_join, registry, token_records
from engramlake.llm.common import discard, scratch_paths, stored, table
from engramlake.llm.token_records import is_record_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those that no learned language explains better than chance."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, go or repeat as their fitted rates say."""
    return mixing.mixed(docs, mixing.document_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records are written; the result describes each one."""
    return token_records.token_digest(docs, registry.tokenizer_file())


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_records", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; of the shared folder's tables only that one and the records stay."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch_paths() as made:
            docs = stored(stage(spark, docs, sf_dir), name)
        discard(spark, before + [p for p in made[:-1] if not is_record_folder(p)])
        before = made[-1:]
    return docs
