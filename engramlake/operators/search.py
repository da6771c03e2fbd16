"""Search: full text, vectors, both together, by file, and by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fts
from ..functions.scalar import list_or_empty, text_or_empty
from ..functions.vectors import cosine_similarity, vector_literal
from ..sources.postings import Postings
from ..sources.vector_cells import VectorIndex

RESULT = ["id", "type", "title", "subtitle", "narrative", "project", "created_at", "text_rank", "semantic_score", "combined_score"]
TEXT_WEIGHT, SEMANTIC_WEIGHT, OVERFETCH = 0.4, 0.6, 3

OBSERVATION_FIELDS = [("title", "A"), ("subtitle", "B"), ("narrative", "C"), ("text", "D")]
SUMMARY_FIELDS = [("request", "A"), ("investigated", "B"), ("learned", "B"), ("completed", "C"), ("next_steps", "C"), ("notes", "D")]


def in_project(project: str | None) -> Column:
    """No project means all of them; an empty one is a project like any other."""
    return F.lit(True) if project is None else F.col("project") == project


def newest(df: DataFrame, limit: int) -> DataFrame:
    """The last rows by creation, ties by id: a top-k, not a sort of everything."""
    return df.orderBy(F.desc("created_at_epoch"), F.desc("id")).limit(limit)


def matching(df: DataFrame, fields: list[tuple[str, str]], query: str, config: str = "simple") -> DataFrame:
    """The rows that match a web search string."""
    parsed = fts.parse_query(query, config)
    if config == "simple":
        return df.filter(fts.text_matches([F.col(c) for c, _ in fields], parsed))
    found = fts.with_vector(df, fields, config, only=sorted({w for g in parsed for t in g for w in t.tokens}))
    return df.join(found.filter(fts.matches(F.col("vector"), parsed)).select("id"), "id", "left_semi")


def text_hits(df: DataFrame, fields: list[tuple[str, str]], query: str, config: str = "simple") -> DataFrame:
    """id and text_rank of the rows that match a web search string."""
    parsed = fts.parse_query(query, config)
    if config == "simple":  # words are placed only where the text matches
        made = fts.with_vector(matching(df, fields, query), fields, only=fts.query_tokens(parsed))
    else:
        made = fts.with_vector(df, fields, config, only=sorted({w for g in parsed for t in g for w in t.tokens}))
        made = made.filter(fts.matches(F.col("vector"), parsed))
    return made.select("id", fts.rank(F.col("vector"), parsed).alias("text_rank"))


def nearest(df: DataFrame, vector: list[float], k: int) -> DataFrame:
    """id and semantic_score of the k rows closest to a vector; rows without one take no part."""
    scored = df.filter("embedding is not null").select("id", cosine_similarity(F.col("embedding"), vector_literal(vector)).alias("semantic_score"))
    # filtered behind the cut: before it, Spark would push the filter down and score each row twice
    return scored.orderBy(F.desc_nulls_last("semantic_score"), "id").limit(k).filter("semantic_score is not null")


@dataclass(frozen=True)
class Indexes:
    """Stored indexes of a table: searches read them in place of its texts and its vectors."""

    postings: Postings
    vectors: VectorIndex | None  # a table without any vector has none

    def text(self, query: str, project: str | None) -> DataFrame:
        return self.postings.hits(query, project)

    def near(self, vector: list[float], k: int, project: str | None) -> DataFrame:
        """The exact neighbours, since ranks are compared with those of texts."""
        if self.vectors is None:
            return self.postings.spark.createDataFrame([], "id bigint, semantic_score double")
        return self.vectors.nearest(vector, k, project, exact=True)


def _hybrid(table: DataFrame, fields: list[tuple[str, str]], query: str, vector: list[float], project: str | None, limit: int, config: str, indexes: Indexes | None) -> DataFrame:
    """A row that only its text found keeps a semantic score of 0, as one beyond the fetched neighbours."""
    rows = table.filter(in_project(project))
    if indexes is None:
        text, near = text_hits(rows, fields, query, config), nearest(rows, vector, OVERFETCH * limit)
    else:
        text, near = indexes.text(query, project), indexes.near(vector, OVERFETCH * limit, project)
    # the two candidate lists meet by id first; only candidates then fetch their columns
    found = text.join(near, "id", "full").select("id", F.coalesce("text_rank", F.lit(0.0)).alias("text_rank"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"))
    scored = found.withColumn("combined_score", F.col("text_rank") * TEXT_WEIGHT + F.col("semantic_score") * SEMANTIC_WEIGHT)
    best = scored.orderBy(F.desc("combined_score"), "id").limit(limit)
    return rows.join(F.broadcast(best), "id")  # limit rows: a proven bound


def _observation_columns() -> list[Column]:
    return [F.col("id"), F.col("type"), *[text_or_empty(F.col(c)).alias(c) for c in ("title", "subtitle", "narrative")], F.col("project"), F.col("created_at")]


def _summary_columns() -> list[Column]:
    return [F.col("id"), F.lit("summary").alias("type"), text_or_empty(F.col("request")).alias("title"), text_or_empty(F.col("completed")).alias("subtitle"), text_or_empty(F.col("learned")).alias("narrative"), F.col("project"), F.col("created_at")]


_SCORES = ["text_rank", "semantic_score", "combined_score"]


def hybrid_search(observations: DataFrame, query: str, vector: list[float], project: str | None = None, limit: int = 10, config: str = "simple", indexes: Indexes | None = None) -> DataFrame:
    """With ``indexes`` of the table, it needs no vectors itself and is read for the hits alone."""
    return _hybrid(observations, OBSERVATION_FIELDS, query, vector, project, limit, config, indexes).select(*_observation_columns(), *_SCORES)


def hybrid_search_summaries(summaries: DataFrame, query: str, vector: list[float], project: str | None = None, limit: int = 10, config: str = "simple", indexes: Indexes | None = None) -> DataFrame:
    return _hybrid(summaries, SUMMARY_FIELDS, query, vector, project, limit, config, indexes).select(*_summary_columns(), *_SCORES)


def hybrid_search_all(observations: DataFrame, summaries: DataFrame, query: str, vector: list[float], project: str | None = None, limit: int = 10, config: str = "simple", indexes: tuple[Indexes | None, Indexes | None] = (None, None)) -> DataFrame:
    both = hybrid_search(observations, query, vector, project, limit, config, indexes[0]).unionByName(hybrid_search_summaries(summaries, query, vector, project, limit, config, indexes[1]))
    return both.orderBy(F.desc("combined_score"), "type", "id").limit(limit)


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*_observation_columns(), *[F.lit(0.0).alias(s) for s in _SCORES])


def search_by_file(observations: DataFrame, path: str, project: str | None = None, limit: int = 20) -> DataFrame:
    """Observations that read or modified a file, newest first."""
    has = F.array_contains(list_or_empty(F.col("files_read")), path) | F.array_contains(list_or_empty(F.col("files_modified")), path)
    return _plain(newest(observations.filter(in_project(project) & has), limit))


def search_timeline(observations: DataFrame, first: int, last: int, project: str | None = None, limit: int = 50) -> DataFrame:
    """Observations created within a closed range of epochs, newest first."""
    return _plain(newest(observations.filter(in_project(project) & F.col("created_at_epoch").between(first, last)), limit))


def lsh_nearest(df: DataFrame, vector: list[float], k: int, tables: int = 8, bucket: float = 0.6, seed: int = 7) -> DataFrame:
    """Approximate neighbours by random projections; on unit vectors distance and cosine agree.  An extension."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = df.filter("embedding is not null").select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=bucket, seed=seed).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(vector), k, distCol="d")
    return near.select("id", (1 - F.col("d") * F.col("d") / 2).alias("semantic_score"))
