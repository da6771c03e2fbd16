"""One object for the questions that are asked of a memory."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.models import Embedder
from .functions.scalar import day_bounds
from .operators import changes, context, lists, search
from .sources import memory
from .sources.postings import Postings
from .sources.vector_cells import VectorIndex, usable

# fixed values: limits where none, or none that makes sense, is given
LIMITS = {"search": 10, "by_file": 20, "timeline": 50, "observations": 20, "summaries": 20, "prompts": 50, "pull": 100, "context_observations": 50, "context_summaries": 10, "context_full": 5}


def limit_or_default(limit: object, name: str) -> int:
    try:
        n = int(str(limit))
    except ValueError:
        return LIMITS[name]
    return n if n > 0 else LIMITS[name]


@dataclass(frozen=True)
class Memory:
    """Tables as DataFrames, and an embedder for search strings."""

    observations: DataFrame
    summaries: DataFrame
    prompts: DataFrame
    sessions: DataFrame
    settings: DataFrame
    embedder: Embedder
    config: str = "english"
    indexes: tuple[search.Indexes | None, search.Indexes | None] = (None, None)  # of observations and of summaries

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, embedder: Embedder, config: str = "english") -> Memory:
        return cls(memory.observations(spark, sf_dir), memory.summaries(spark, sf_dir), memory.user_prompts(spark, sf_dir), memory.sessions(spark, sf_dir), memory.settings(spark, sf_dir), embedder, config)

    def indexed(self, root: str) -> Memory:
        """The same memory, its searches answered from indexes that are built under ``root``."""

        def build(rows: DataFrame, fields: list[tuple[str, str]], name: str) -> search.Indexes:
            postings = Postings(rows.sparkSession, f"{root}/{name}/postings", fields, self.config)
            postings.append(rows, 0)
            with_vectors = rows.select("id", "project", "embedding").filter(usable())
            if with_vectors.isEmpty():
                return search.Indexes(postings, None)
            cells = VectorIndex(rows.sparkSession, f"{root}/{name}/vectors")
            cells.train(with_vectors)
            cells.append(with_vectors, 0)
            return search.Indexes(postings, cells)

        return replace(self, indexes=(build(self.observations, search.OBSERVATION_FIELDS, "observations"), build(self.summaries, search.SUMMARY_FIELDS, "summaries")))

    def search(self, query: str, project: str | None = None, limit: object = None) -> DataFrame:
        if not query.strip():
            raise ValueError("a search needs a query")
        vector = self.embedder([query])[0]
        if vector is None:
            raise ValueError("the query has no embedding")
        return search.hybrid_search_all(self.observations, self.summaries, query, vector, project, limit_or_default(limit, "search"), self.config, self.indexes)

    def by_file(self, path: str, project: str | None = None, limit: object = None) -> DataFrame:
        return search.search_by_file(self.observations, path, project, limit_or_default(limit, "by_file"))

    def timeline(self, project: str | None = None, first: str | None = None, last: str | None = None, limit: object = None) -> DataFrame:
        low, high = day_bounds(first, last, F.unix_timestamp())
        within = self.observations.filter(F.col("created_at_epoch").between(low, high))
        return search.search_timeline(within, 0, 1 << 62, project, limit_or_default(limit, "timeline"))

    def list_observations(self, project: str | None = None, kind: str | None = None, limit: object = None) -> DataFrame:
        return lists.list_observations(self.observations, project, kind, limit_or_default(limit, "observations"))

    def list_summaries(self, project: str | None = None, limit: object = None) -> DataFrame:
        return lists.list_summaries(self.summaries, project, limit_or_default(limit, "summaries"))

    def list_prompts(self, project: str | None = None, limit: object = None) -> DataFrame:
        return lists.list_prompts(self.prompts, project, limit_or_default(limit, "prompts"))

    def observation(self, row_id: int) -> DataFrame:
        return lists.by_id(self.observations, row_id)

    def projects(self) -> DataFrame:
        return lists.list_projects(self.observations)

    def stats(self, project: str | None = None) -> DataFrame:
        return lists.stats(self.observations, self.summaries, self.sessions, project)

    def context(self, project: str | None = None) -> str:
        recent = lists.recent_observations(self.observations, self.sessions, self.prompts, project, LIMITS["context_observations"])
        return context.markdown(recent, lists.recent_summaries(self.summaries, project, LIMITS["context_summaries"]), LIMITS["context_full"]).first()["context"]

    def tables(self) -> dict[str, DataFrame]:
        return {"sdk_sessions": self.sessions, "observations": self.observations, "session_summaries": self.summaries, "user_prompts": self.prompts}

    def sync_info(self) -> tuple[DataFrame, DataFrame]:
        """Counts per table, and the last push and pull of each client."""
        return changes.sync_stats(self.tables()), changes.client_sync_times(self.settings)

    def pull(self, requester: str, cursors: dict[str, int], limit: object = None) -> tuple[dict[str, DataFrame], DataFrame]:
        """The next page of each table and the cursors behind them."""
        pages = {t: changes.pull_page(df, requester, cursors.get(t, 0), limit_or_default(limit, "pull")) for t, df in self.tables().items()}
        return pages, changes.pull_cursors(pages)
