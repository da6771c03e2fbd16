"""Lookups, lists, timelines and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import list_or_empty, prompt_preview, text_or_empty
from .search import _plain, in_project, newest


def by_id(df: DataFrame, row_id: int) -> DataFrame:
    return df.filter(F.col("id") == row_id)


def by_content_session(sessions: DataFrame, session: str) -> DataFrame:
    return sessions.filter(F.col("content_session_id") == session)


def list_observations(observations: DataFrame, project: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    conds = [in_project(project)] + ([F.col("type") == kind] if kind else [])
    return _plain(newest(observations.filter(reduce(lambda a, b: a & b, conds)), limit))


def list_summaries(summaries: DataFrame, project: str | None = None, limit: int = 20) -> DataFrame:
    rows = newest(summaries.filter(in_project(project)), limit)
    texts = [text_or_empty(F.col(c)).alias(c) for c in ("request", "investigated", "learned", "completed", "next_steps")]
    return rows.select("id", "memory_session_id", "project", *texts, list_or_empty(F.col("files_read")).alias("files_read"), list_or_empty(F.col("files_edited")).alias("files_edited"), "created_at_epoch")


def list_prompts(prompts: DataFrame, project: str | None = None, limit: int = 50) -> DataFrame:
    return newest(prompts.filter(in_project(project)), limit).select("id", "content_session_id", "project", "prompt", "prompt_number", "created_at_epoch")


def session_observations(observations: DataFrame, memory_session: str) -> DataFrame:
    return observations.filter(F.col("memory_session_id") == memory_session).orderBy("created_at", "id")


def session_prompts(prompts: DataFrame, session: str) -> DataFrame:
    return prompts.filter(F.col("content_session_id") == session).orderBy("prompt_number")


def recent_observations(observations: DataFrame, sessions: DataFrame, prompts: DataFrame, project: str | None = None, limit: int = 50) -> DataFrame:
    """The newest observations with the latest prompt number of their session (0 without one).

    The cut comes first, so that only its rows look up sessions, and prompts are reduced to those
    sessions before they are aggregated."""
    rows = newest(observations.filter(in_project(project)), limit)
    own = sessions.select("memory_session_id", "content_session_id")
    held = rows.join(own, "memory_session_id", "left")
    latest = prompts.join(held.select("content_session_id").distinct(), "content_session_id", "left_semi").groupBy("content_session_id").agg(F.max("prompt_number").alias("latest"))
    out = held.join(latest, "content_session_id", "left")
    return out.select("id", "type", text_or_empty(F.col("title")).alias("title"), text_or_empty(F.col("narrative")).alias("narrative"), list_or_empty(F.col("files_read")).alias("files_read"), list_or_empty(F.col("files_modified")).alias("files_modified"), F.coalesce("latest", F.lit(0)).cast("long").alias("prompt_number"), "created_at", "created_at_epoch")


def recent_summaries(summaries: DataFrame, project: str | None = None, limit: int = 10) -> DataFrame:
    rows = newest(summaries.filter(in_project(project)), limit)
    return rows.select("id", *[text_or_empty(F.col(c)).alias(c) for c in ("request", "completed", "learned", "next_steps")], "created_at", "created_at_epoch")


def unified_timeline(observations: DataFrame, summaries: DataFrame, prompts: DataFrame, project: str | None = None, kind: str | None = None, limits: tuple[int, int, int] = (100, 50, 50)) -> DataFrame:
    """The newest observations, summaries and prompts in one list; a type of observation leaves the others out."""
    obs = list_observations(observations, project, kind, limits[0]).select(F.lit("observation").alias("kind"), "id", F.col("title").alias("label"), F.unix_timestamp("created_at").alias("epoch"))
    if kind:
        return obs.orderBy(F.desc("epoch"), "kind", "id")
    sums = newest(summaries.filter(in_project(project)), limits[1]).select(F.lit("summary").alias("kind"), "id", text_or_empty(F.col("request")).alias("label"), F.col("created_at_epoch").alias("epoch"))
    asked = newest(prompts.filter(in_project(project)), limits[2]).select(F.lit("prompt").alias("kind"), "id", prompt_preview(F.col("prompt")).alias("label"), F.col("created_at_epoch").alias("epoch"))
    return obs.unionByName(sums).unionByName(asked).orderBy(F.desc("epoch"), "kind", "id")


def list_projects(observations: DataFrame) -> DataFrame:
    return observations.filter("project != ''").groupBy("project").agg(F.count("*").alias("observations")).orderBy(F.desc("observations"), "project")


def stats(observations: DataFrame, summaries: DataFrame, sessions: DataFrame, project: str | None = None) -> DataFrame:
    """One row of three counts, from one pass over each table."""
    parts = [df.filter(in_project(project)).select(F.lit(name).alias("name")) for name, df in (("sessions", sessions), ("observations", observations), ("summaries", summaries))]
    return reduce(DataFrame.unionByName, parts).agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("sessions", "observations", "summaries")])


def stats_by_project(observations: DataFrame, summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    parts = [df.select("project", F.lit(name).alias("name")) for name, df in (("sessions", sessions), ("observations", observations), ("summaries", summaries))]
    return reduce(DataFrame.unionByName, parts).groupBy("project").agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("sessions", "observations", "summaries")])


def missing_embeddings(observations: DataFrame, summaries: DataFrame, prompts: DataFrame) -> DataFrame:
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("table_name"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count("*").alias("total"))

    return of(observations, "observations").unionByName(of(summaries, "session_summaries")).unionByName(of(prompts, "user_prompts"))


def prompt_numbering(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Numbers new prompts of a session (content_session_id, created_at_epoch, id) after its last one."""
    last = existing.groupBy("content_session_id").agg(F.max("prompt_number").alias("last"))
    order = Window.partitionBy("content_session_id").orderBy("created_at_epoch", "id")
    numbered = new.withColumn("n", F.row_number().over(order)).join(last, "content_session_id", "left")
    return numbered.withColumn("prompt_number", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long")).drop("n", "last")
