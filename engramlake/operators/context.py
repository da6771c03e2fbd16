"""The context that a new session starts with, as one Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_label, list_or_empty, text_or_empty, time_label
from .numbering import placed

# The headings, labels and marks in the texts below must equal what readers of the context expect.


def numbered(recent: DataFrame) -> DataFrame:
    """Recent observations (a bounded cut) with their number in the list, their day and time in UTC."""
    order = Window.orderBy(F.desc("created_at_epoch"), F.desc("id"))
    return recent.withColumn("n", F.row_number().over(order).cast("long")).withColumns({"day": day_label(F.col("created_at")), "time": time_label(F.col("created_at"))})


def _files() -> Column:
    changed, read = list_or_empty(F.col("files_modified")), list_or_empty(F.col("files_read"))
    return F.when(F.size(changed) > 0, F.array_join(changed, ", ")).otherwise(F.array_join(read, ", "))


def full_entries(recent: DataFrame, count: int = 5) -> DataFrame:
    """The first entries in full: n and entry."""
    story = F.when(text_or_empty(F.col("narrative")) != "", F.concat(F.lit("> "), F.col("narrative"), F.lit("\n"))).otherwise("")
    files = F.when(_files() != "", F.concat(F.lit("> Files: "), _files(), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("#### ["), F.col("n").cast("string"), F.lit("] "), text_or_empty(F.col("title")), F.lit("\n"))
    return numbered(recent).filter(F.col("n") <= count).select("n", "day", F.concat(head, story, files, F.lit("\n")).alias("entry"))


def by_day(recent: DataFrame) -> DataFrame:
    """For each day its first number and its entries as a list, in order."""
    rows = numbered(recent)
    line = F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), F.col("time"), F.lit(" | "), F.col("type"), F.lit(" | "), text_or_empty(F.col("title")), F.lit(" |"))
    return rows.groupBy("day").agg(F.min("n").alias("first_n"), F.count("*").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))


def markdown(recent: DataFrame, summaries: DataFrame, full: int = 5, tag: str = "memory-context") -> DataFrame:
    """One row, context: the list by days, the first entries in full, then the summaries; empty if there is nothing."""
    days = by_day(recent)
    details = full_entries(recent, full).groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda s: s["entry"]), "").alias("details"))
    table = F.concat(F.lit("### "), F.col("day"), F.lit("\n\n| # | Time | Type | Title |\n|---|------|------|-------|\n"), F.col("lines"), F.lit("\n\n"), text_or_empty(F.col("details")))
    first = days.join(details, "day", "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_n", table.alias("t")))), lambda s: s["t"]), "").alias("activity"))
    parts = F.concat_ws(". ", *[F.when(text_or_empty(F.col(c)) != "", F.concat(F.lit(p), F.col(c))) for c, p in (("request", ""), ("completed", "Completed: "), ("learned", "Learned: "))])
    bullet = F.concat(F.lit("- **Session "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("**: "), parts, F.lit("\n"))
    second = summaries.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at_epoch", "id", bullet.alias("b"))), asc=False), lambda s: s["b"]), "").alias("sessions"))
    body = F.concat(F.when(F.col("activity") != "", F.concat(F.lit("# Recent Activity\n\n"), F.col("activity"))).otherwise(""), F.when(F.col("sessions") != "", F.concat(F.lit("### Recent Sessions\n\n"), F.col("sessions"), F.lit("\n"))).otherwise(""))
    both = first.crossJoin(second)  # one row each
    return both.select(F.when(body != "", F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"</{tag}>"))).otherwise("").alias("context"))


def fallback_lines(sessions: DataFrame, prompts: DataFrame, observations: DataFrame) -> DataFrame:
    """(content_session_id, part, n, line): what prompts and observations tell of sessions, as lines in
    order, for want of a last message.  No row and no task holds a session, however long it is."""
    line = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), text_or_empty(F.col("title")), F.lit(": "), text_or_empty(F.col("narrative")))
    asked = prompts.join(sessions.select("content_session_id"), "content_session_id", "left_semi").select("content_session_id", "prompt_number", "id", F.concat(F.lit("- "), F.col("prompt")).alias("line"))
    done = observations.select("memory_session_id", "created_at_epoch", "id", line.alias("line")).join(sessions.select("content_session_id", "memory_session_id"), "memory_session_id")
    first = placed(asked, "content_session_id", F.floor(F.col("prompt_number") / 1000), ["prompt_number", "id"], "n")
    second = placed(done, "content_session_id", F.floor(F.col("created_at_epoch") / 3600), ["created_at_epoch", "id"], "n")
    shown = lambda df, part: df.select("content_session_id", F.lit(part).alias("part"), "n", "line")
    return shown(first, "prompts").unionByName(shown(second, "activity"))


def fallback_summaries(sessions: DataFrame, prompts: DataFrame, observations: DataFrame) -> DataFrame:
    """For each of the sessions asked for, its lines as one text, which is what a queue message holds."""
    lines = fallback_lines(sessions, prompts, observations)
    text = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("n", "line")))), lambda r: r["line"]), "\n")
    made = lines.groupBy("content_session_id").agg(text("prompts").alias("asked"), F.count_if(F.col("part") == "prompts").alias("__p"), text("activity").alias("done"), F.count_if(F.col("part") == "activity").alias("__a"))
    rows = sessions.select("content_session_id").join(made, "content_session_id", "left")
    return rows.select("content_session_id", F.concat_ws("\n", F.when(F.col("__p") > 0, F.concat(F.lit("## User Prompts\n"), F.col("asked"))), F.when(F.col("__a") > 0, F.concat(F.lit("\n## Session Activity\n"), F.col("done")))).alias("content"))
