"""Hook events as streams: normalise, filter, fan out; work through the queue; number prompts.

Streams keep their place in a checkpoint, so a message is claimed once without locks, and a batch
that is repeated after a failure is dropped by its sync_id or its batch number."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.json import normalized_hooks, parse_observation
from ..functions.models import Embedder, embed, extract
from ..functions.scalar import embedding_text, project_allowed, project_from_path, tool_kept, tool_prompt
from ..operators.changes import resolve_sessions
from ..operators.numbering import placed
from ..sources.memory import last_assistant_messages
from ..sources.tables import Change, TableSet

EVENTS = ("session-start", "prompt-submit", "post-tool-use", "stop")


def hook_stream(spark: SparkSession, path: str, *, per_batch: int = 1000) -> DataFrame:
    """Files of JSON lines as a stream of (event, received_at, fields of the payload)."""
    raw = spark.readStream.schema("event string, received_at timestamp, payload string").option("maxFilesPerTrigger", per_batch).json(path)
    return normalized(raw)


def normalized(raw: DataFrame) -> DataFrame:
    return normalized_hooks(raw, "payload", "event", "received_at")


def accepted_tools(events: DataFrame, *, allow: str = "", deny: str = "", skip: str = "") -> DataFrame:
    """Tool events of allowed projects with tools that aren't skipped, and their project."""
    rows = events.filter("event = 'post-tool-use' and session_id is not null and tool_name is not null").withColumn("project", project_from_path(F.col("cwd")))
    return rows.filter(tool_kept(F.col("tool_name"), F.lit(skip)) & project_allowed(F.col("project"), F.lit(allow), F.lit(deny)))


def queue_messages(events: DataFrame) -> DataFrame:
    """Queue rows of accepted tool events; the id is a hash of what happened, so a replay repeats it."""
    body = F.to_json(F.struct("tool_name", "tool_input", "tool_response", "cwd", "project"))
    return events.select(F.xxhash64("session_id", "received_at", body).alias("id"), F.col("session_id").alias("content_session_id"), F.lit("observation").alias("message_type"), body.alias("payload"), F.lit("pending").alias("status"), F.col("received_at").alias("created_at"))


@dataclass(frozen=True)
class Branches:
    """What hook events ask for, each kind of event its own rows."""

    contexts: DataFrame  # session-start: (session_id, project) whose context is wanted
    sessions: DataFrame  # prompt-submit, post-tool-use: (content_session_id, project, started_at_epoch) to be upserted
    prompts: DataFrame  # prompt-submit with a prompt: (content_session_id, project, prompt, received_at)
    messages: DataFrame  # post-tool-use and stop: rows of the queue
    stops: DataFrame  # stop: (content_session_id, at_epoch) of sessions that are over


def fan_out(events: DataFrame, fallback: DataFrame | None = None, transcripts: DataFrame | None = None, *, allow: str = "", deny: str = "", skip: str = "") -> Branches:
    """All branches of a batch of normalised events; events of projects that aren't allowed have none,
    nor have prompts and tool events without a folder.

    Prompts and accepted tool events begin their session.  A stop queues a summary of its last message,
    else of what ``transcripts(path, message)`` has for its transcript, else of what
    ``fallback(content_session_id, content)`` knows of the session; without any nothing is queued, but
    the session is over."""
    rows = events.withColumn("project", project_from_path(F.col("cwd")))
    rows = rows.filter(project_allowed(F.col("project"), F.lit(allow), F.lit(deny)))
    known = rows.filter("session_id is not null")
    said = known.filter("event = 'prompt-submit' and cwd <> ''")
    tools = accepted_tools(events, allow=allow, deny=deny, skip=skip).filter("cwd <> ''")
    begun = said.select("session_id", "project", "received_at").unionByName(tools.select("session_id", "project", "received_at"))
    stop = known.filter("event = 'stop'").withColumnRenamed("session_id", "content_session_id")
    ended, messages = stop, [F.nullif(F.col("last_assistant_message"), F.lit(""))]
    if transcripts is not None:
        ended = ended.join(transcripts.select(F.col("path").alias("transcript_path"), F.col("message").alias("__read")), "transcript_path", "left")
        messages.append(F.nullif(F.col("__read"), F.lit("")))
    if fallback is not None:
        ended = ended.join(fallback.select("content_session_id", F.col("content").alias("__content")), "content_session_id", "left")
        messages.append(F.nullif(F.col("__content"), F.lit("")))
    message = F.coalesce(*messages)
    body = F.to_json(F.struct(message.alias("last_assistant_message"), "project"))
    summaries = ended.filter(message.isNotNull()).select(F.xxhash64("content_session_id", "received_at", body).alias("id"), "content_session_id", F.lit("summary").alias("message_type"), body.alias("payload"), F.lit("pending").alias("status"), F.col("received_at").alias("created_at"))
    return Branches(
        rows.filter("event = 'session-start'").select("session_id", "project"),
        begun.select(F.col("session_id").alias("content_session_id"), "project", F.unix_timestamp("received_at").alias("started_at_epoch")),
        said.filter("prompt is not null").select(F.col("session_id").alias("content_session_id"), "project", "prompt", "received_at"),
        queue_messages(tools).unionByName(summaries),
        stop.select("content_session_id", F.unix_timestamp("received_at").alias("at_epoch")),
    )


LONGEST_LINE = 10 * 1024 * 1024  # fixed value: bytes of a transcript's line; longer ones are left out


def transcript_messages(paths: DataFrame) -> DataFrame:
    """(path, message): the last assistant text of the transcripts at ``paths(path)``, as they are now.

    Each is read line by line in a task; one that can't be read has no row."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [path] * len(held), "line_no": [n for n, _ in held], "value": [v for _, v in held]}, schema=pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("value", pa.string())]))

        for part in batches:
            for path in part.column(0).to_pylist():
                try:
                    system, where = fs.FileSystem.from_uri(path)
                    held, size = [], 0
                    with system.open_input_stream(where) as raw:
                        for n, line in enumerate(io.BufferedReader(raw)):
                            # only lines that may be an assistant's are handed on
                            if len(line) <= LONGEST_LINE and b"assistant" in line:
                                held.append((n, line.decode("utf-8", "replace")))
                                size += len(line)
                            if size > LONGEST_LINE:
                                yield batch(path, held)
                                held, size = [], 0
                    yield batch(path, held)
                except (OSError, ValueError):
                    continue

    wanted = paths.filter("path <> ''").select("path").distinct()
    return last_assistant_messages(wanted.mapInArrow(lines, "path string, line_no bigint, value string"))


def run_hooks(events: DataFrame, embedder: Embedder, out: str, checkpoint: str, *, fallback: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None, **filters: str) -> StreamingQuery:
    """Fans a stream of normalised events out into a folder for each branch, prompts with their vectors.

    A stop without a last message reads its transcript; ``fallback`` gets the sessions that stop
    (content_session_id) and says what is known of them (content_session_id, content).  A batch that is
    repeated overwrites the folders of its number."""

    def batch(rows: DataFrame, n: int) -> None:
        silent = rows.filter("event = 'stop' and coalesce(last_assistant_message, '') = ''")
        known = None if fallback is None else fallback(silent.select(F.col("session_id").alias("content_session_id")).distinct())
        made = fan_out(rows, known, transcript_messages(silent.select(F.col("transcript_path").alias("path"))), **filters)
        for name in ("contexts", "sessions", "messages", "stops"):
            getattr(made, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")
        embed(made.prompts, "prompt", embedder).write.mode("overwrite").parquet(f"{out}/prompts/batch={n}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


#: What prompt numbering keeps: numbered prompts, and of each session how many there are.
NUMBERED = {"prompts": ("session_id string, received_at timestamp, prompt string, prompt_number bigint", "session_id"), "counts": ("session_id string, n bigint", "session_id")}
STRETCH = 3600  # seconds whose prompts of a session are ordered together


def numbered_prompts(prompts: DataFrame, counts: DataFrame) -> DataFrame:
    """A batch of (session_id, received_at, prompt) with prompt_number, behind the ``counts`` so far.

    A session is cut into stretches of time, so no task holds a session, however long it is."""
    stretch = F.floor(F.unix_timestamp("received_at") / STRETCH)
    return placed(prompts.select("session_id", "received_at", "prompt"), "session_id", stretch, ["received_at", "prompt"], "prompt_number", counts)


def number_batch(store: TableSet, prompts: DataFrame, batch: int | None = None) -> None:
    """Numbers a batch and commits it with the new counts; a batch that was committed is left alone."""
    base = store.manifest()
    if batch is not None and batch <= base.batch:
        return
    rows = prompts.filter("session_id is not null")
    parts = store.touched(rows, "counts")
    counts = store.read("counts", parts, base)
    new = rows.groupBy("session_id").agg(F.count("*").alias("n")).unionByName(counts).groupBy("session_id").agg(F.sum("n").alias("n"))
    store.commit(base, {"prompts": Change(numbered_prompts(rows, counts)), "counts": Change(new, parts)}, batch=batch)


def run_numbering(prompts: DataFrame, store: TableSet, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Numbers a stream of prompts into a store of ``NUMBERED`` tables."""
    return prompts.writeStream.foreachBatch(lambda rows, n: number_batch(store, rows, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Windows of activity per session that a pause ends; an extension, sessions proper are keyed."""
    return events.withWatermark("received_at", late).groupBy("session_id", F.session_window("received_at", gap)).agg(F.count("*").alias("events")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def without_replays(rows: DataFrame, late: str = "1 day") -> DataFrame:
    return rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def extracted(messages: DataFrame, sessions: DataFrame, extractor: Callable[[str], str], embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Observations of a batch of queue rows, and the outcome (id, error) of each row.

    Skipped observations have no row; a message fails without its session or with an answer that
    isn't JSON; a failed embedding leaves the vector null."""
    found = resolve_sessions(messages.filter("message_type = 'observation'"), sessions)
    p = lambda n: F.coalesce(F.get_json_object("payload", f"$.{n}"), F.lit(""))
    asked = found.withColumn("prompt", tool_prompt(p("tool_name"), p("tool_input"), p("tool_response"), p("cwd"), F.coalesce("project", F.lit(""))))
    answered = extract(asked, "prompt", extractor).withColumn("o", parse_observation(F.col("response")))
    outcome = answered.select("id", F.coalesce("error", F.when(F.col("o").isNull(), "invalid answer")).alias("error"))
    good = answered.filter("error is null and o is not null and not coalesce(o.skip, false)")
    made = good.select("id", "memory_session_id", "project", *[F.coalesce(f"o.{c}", F.lit("")).alias(c) for c in ("type", "title", "subtitle", "narrative")], *[F.coalesce(f"o.{c}", F.array().cast("array<string>")).alias(c) for c in ("facts", "concepts", "files_read", "files_modified")], "created_at")
    text = embedding_text(*map(F.col, ("title", "subtitle", "narrative")), facts=F.col("facts"))
    return embed(made.withColumn("__text", text), "__text", embedder).drop("__text"), outcome


def run_queue(messages: DataFrame, sessions: DataFrame, extractor: Callable[[str], str], embedder: Embedder, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Works through a stream of queue rows; each batch overwrites the folder of its number, so a
    repeated batch writes the same rows once."""

    def batch(rows: DataFrame, n: int) -> None:
        made, outcome = extracted(rows, sessions, extractor, embedder)
        made.write.mode("overwrite").parquet(f"{out}/observations/batch={n}")
        outcome.write.mode("overwrite").parquet(f"{out}/outcomes/batch={n}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
