"""Changes of tables as dataflows: upserts, queue states, synchronisation, legacy import.

Every function maps old rows and incoming rows to new rows; ``sources.versions`` writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import json_array_or_empty
from ..functions.scalar import epoch_seconds, parse_time
from ..sources.remote import COLLECTIONS

PAGE = 100


def upsert_sessions(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per content_session_id: of the first arrival, with the project of the last.

    ``incoming(content_session_id, project, started_at_epoch)``; old rows come first."""
    both = old.select("content_session_id", "project", "started_at_epoch", F.lit(0).alias("gen")).unionByName(incoming.select("content_session_id", "project", "started_at_epoch", F.lit(1).alias("gen")))
    at = F.struct("gen", "started_at_epoch", "project")
    return both.groupBy("content_session_id").agg(F.min_by("started_at_epoch", at).alias("started_at_epoch"), F.max_by("project", at).alias("project"))


def upsert_session_rows(old: DataFrame, incoming: DataFrame, new_id: Column) -> DataFrame:
    """Whole session rows after ``incoming(content_session_id, project, started_at_epoch)``.

    A known session keeps all of its row but the project, which is that of its last arrival; an
    unknown one begins, active, with its first arrival and the memory session ``new_id``.  Its id is
    a hash of content_session_id, for no sequence is at hand that tasks could share."""
    at = F.struct("started_at_epoch", "project")
    arrived = incoming.groupBy("content_session_id").agg(F.min("started_at_epoch").alias("__start"), F.max_by("project", at).alias("__project"))
    both = old.withColumn("__known", F.lit(True)).join(arrived, "content_session_id", "full")
    fresh = F.col("__known").isNull()
    first = {"id": F.xxhash64("content_session_id"), "memory_session_id": new_id, "started_at_epoch": F.col("__start"), "status": F.lit("active"), "sync_version": F.lit(0).cast("long")}
    first |= {"started_at": F.timestamp_seconds("__start")} if "started_at" in old.columns else {}
    filled = {c: F.when(fresh, v).otherwise(F.col(c)) for c, v in first.items()}
    return both.withColumns(filled | {"project": F.coalesce("__project", "project")}).select(*old.columns)


def complete_sessions(sessions: DataFrame, stops: DataFrame) -> DataFrame:
    """Sessions with a stop event (content_session_id, at_epoch) are completed at the latest one."""
    last = stops.groupBy("content_session_id").agg(F.max("at_epoch").alias("__at"))
    out = sessions.join(last, "content_session_id", "left")
    hit = F.col("__at").isNotNull()
    return out.withColumns({"status": F.when(hit, "completed").otherwise(F.col("status")), "completed_at_epoch": F.when(hit, F.col("__at")).otherwise(F.col("completed_at_epoch"))}).drop("__at").select(*sessions.columns)


def new_rows(incoming: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows whose key isn't known; a null in the key is never known.  Of rows with the same
    key the first by id stays."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)
    # rows without a whole key are dealt by their id, lest they all meet in one partition
    order = Window.partitionBy(*keys, F.when(~whole, F.xxhash64("id"))).orderBy("id")
    return fresh.withColumn("__n", F.row_number().over(order)).filter(~whole | (F.col("__n") == 1)).drop("__n")


def settings_upsert(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """The last write (seq) of each key wins over the old value."""
    both = old.select("key", "value", F.lit(-1).cast("long").alias("seq")).unionByName(incoming.select("key", "value", F.col("seq").cast("long").alias("seq")))
    return both.groupBy("key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))


def apply_embeddings(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with the vector (id, embedding) that arrived for them, else their own."""
    new = vectors.select("id", F.col("embedding").alias("__new"))
    return rows.join(new, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new").select(*rows.columns)


# queue


def claim_oldest(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.filter("status = 'pending'").orderBy("created_at", "id").limit(n)


def queue_outcome(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Messages with a result (id, error) are completed, or failed with its error."""
    out = queue.join(results.select("id", F.col("error").alias("__error"), F.lit(True).alias("__done")), "id", "left")
    status = F.when(F.col("__done").isNull(), F.col("status")).when(F.col("__error").isNull(), "completed").otherwise("failed")
    return out.withColumns({"status": status, "error": F.coalesce("__error", "error")}).drop("__error", "__done").select(*queue.columns)


def resolve_sessions(queue: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each message with its session, or with an error if there is none."""
    out = queue.join(sessions.select("content_session_id", "memory_session_id", "project"), "content_session_id", "left")
    return out.withColumn("error", F.when(F.col("memory_session_id").isNull(), F.concat(F.lit("session not found: "), F.col("content_session_id"))))


# synchronisation


def first_by_id(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows by id.  Ids are ranked alone, so that of other rows nothing else is moved or joined."""
    first = rows.select("id").orderBy("id").limit(limit)
    return rows.join(F.broadcast(first), "id", "left_semi").select(*rows.columns).orderBy("id").limit(limit)


def unsynced(df: DataFrame, limit: int = PAGE) -> DataFrame:
    return first_by_id(df.filter("sync_id is not null and sync_version = 0"), limit)


def pull_page(df: DataFrame, requester: str, cursor: int, limit: int = PAGE) -> DataFrame:
    """The next rows after a cursor that didn't come from the requester; a null source is no one's."""
    return first_by_id(df.filter((F.col("id") > cursor) & ~F.col("sync_source").eqNullSafe(requester)), limit)


def pull_cursors(pages: dict[str, DataFrame]) -> DataFrame:
    """Where the next pages begin; a table without rows has no new cursor."""
    parts = [p.agg(F.lit(t).alias("table_name"), F.max("id").alias("cursor"), F.count("*").alias("rows")) for t, p in pages.items()]
    return reduce(DataFrame.unionByName, parts)


def mark_synced(df: DataFrame, sync_ids: DataFrame, version: int) -> DataFrame:
    """Sets the version of rows whose sync_id is listed (accepted by the other side)."""
    known = sync_ids.filter("sync_id is not null").select("sync_id").distinct().withColumn("__hit", F.lit(True))
    out = df.join(known, "sync_id", "left")
    return out.withColumn("sync_version", F.when(F.col("__hit"), F.lit(version).cast("long")).otherwise(F.col("sync_version"))).drop("__hit").select(*df.columns)


def push_body(tables: dict[str, DataFrame], machine: str, limit: int = PAGE) -> DataFrame:
    """One row: the JSON document of a push, at most ``limit`` waiting rows of each table with all
    their columns, vectors too.  Without any row it is still sent, as a sign of life."""
    parts = [unsynced(df, limit).select(F.lit(t).alias("table_name"), "id", F.to_json(F.struct(*df.columns)).alias("row")) for t, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    lists = []
    for t in tables:
        own = F.array_sort(F.collect_list(F.when(F.col("table_name") == t, F.struct("id", "row"))))  # at most limit rows
        lists += [F.lit(f',"{COLLECTIONS[t]}":['), F.array_join(F.transform(own, lambda r: r["row"]), ","), F.lit("]")]
    name = F.to_json(F.struct(F.lit(machine).alias("machine_id")))
    return rows.agg(F.concat(F.expr("'{'"), F.substring(name, F.lit(2), F.length(name) - 2), *lists, F.lit("}")).alias("body"))


def pushed_rows(bodies: DataFrame) -> DataFrame:
    """machine_id, table_name and row (JSON) of the documents of pushes; empty collections have none."""
    # all collections of a body in one pass, so that a body is made, and read, once
    listed = F.array(*[F.struct(F.lit(t).alias("table_name"), F.from_json(F.get_json_object("body", f"$.{name}"), "array<string>").alias("rows")) for t, name in COLLECTIONS.items()])
    tables = bodies.select(F.get_json_object("body", "$.machine_id").alias("machine_id"), F.explode(listed).alias("t"))
    return tables.select("machine_id", "t.table_name", F.explode("t.rows").alias("row"))


def stored_cursors(settings: DataFrame) -> dict[str, int]:
    """Where each collection's next pull begins, as the settings say; a row a collection."""
    keys = {f"pull_cursor:{c}": c for c in COLLECTIONS.values()}
    rows = settings.filter(F.col("key").isin(list(keys))).select("key", F.col("value").try_cast("long").alias("at")).collect()
    return dict.fromkeys(COLLECTIONS.values(), 0) | {keys[r.key]: r["at"] for r in rows if r["at"] is not None}


def table_rows(rows: DataFrame, collection: str, schema: str) -> DataFrame:
    """The rows of one collection of ``rows(collection, row)``, JSON objects, as a table's."""
    parsed = rows.filter(F.col("collection") == collection).select(F.from_json("row", schema).alias("r"))
    return parsed.filter("r is not null").select("r.*")


# fixed values: what an import must not repeat, and what it must refer to
UNIQUE = {"sdk_sessions": [("sync_id",), ("content_session_id",), ("memory_session_id",)], "observations": [("sync_id",)], "session_summaries": [("sync_id",)], "user_prompts": [("sync_id",), ("content_session_id", "prompt_number")]}
REFERS = {"observations": "memory_session_id", "session_summaries": "memory_session_id", "user_prompts": "content_session_id"}


def imported(incoming: dict[str, DataFrame], local: dict[str, DataFrame], next_id: dict[str, int]) -> dict[str, DataFrame]:
    """Of each table the rows of other machines that are new here, with ids of our own.

    Sessions go first: rows of the other tables whose session is known neither before nor among
    them are refused.  A row that would repeat a key is no new one; nulls repeat nothing.  Ids go on from
    ``next_id`` in the order of the ids over there, so that cursors of others pass none by."""
    out, sessions = {}, local["sdk_sessions"].select("memory_session_id", "content_session_id")
    for table in sorted(incoming, key=lambda t: t != "sdk_sessions"):
        rows = incoming[table]
        if table in REFERS:
            known = sessions.select(REFERS[table]).distinct()
            rows = rows.join(known, REFERS[table], "left_semi").select(*rows.columns)
        for keys in UNIQUE[table]:
            rows = new_rows(rows, local[table], *keys)
        if table == "sdk_sessions":
            sessions = sessions.unionByName(rows.select("memory_session_id", "content_session_id"))
        out[table] = with_ids(rows, next_id.get(table, 1))
    return out


def with_ids(rows: DataFrame, first: int) -> DataFrame:
    """New ids from ``first`` on, in the order of the old ones, without bringing all rows together: ids
    are cut into ranges, and a range begins behind all rows of the ranges before it."""
    spans = rows.withColumn("__span", F.floor(F.col("id") / 4096))
    counts = spans.groupBy("__span").agg(F.count("*").alias("__n"))
    # counts of 4,096 ids each, summed by blocks of spans and then within them
    block = F.floor(F.col("__span") / 4096)
    blocks = counts.groupBy(block.alias("__block")).agg(F.sum("__n").alias("__m"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 16 million ids
    blocks = blocks.select("__block", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__block").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__block", block).join(blocks, "__block").select("__span", (F.col("__base") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__span").orderBy("id"))
    return spans.join(counts, "__span").withColumn("id", F.lit(first - 1).cast("long") + F.col("__base") + place).select(*rows.columns)


def received(bodies: DataFrame, local: dict[str, DataFrame], schemas: dict[str, str], next_id: dict[str, int]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Pushes of other machines (``body``): the new rows of each table, and the machines that pushed."""
    rows = pushed_rows(bodies).withColumn("collection", collection_of(F.col("table_name")))
    fresh = imported({t: table_rows(rows, c, schemas[t]) for t, c in COLLECTIONS.items()}, local, next_id)
    return fresh, bodies.select(F.get_json_object("body", "$.machine_id").alias("machine")).filter("machine <> ''").distinct()


def collection_of(table: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair]), table)


def sync_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table its rows and those still to be pushed."""
    waiting = F.count_if(F.col("sync_id").isNotNull() & (F.col("sync_version") == 0))
    return reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("table_name"), F.count("*").alias("total"), waiting.alias("unsynced")) for t, df in tables.items()])


def client_sync_times(settings: DataFrame) -> DataFrame:
    """Per machine its last push and pull, from keys client_push:<machine> and client_pull:<machine>."""
    at = F.try_to_timestamp("value")
    rows = settings.filter((F.col("key").startswith("client_push:") | F.col("key").startswith("client_pull:")) & (F.length("key") > 12) & at.isNotNull())
    kind = F.substring("key", 8, 4)
    rows = rows.select(F.substring(F.col("key"), F.lit(13), F.length("key")).alias("machine_id"), kind.alias("kind"), at.alias("at"))
    return rows.groupBy("machine_id").agg(F.max(F.when(F.col("kind") == "push", F.col("at"))).alias("last_push"), F.max(F.when(F.col("kind") == "pull", F.col("at"))).alias("last_pull"))


def import_counts(incoming: DataFrame, sessions: DataFrame) -> DataFrame:
    """received counts every row whose session exists, known ones too; rejected the others."""
    known = sessions.select("memory_session_id").distinct().withColumn("__ok", F.lit(True))
    rows = incoming.join(known, "memory_session_id", "left")
    return rows.agg(F.count_if(F.col("__ok").isNotNull()).alias("received"), F.count_if(F.col("__ok").isNull()).alias("rejected"))


def orphans(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return rows.join(sessions, "memory_session_id", "left_anti").select(*rows.columns)


def default_source(df: DataFrame, settings: DataFrame) -> DataFrame:
    """A missing sync_source is this machine's id, or unknown."""
    machine = settings.filter("key = 'machine_id'").agg(F.max("value").alias("__machine"))
    return df.crossJoin(machine).withColumn("sync_source", F.coalesce("sync_source", "__machine", F.lit("unknown"))).drop("__machine")  # one row


# legacy import


def legacy_sessions(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """Sessions of an older store: millisecond epochs, times as text; known ones stay out."""
    start, end = epoch_seconds(F.col("started_at_epoch")), epoch_seconds(F.col("completed_at_epoch"))
    made = raw.withColumns({"started_at": parse_time(F.col("started_at"), start), "started_at_epoch": start, "completed_at": parse_time(F.col("completed_at")), "completed_at_epoch": end})
    return new_rows(made, existing, "content_session_id")


def legacy_rows(raw: DataFrame, existing: DataFrame, lists: tuple[str, ...]) -> DataFrame:
    """Observations or summaries of an older store: lists as JSON text, which must be valid."""
    at = epoch_seconds(F.col("created_at_epoch"))
    made = raw.withColumns({"created_at": parse_time(F.col("created_at"), at), "created_at_epoch": at} | {c: json_array_or_empty(F.col(c)) for c in lists})
    return new_rows(made, existing, "sync_id")


def legacy_prompts(raw: DataFrame, sessions: DataFrame, existing: DataFrame) -> DataFrame:
    """Prompts of an older store take the project of their session; those without one are lost."""
    made = raw.join(sessions.select("content_session_id", "project"), "content_session_id")
    made = made.withColumn("created_at_epoch", epoch_seconds(F.col("created_at_epoch"))).withColumnRenamed("prompt_text", "prompt")
    return new_rows(made, existing, "content_session_id", "prompt_number")


def import_verify(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Per table the rows on both sides, and whether none is missing."""
    parts = [source[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("source_rows"), F.lit(0).cast("long").alias("target_rows")).unionByName(target[t].agg(F.lit(t).alias("table_name"), F.lit(0).cast("long").alias("source_rows"), F.count("*").alias("target_rows"))) for t in source]
    rows = reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))
    return rows.withColumn("complete", F.col("target_rows") >= F.col("source_rows"))


def overlay_settings(defaults: dict[str, str], stored: DataFrame, env: dict[str, str]) -> DataFrame:
    """Each known key with the value of the environment, else the stored one, else the default; stored
    values of number settings that are no numbers don't count."""
    spark = stored.sparkSession
    base = spark.createDataFrame([(k, v, env.get(k)) for k, v in defaults.items()], "key string, fallback string, env string")
    kept = base.join(stored.select("key", "value"), "key", "left")
    number = F.col("fallback").rlike("^[0-9]+$")
    value: Column = F.when(number & F.col("value").try_cast("int").isNull(), None).otherwise(F.col("value"))
    return kept.select("key", F.coalesce("env", F.when(value != "", value), "fallback").alias("value"))


def log_tail(lines: DataFrame, n: int, least: str | None = None) -> DataFrame:
    """The last n log lines (seq, level, message) of a level at least, oldest first."""
    from ..functions.scalar import level_reaches

    rows = lines if least is None else lines.filter(level_reaches(F.col("level"), F.lit(least)))
    return rows.orderBy(F.desc("seq")).limit(n).orderBy("seq")
