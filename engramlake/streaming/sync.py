"""Synchronisation with another machine on a trigger: push, pull, and one commit for both.

A cycle reads one version of the tables, pushes a page of each and asks which rows were accepted,
pulls what others have changed, and commits marks, new rows, cursors and times together under the
number of its batch.  If it dies anywhere before that, nothing has changed here; the batch runs again,
the other side knows what it was sent by its sync_id, and the cursors still say what to pull."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import suppress
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.models import HttpError
from ..operators import changes
from ..sources import remote as remotes
from ..sources import schemas
from ..sources.remote import COLLECTIONS, HttpRemote
from ..sources.tables import Change, Conflict, Manifest, TableSet
from ..sources.versions import scratch_path

log = logging.getLogger(__name__)

SCHEMAS = {"sdk_sessions": schemas.SESSIONS, "observations": schemas.OBSERVATIONS, "session_summaries": schemas.SUMMARIES, "user_prompts": schemas.PROMPTS}
#: A row's part follows from its id, which pushes name; settings are few.
TABLES = {t: (s, "id") for t, s in SCHEMAS.items()} | {"settings": (schemas.SETTINGS, "key")}
RECEIPTS = "table_name string, id bigint, sync_id string, accepted boolean, error string"


def accepted_rows(remote: HttpRemote, body: str) -> Iterator[tuple[str, int, str, bool, str | None]]:
    """Pushes a document and tells of each of its rows whether the other side took it.

    The answer has counts alone.  If some rows were refused, the document's rows are sent again by
    halves, sessions first, until each answer is clear; what was taken before is taken again."""
    names = {c: t for t, c in COLLECTIONS.items()}
    whole = json.loads(body)
    machine = {"machine_id": whole["machine_id"]}

    def tell(collection: str, rows: list[dict], taken: bool) -> Iterator[tuple]:
        return ((names[collection], r.get("id"), r.get("sync_id"), taken, None) for r in rows)

    def halves(collection: str, rows: list[dict]) -> Iterator[tuple]:
        refused = remote.push(json.dumps(machine | {collection: rows}))["rejected"] if rows else 0
        if refused == 0 or refused == len(rows):
            yield from tell(collection, rows, refused == 0)
        else:
            yield from halves(collection, rows[: len(rows) // 2])
            yield from halves(collection, rows[len(rows) // 2 :])

    refused = remote.push(body)["rejected"]
    for collection in COLLECTIONS.values():
        rows = whole.get(collection, [])
        yield from tell(collection, rows, True) if refused == 0 else halves(collection, rows)


def push(tables: dict[str, DataFrame], remote: HttpRemote, limit: int = changes.PAGE) -> DataFrame:
    """Receipts of a push of at most ``limit`` waiting rows a table; without any it is sent all the same,
    as a sign of life.  A push that fails is a row with its error."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                try:
                    rows = list(accepted_rows(remote, body))
                except (OSError, HttpError) as error:
                    rows = [(None, None, None, False, str(error) or type(error).__name__)]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["table_name", "id", "sync_id", "accepted", "error"])

    return changes.push_body(tables, remote.machine, limit).mapInArrow(send, RECEIPTS)


def pull(spark: SparkSession, remote: HttpRemote, cursors: dict[str, int], **options: object) -> DataFrame:
    remotes.register(spark)
    reader = spark.read.format(remotes.NAME).option("url", remote.url).option("machine", remote.machine).option("key", remote.key).option("after", json.dumps(cursors))
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: answers of the other side are asked for once."""
    path = f"{scratch_path(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cycle(store: TableSet, remote: HttpRemote, batch: int | None = None, *, limit: int = changes.PAGE, now: datetime | None = None, **options: object) -> Manifest:
    """One push and one pull; a batch that was committed already does nothing.

    A failed push leaves its rows waiting, a failed pull leaves its cursors, and either lets the other
    go on; the next cycle tries again."""
    base = store.manifest()
    if batch is not None and batch <= base.batch:
        return base
    spark, now = store.spark, now or datetime.now(UTC)
    tables = {t: store.read(t, manifest=base) for t in SCHEMAS}
    settings = store.read("settings", manifest=base)
    done: list[tuple[str, str]] = []

    receipts = kept(push(tables, remote, limit), "receipts")
    failed = receipts.filter("error is not null").select("error").first()
    if failed is None:
        done.append(("last_push", now.strftime("%Y-%m-%dT%H:%M:%SZ")))
    else:
        log.warning("push failed: %s", failed["error"])

    pulled = spark.createDataFrame([], remotes.PULLED)
    try:
        pulled = kept(pull(spark, remote, changes.stored_cursors(settings), **options), "pulled")
        done.append(("last_pull", now.strftime("%Y-%m-%dT%H:%M:%SZ")))
    except (PySparkException, OSError, HttpError) as error:
        log.warning("pull failed: %s", error)

    seen = {r["collection"]: r["last"] for r in pulled.groupBy("collection").agg(F.max("id").alias("last")).collect()}  # a row a collection
    fresh = changes.imported({t: changes.table_rows(pulled, c, SCHEMAS[t]) for t, c in COLLECTIONS.items() if c in seen}, tables, base.next_id)
    taken = receipts.filter("accepted")
    marked = {r[0] for r in taken.select("table_name").distinct().collect()}
    changed, used = _added(base, fresh)
    for t in marked:
        own = taken.filter(F.col("table_name") == t)
        parts = store.touched(own, t)
        rows = changes.mark_synced(store.read(t, parts, base), own, int(now.timestamp()))
        # new rows of a part that is rewritten go with it, those of other parts are added to theirs
        changed[t] = Change(rows.unionByName(changed[t].rows) if t in changed else rows, parts)
    return _commit(store, base, changed, used, [*done, *((f"pull_cursor:{c}", str(last)) for c, last in seen.items())], batch)


def _added(base: Manifest, fresh: dict[str, DataFrame]) -> tuple[dict[str, Change], dict[str, int]]:
    """New rows as changes, and the ids they leave."""
    changed, used = {}, {}
    for t, rows in fresh.items():
        rows = kept(rows, t)
        if n := rows.count():
            changed[t], used[t] = Change(rows), base.next_id.get(t, 1) + n
    return changed, used


def _commit(store: TableSet, base: Manifest, changed: dict[str, Change], used: dict[str, int], written: list[tuple[str, str]], batch: int | None) -> Manifest:
    """Commits changes with settings that were written in this batch, of which there are few."""
    if written:
        settings = store.spark.createDataFrame([(*kv, 0) for kv in written], "key string, value string, seq long")
        parts = store.touched(settings, "settings")
        changed["settings"] = Change(changes.settings_upsert(store.read("settings", parts, base), settings), parts)
    return store.commit(base, changed, batch=batch, used_ids=used)


def run_sync(store: TableSet, remote: HttpRemote, checkpoint: str, interval: str = "60 seconds", **options: object) -> StreamingQuery:
    """A cycle each interval, as the batches of a stream that ticks; a batch that died runs again."""
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: cycle(store, remote, n, **options) and None).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def receive(store: TableSet, bodies: DataFrame, batch: int | None = None, now: datetime | None = None) -> Manifest:
    """The other end of a push: new rows of ``bodies(body)`` and when each machine pushed, in one commit.

    Machines are few: one row each goes through the driver."""
    base = store.manifest()
    if batch is not None and batch <= base.batch:
        return base
    at = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    local = {t: store.read(t, manifest=base) for t in SCHEMAS}
    fresh, machines = changes.received(bodies, local, SCHEMAS, base.next_id)
    changed, used = _added(base, fresh)
    return _commit(store, base, changed, used, [(f"client_push:{r[0]}", at) for r in machines.collect()], batch)  # a row a machine


def run_receiver(store: TableSet, bodies: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Receives a stream of pushes (``body``)."""
    return bodies.writeStream.foreachBatch(lambda rows, n: receive(store, rows, n) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def answer_pull(store: TableSet, requester: str, cursors: dict[str, int], limit: int = changes.PAGE, now: datetime | None = None) -> DataFrame:
    """A page of each collection for a requester, as (collection, id, row), read from the tables in
    force; when each machine pulled is kept."""
    base, at = store.manifest(), (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    for _ in range(5):  # others commit meanwhile; a time is worth a few tries, and no failed answer
        with suppress(Conflict):
            _commit(store, store.manifest(), {}, {}, [(f"client_pull:{requester}", at)], None)
            break
    pages = []
    for t, c in COLLECTIONS.items():
        page = changes.pull_page(store.read(t, manifest=base), requester, cursors.get(c, 0), limit)
        pages.append(page.select(F.lit(c).alias("collection"), "id", F.to_json(F.struct(*page.columns)).alias("row")))
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out
