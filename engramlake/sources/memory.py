"""The logical tables of a memory, derived from the driver's Parquet tables, and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json import clean_message, transcript_role, transcript_text

EPOCH0 = 1704067200  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sync(at: str) -> dict[str, Column]:
    i = F.col("id")
    return {
        "sync_id": F.when(i % 11 != 0, F.concat(F.lit("m"), (i % 3).cast("string"), F.lit(":"), i.cast("string"))),
        "sync_version": F.when(i % 5 == 0, F.lit(0).cast("long")).otherwise(F.col(at)),
        "sync_source": F.when(i % 7 != 0, F.concat(F.lit("m"), (i % 3).cast("string"))),
    }


def observations(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """With their vectors, which come by a join; whoever asks for none is spared it."""
    d = read(spark, sf_dir, "documents")
    if vectors:
        e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        d = d.join(e, d.doc_id == e.vec_id, "left")
    i = F.col("id")
    name = lambda n: F.concat(F.lit("src/"), F.col("project"), F.lit("/f"), (i % n).cast("string"), F.lit(".go"))
    rows = d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 97).cast("string")).alias("memory_session_id"),
        F.col("source").alias("project"),
        F.col("lang").alias("type"),
        F.when(F.col("doc_id") % 13 != 0, F.substring("text", 1, 80)).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.substring("text", 81, 40)).alias("subtitle"),
        F.col("text").alias("narrative"),
        F.lit(None).cast("string").alias("text"),
        (F.lit(EPOCH0) + F.col("doc_id") * 600).alias("created_at_epoch"),
        *(["embedding"] if vectors else []),
    )
    rows = rows.withColumns({"created_at": F.timestamp_seconds("created_at_epoch"), "files_read": F.array(name(11)), "files_modified": F.when(i % 4 != 0, F.array(name(7), name(5))), "facts": F.when(i % 2 == 0, F.array(F.col("type"), F.col("project")))})
    return rows.withColumns(_sync("created_at_epoch"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.withColumns({"content_session_id": F.concat(F.lit("c"), F.col("conv_id").cast("string")), "memory_session_id": F.concat(F.lit("m"), F.col("conv_id").cast("string")), "project": F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")), "epoch": F.lit(EPOCH0) + F.col("conv_id") * 3600 + F.col("turn") * 60})


def user_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).filter("role = 'user'")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "content_session_id", "project", F.col("text").alias("prompt"), F.row_number().over(order).cast("long").alias("prompt_number"), F.col("epoch").alias("created_at_epoch"), F.lit(None).cast("array<float>").alias("embedding"))
    return rows.withColumns(_sync("created_at_epoch"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("id"), "content_session_id", "memory_session_id", "project")
    rows = by.agg(F.min("epoch").alias("started_at_epoch"), F.max("epoch").alias("__last"), F.max_by("role", "turn").alias("__role"))
    done = F.col("__role") == "assistant"
    rows = rows.withColumns({"status": F.when(done, "completed").otherwise("active"), "completed_at_epoch": F.when(done, F.col("__last"))}).drop("__last", "__role")
    return rows.withColumns(_sync("started_at_epoch"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _turns(spark, sf_dir).filter("role = 'assistant'").groupBy(F.col("conv_id").alias("id"), "memory_session_id", "project")
    rows = by.agg(F.max_by("text", "turn").alias("__text"), (F.max("epoch") + 1).alias("created_at_epoch"))
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    none = F.lit(None).cast("string")
    rows = rows.join(e, "id", "left").withColumns({"request": F.substring("__text", 1, 60), "investigated": none, "learned": F.col("__text"), "completed": F.when(F.col("id") % 3 != 0, F.substring("__text", 61, 60)), "next_steps": F.substring("__text", 121, 40), "notes": none, "files_read": F.when(F.col("id") % 2 == 0, F.array("project")), "files_edited": F.lit(None).cast("array<string>"), "created_at": F.timestamp_seconds("created_at_epoch")}).drop("__text")
    return rows.withColumns(_sync("created_at_epoch"))


def pending_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "summary").when(F.col("event_type") == "signup", "continuation").otherwise("observation")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("content_session_id"), kind.alias("message_type"), F.col("props").alias("payload"), status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), F.lit(None).cast("string").alias("error"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("key", F.concat(F.when(F.col("event_type") == "view", "client_pull:u").when(F.col("event_type") == "click", "client_push:u").otherwise("pull_cursor:u"), F.col("user_id").cast("string")))
    times = e.groupBy("key").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"))
    return times.unionByName(spark.range(1).select(F.lit("machine_id").alias("key"), F.lit("m1").alias("value")))


def last_assistant_messages(lines: DataFrame) -> DataFrame:
    """Of transcripts as JSON lines (path, line_no, value) the last assistant text, reminders removed.

    Lines that aren't JSON are skipped; a last text that is nothing but reminders gives ''."""
    said = lines.filter(F.try_parse_json("value").isNotNull()).withColumns({"role": transcript_role(F.col("value")), "text": transcript_text(F.col("value"))})
    said = said.filter("role = 'assistant' and text != ''")
    return said.groupBy("path").agg(clean_message(F.max_by("text", "line_no")).alias("message"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines transcripts as (path, line_no, value); line_no orders the lines of a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), "value")
    return rows.select("path", F.struct("__b", "__i").alias("line_no"), "value")
