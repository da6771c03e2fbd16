"""Sessions in state, prompts that are counted, transcripts that are read at a stop."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from engramlake.functions.models import HashEmbedder
from engramlake.operators import context
from engramlake.operators.numbering import placed
from engramlake.sources.tables import TableSet
from engramlake.streaming import ingest, lifecycle

AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def minutes(n):
    return (AT + datetime.timedelta(minutes=n)).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_lives_of_sessions(spark, tmp_path):
    """Batches with a restart between them: timers and states outlive the query."""
    (tmp_path / "in").mkdir()
    lifecycle.state_store(spark)

    def feed(n, rows):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"session_id": s, "event": e, "received_at": minutes(m), "project": p}) for s, e, m, p in rows))
        events = spark.readStream.schema("session_id string, event string, received_at timestamp, project string").json(str(tmp_path / "in"))
        told = lifecycle.session_lives(events, datetime.timedelta(hours=1), "0 seconds")
        told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        rows = spark.read.parquet(str(tmp_path / "out"))
        last = rows.groupBy("session_id").agg(F.max_by(F.struct("status", "ended_by", "project", F.date_format("started_at", "HH:mm").alias("a"), F.date_format("ended_at", "HH:mm").alias("z")), "version").alias("r"))
        return {r.session_id: tuple(r.r) for r in last.collect()}

    first = feed(0, [("a", "post-tool-use", 5, "p"), ("a", "prompt-submit", 2, "q"), ("b", "prompt-submit", 10, "p"), ("b", "stop", 20, None), ("c", "stop", 1, None), ("d", "session-start", 1, "p"), (None, "stop", 1, None), ("e", "prompt-submit", 30, "p")])
    assert first == {"a": ("active", None, "p", "00:02", None), "b": ("completed", "stop", "p", "00:10", "00:20"), "e": ("active", None, "p", "00:30", None)}
    # an hour after a's last work its timer runs out, e goes on
    second = feed(1, [("e", "post-tool-use", 80, "r"), ("b", "stop", 75, None)])
    assert second == {"a": ("completed", "silence", "p", "00:02", "01:05"), "b": ("completed", "stop", "p", "00:10", "01:15"), "e": ("active", None, "r", "00:30", None)}
    third = feed(2, [("a", "post-tool-use", 90, "p"), ("f", "prompt-submit", 139, "p"), ("e", "stop", 139, None)])
    assert third["a"] == ("active", None, "p", "00:02", None) and third["e"] == ("completed", "stop", "r", "00:30", "02:19")
    fourth = feed(3, [("g", "prompt-submit", 200, "p")])
    assert fourth["a"] == ("completed", "silence", "p", "00:02", "02:30") and fourth["f"] == ("completed", "silence", "p", "02:19", "03:19") and fourth["g"][0] == "active"


def test_a_long_session_is_counted_in_pieces(spark, tmp_path):
    store = TableSet(spark, str(tmp_path), ingest.NUMBERED, parts=4)
    prompts = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, "other").otherwise("long").alias("session_id"), F.timestamp_seconds(F.col("id") * 7 % 200_000 + 1_700_000_000).alias("received_at"), F.col("id").cast("string").alias("prompt"))
    ingest.number_batch(store, prompts.filter("id < 150000").drop("id"), 0)
    ingest.number_batch(store, prompts.filter("id < 150000").drop("id"), 0)  # a batch again
    ingest.number_batch(store, prompts.filter("id >= 150000").drop("id"), 1)
    got = store.read("prompts")
    assert {r.session_id: (r.n, r.d, r.m) for r in got.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("prompt_number").alias("d"), F.max("prompt_number").alias("m")).collect()} == {"long": (180_000,) * 3, "other": (20_000,) * 3}
    first = got.filter("session_id = 'long' and prompt_number <= 135000")
    assert first.filter("cast(prompt as int) >= 150000").count() == 0
    wrong = first.selectExpr("received_at", "lag(received_at) over (partition by floor(prompt_number / 1000) order by prompt_number) as b").filter("b > received_at")
    assert wrong.count() == 0


def test_places_with_ties_and_nulls(spark):
    rows = [(g, t, i) for i, (g, t) in enumerate([("a", 5), ("a", 5), ("a", 90), ("a", None), ("b", 1), (None, 3), (None, 2), ("a", -70)])]
    df = spark.createDataFrame(rows, "g string, t int, i int")
    start = spark.createDataFrame([("b", 10)], "g string, n long")
    got = {r.i: r.n for r in placed(df, "g", F.floor(F.col("t") / 10), ["t", "i"], "n", start).collect()}
    assert got == {3: 1, 7: 2, 0: 3, 1: 4, 2: 5, 4: 11, 6: 1, 5: 2}


def test_fallback_lines_of_the_sessions_asked_for(spark):
    sessions = spark.createDataFrame([("c1", "m1"), ("c2", "m2"), ("c3", "m3")], "content_session_id string, memory_session_id string")
    prompts = spark.createDataFrame([("c1", 2, 8, "second"), ("c1", 1, 9, "first"), ("c4", 1, 1, "none")], "content_session_id string, prompt_number long, id long, prompt string")
    work = spark.createDataFrame([("m1", 50, 3, "bugfix", "t", None), ("m1", 9000, 1, "change", None, "n"), ("m2", 1, 5, "feature", "u", "v")], "memory_session_id string, created_at_epoch long, id long, type string, title string, narrative string")
    got = {r.content_session_id: r.content for r in context.fallback_summaries(sessions, prompts, work).collect()}
    assert got == {"c1": "## User Prompts\n- first\n- second\n\n## Session Activity\n- [bugfix] t: \n- [change] : n", "c2": "\n## Session Activity\n- [feature] u: v", "c3": ""}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_stop_reads_its_transcript(spark, tmp_path, scheme):
    say = lambda role, text: json.dumps({"type": role, "message": {"role": role, "content": text}})
    (tmp_path / "t1.jsonl").write_text("\n".join([say("assistant", "one"), say("user", "assistant?"), "{broken assistant", say("assistant", "é two")]))
    (tmp_path / "t2.jsonl").write_text(say("user", "nothing said"))
    (tmp_path / "t3.jsonl").write_text("\n".join([say("assistant", "kept"), say("assistant", "x" * (11 * 1024 * 1024))]))
    stop = lambda s, **more: ("stop", AT, json.dumps({"session_id": s, "cwd": "/w/app"} | more))
    path = lambda n: f"{scheme}{tmp_path}/{n}.jsonl"
    rows = [stop("s1", transcript_path=path("t1")), stop("s2", transcript_path=path("t2")), stop("s3", transcript_path=path("missing")), stop("s4"), stop("s5", transcript_path=path("t1"), last_assistant_message="own"), stop("s6", transcript_path=path("t3"))]
    spark.createDataFrame(rows, "event string, received_at timestamp, payload string").write.json(f"{tmp_path}/in")

    def known(asked):
        return asked.filter("content_session_id in ('s2', 's3')").withColumn("content", F.concat(F.lit("of "), "content_session_id"))

    q = ingest.run_hooks(ingest.hook_stream(spark, f"{tmp_path}/in"), HashEmbedder(8), f"{tmp_path}/out", f"{tmp_path}/cp", fallback=known, trigger={"availableNow": True})
    q.awaitTermination(180)
    got = {r.content_session_id: json.loads(r.payload)["last_assistant_message"] for r in spark.read.parquet(f"{tmp_path}/out/messages").collect()}
    assert got == {"s1": "é two", "s2": "of s2", "s3": "of s3", "s5": "own", "s6": "kept"}
    assert spark.read.parquet(f"{tmp_path}/out/stops").count() == 6
