"""Upserts, imports, transcripts, versions and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from engramlake.functions.models import HashEmbedder, stub_extractor
from engramlake.operators import changes, context, lists, search
from engramlake.sources import memory
from engramlake.sources.tables import TableSet
from engramlake.sources.versions import VersionedTable
from engramlake.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_import_twice_is_once(spark):
    s = "id long, sync_id string"
    page = frame(spark, [(1, "a"), (2, "a"), (3, None), (4, "b")], s)
    first = changes.new_rows(page, frame(spark, [], s), "sync_id")
    assert sorted(r.id for r in first.collect()) == [1, 3, 4]
    again = changes.new_rows(page, first, "sync_id")
    assert [r.id for r in again.collect()] == [3]  # a null key is never known


def test_hybrid_scores_beyond_the_fetched_neighbours(spark):
    rows = [(i, "t", "x" if i != 9 else "needle", None, None, None, "p", None, [1.0, float(i)]) for i in range(10)]
    obs = frame(spark, rows, "id long, type string, title string, subtitle string, narrative string, text string, project string, created_at timestamp, embedding array<float>")
    got = {r.id: r for r in search.hybrid_search(obs, "needle", [1.0, 0.0], "p", limit=1).collect()}
    assert set(got) == {0}  # the closest; the text hit has no semantic score
    wide = {r.id: r for r in search.hybrid_search(obs, "needle", [1.0, 0.0], "p", limit=3).collect()}
    assert 9 not in wide and search.hybrid_search(obs, "needle", [1.0, 0.0], "").count() == 0


def test_marking_and_cursors(spark):
    df = frame(spark, [(1, "a", 0, "m1"), (2, "b", 0, None), (3, None, 0, "m2")], "id long, sync_id string, sync_version long, sync_source string")
    assert [r.id for r in changes.unsynced(df).collect()] == [1, 2]
    marked = changes.mark_synced(df, frame(spark, [("a",), (None,)], "sync_id string"), 5)
    assert {r.id: r.sync_version for r in marked.collect()} == {1: 5, 2: 0, 3: 0}
    assert [r.id for r in changes.pull_page(df, "m1", 0).collect()] == [2, 3]
    assert changes.pull_cursors({"t": changes.pull_page(df, "m1", 9)}).first().cursor is None


def test_context_of_nothing_is_empty(spark, sf_dir):
    none = memory.observations(spark, sf_dir).filter("false")
    recent = lists.recent_observations(none, memory.sessions(spark, sf_dir), memory.user_prompts(spark, sf_dir))
    assert context.markdown(recent, lists.recent_summaries(memory.summaries(spark, sf_dir).filter("false"))).first().context == ""


def test_transcripts(spark, tmp_path):
    say = lambda role, content: json.dumps({"type": role, "message": {"role": role, "content": content}})
    (tmp_path / "a.jsonl").write_text("\n".join([say("assistant", "first"), "{broken", say("assistant", [{"type": "text", "text": "last"}, {"type": "tool_use"}]), say("user", "x")]))
    (tmp_path / "b.jsonl").write_text("\n".join([say("assistant", "x"), say("assistant", "<system-reminder>r</system-reminder>")]))
    got = {r.path.rpartition("/")[2]: r.message for r in memory.last_assistant_messages(memory.read_transcripts(spark, str(tmp_path))).collect()}
    assert got == {"a.jsonl": "last", "b.jsonl": ""}


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "key string, value string")
    assert t.version() == 0 and t.read().count() == 0
    t.write(frame(spark, [("a", "1")], t.schema))
    t.write(changes.settings_upsert(t.read(), frame(spark, [("a", "2", 1), ("b", "3", 2)], "key string, value string, seq long")))
    assert t.version() == 2 and {r.key: r.value for r in t.read().collect()} == {"a": "2", "b": "3"}


def events(tmp_path, rows):
    (tmp_path / "in").mkdir()
    for n, r in enumerate(rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(x) for x in r))
    return str(tmp_path / "in")


def test_prompt_stream_counts_on(spark, tmp_path):
    rows = [[{"event": "prompt-submit", "received_at": f"2024-01-01T00:0{i}:00Z", "payload": json.dumps({"sessionId": s, "input": f"p{i}"})}] for i, s in enumerate(["a", "a", "b", "a"])]
    stream = ingest.hook_stream(spark, events(tmp_path, rows), per_batch=1)
    store = TableSet(spark, str(tmp_path / "store"), ingest.NUMBERED)
    ingest.run_numbering(stream, store, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    got = {(r.session_id, r.prompt): r.prompt_number for r in store.read("prompts").collect()}
    assert sorted(n for (s, _), n in got.items() if s == "a") == [1, 2, 3] and got["b", "p2"] == 1


def test_queue_stream(spark, tmp_path):
    call = lambda s, tool: {"event": "post-tool-use", "received_at": "2024-01-01T00:00:00Z", "payload": json.dumps({"session_id": s, "tool_name": tool, "tool_input": {"a": 1}, "cwd": "/w/proj"})}
    stream = ingest.hook_stream(spark, events(tmp_path, [[call("s1", "Edit"), call("s1", "Read"), call("lost", "Edit"), call("", "Edit")]]))
    messages = ingest.queue_messages(ingest.accepted_tools(stream, skip="read"))
    sessions = frame(spark, [("s1", "m1", "proj")], "content_session_id string, memory_session_id string, project string")
    ingest.run_queue(messages, sessions, stub_extractor, HashEmbedder(4), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    made = spark.read.parquet(str(tmp_path / "out/observations/*")).collect()
    assert [(r.memory_session_id, r.title, len(r.embedding)) for r in made] == [("m1", "Used Edit", 4)]
    errors = sorted(str(r.error) for r in spark.read.parquet(str(tmp_path / "out/outcomes/*")).collect())
    assert errors == ["None", "session not found: lost"]


def test_batch_and_stream_agree_on_acceptance(spark):
    raw = frame(spark, [("post-tool-use", None, '{"session_id":"s","tool_name":"Edit","cwd":"/w/secret"}'), ("post-tool-use", None, '{"session_id":"s","tool_name":"Edit","cwd":"/w/open"}')], "event string, received_at timestamp, payload string")
    assert [r.project for r in ingest.accepted_tools(ingest.normalized(raw), deny="SECRET").collect()] == ["open"]


def test_stats_of_empty_tables(spark, sf_dir):
    o, u, s = (f(spark, sf_dir).filter(F.lit(False)) for f in (memory.observations, memory.summaries, memory.sessions))
    assert tuple(lists.stats(o, u, s).first()) == (0, 0, 0)


def test_retry_of_what_may_pass():
    from engramlake.functions.models import HttpError, with_retry

    waits, errors = [], [HttpError(429), HttpError(503), ConnectionError()]

    def call():
        if errors:
            raise errors.pop(0)
        return "done"

    assert with_retry(call, sleep=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(HttpError):
        with_retry(lambda: (_ for _ in ()).throw(HttpError(400)), sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0]


def test_neighbours_by_hashing_reach_the_exact_ones(spark):
    sf = "/root/testdata/sf0.01"
    rows = memory.observations(spark, sf).filter("embedding is not null").cache()
    reached = []
    for r in rows.orderBy("id").limit(40).collect()[::8]:
        exact = {x.id for x in search.nearest(rows, list(r.embedding), 10).collect()}
        reached.append(len(exact & {x.id for x in search.lsh_nearest(rows, list(r.embedding), 10).collect()}) / len(exact))
    assert sum(reached) / len(reached) >= 0.9


def test_hooks_as_a_stream(spark, tmp_path):
    lines = [
        ("session-start", '{"session_id": "s1", "cwd": "/w/app"}'),
        ("prompt-submit", '{"sessionId": "s1", "cwd": "/w/app", "input": "do it"}'),
        ("prompt-submit", '{"session_id": "s1", "cwd": "/w/app", "prompt": " "}'),
        ("prompt-submit", '{"cwd": "/w/app", "prompt": "no session"}'),
        ("post-tool-use", '{"session_id": "s1", "cwd": "/w/app", "toolName": "Edit", "toolInput": {"cmd": "x"}}'),
        ("stop", '{"session_id": "s1", "cwd": "/w/app", "lastAssistantMessage": "done"}'),
        ("stop", '{"session_id": "s2", "cwd": "/w/app"}'),
        ("stop", '{"session_id": "s3", "cwd": "/w/secret", "lastAssistantMessage": "x"}'),
    ]
    raw = spark.createDataFrame([(e, datetime.datetime(2024, 1, 1, 0, n), p) for n, (e, p) in enumerate(lines)], "event string, received_at timestamp, payload string")
    raw.write.json(f"{tmp_path}/in")
    events = ingest.hook_stream(spark, f"{tmp_path}/in")
    ingest.run_hooks(events, HashEmbedder(8), f"{tmp_path}/out", f"{tmp_path}/state", deny="secret", trigger={"availableNow": True}).awaitTermination()
    got = {n: spark.read.parquet(f"{tmp_path}/out/{n}").collect() for n in ("contexts", "sessions", "prompts", "messages", "stops")}
    assert [(r.session_id, r.project) for r in got["contexts"]] == [("s1", "app")]
    assert [r.content_session_id for r in got["sessions"]] == ["s1"] * 3  # two prompts and a tool event
    assert json.loads(next(r.payload for r in got["messages"] if r.message_type == "observation"))["project"] == "app"
    assert [(r.prompt, len(r.embedding)) for r in got["prompts"]] == [("do it", 8)]
    assert sorted(r.message_type for r in got["messages"]) == ["observation", "summary"]
    assert sorted(r.content_session_id for r in got["stops"]) == ["s1", "s2"]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from engramlake.sources import versions

    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(RuntimeError):
        versions.scratch_path(Session())
