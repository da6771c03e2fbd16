"""Synchronisation over HTTP with a small server in this process, and tables that change together."""

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from engramlake.operators import changes
from engramlake.sources import remote as remotes
from engramlake.sources.remote import AFTER, HttpRemote, heads
from engramlake.sources.tables import Change, Conflict, TableSet
from engramlake.streaming import sync

NOW = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)


class Server:
    """The other side: collections by id, pages behind cursors, rows taken once by their sync_id."""

    def __init__(self):
        self.rows = {c: {} for c in AFTER}
        self.refused, self.calls, self.down, self.pushes = set(), 0, False, []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, what, code=200):
                body = json.dumps(what).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                outer.calls += 1
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                if outer.down:
                    return self.answer({}, 403)
                page = {c: [r for i, r in sorted(outer.rows[c].items()) if i > int(q[AFTER[c]]) and r.get("sync_source") != q["machine_id"]][: int(q["limit"])] for c in AFTER}
                self.answer({c: p for c, p in page.items() if p})

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                if outer.down:
                    return self.answer({}, 403)
                outer.pushes.append(body)
                got = lost = 0
                for c in AFTER:
                    for r in body.get(c, []):
                        if r["sync_id"] in outer.refused:
                            lost += 1
                            continue
                        got += 1
                        if r["sync_id"] not in {x["sync_id"] for x in outer.rows[c].values()}:
                            n = max(outer.rows[c], default=0) + 1
                            outer.rows[c][n] = r | {"id": n}
                self.answer({"received": got, "rejected": lost})

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.remote = HttpRemote(f"http://127.0.0.1:{self.http.server_port}", "here", "secret")

    def add(self, collection, i, **fields):
        self.rows[collection][i] = {"id": i, "sync_id": f"{collection}-{i}", "sync_source": "there", "sync_version": 9} | fields


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def observation(i, session="m1", sync_id=None, version=0):
    return {"id": i, "memory_session_id": session, "project": "p", "title": f"t{i}", "created_at_epoch": i, "embedding": [0.5, float(i)], "sync_id": sync_id, "sync_version": version, "sync_source": "here"}


def frame(spark, table, rows):
    schema = sync.SCHEMAS[table]
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "row string")
    from pyspark.sql import functions as F

    return text.select(F.from_json("row", schema).alias("r")).select("r.*")


def store_of(spark, path, observations, sessions=({"id": 1, "content_session_id": "c1", "memory_session_id": "m1", "project": "p", "sync_id": "s1", "sync_version": 5, "sync_source": "here"},)):
    store = TableSet(spark, str(path), sync.TABLES, parts=4)
    first = {"observations": Change(frame(spark, "observations", observations)), "sdk_sessions": Change(frame(spark, "sdk_sessions", sessions))}
    store.commit(store.manifest(), first, used_ids={"observations": len(observations) + 1, "sdk_sessions": len(sessions) + 1})
    return store


def contents(store):
    """All tables but the times of a run."""
    m = store.manifest()
    return {t: sorted(tuple(map(str, r)) for r in store.read(t, manifest=m).collect()) for t in sync.TABLES}


def settings(store):
    return {r.key: r.value for r in store.read("settings").collect()}


def test_how_far_ids_go(server):
    zero = dict.fromkeys(AFTER, 0)
    assert heads(server.remote, zero) == zero and server.calls == 1
    for i in (3, 7, 1000, 123_456_789):
        server.add("observations", i)
    for i in (1, 2):
        server.add("prompts", i)
    server.add("summaries", 5, sync_source="here")  # one's own rows are never seen
    assert heads(server.remote, zero) == zero | {"observations": 123_456_789, "prompts": 2}
    before = server.calls
    assert heads(server.remote, zero | {"observations": 123_456_789, "prompts": 2}) == zero | {"observations": 123_456_789, "prompts": 2}
    assert server.calls == before + 1


def test_stream_reads_on_after_a_restart(spark, server, tmp_path):
    remotes.register(spark)

    def run():
        rows = spark.readStream.format("memory_pull").option("url", server.remote.url).option("machine", "here").option("page", 3).option("rowsPerTask", 5).load()
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out")).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted((r.collection, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for i in range(1, 24):
        server.add("observations", i, title="é 😀")
    server.add("sessions", 4)
    first = run()
    assert first == [*(("observations", i) for i in range(1, 24)), ("sessions", 4)]
    for i in (30, 31, 40):
        server.add("observations", i)
    server.add("prompts", 2)
    assert run() == sorted([*first, ("observations", 30), ("observations", 31), ("observations", 40), ("prompts", 2)])
    assert run() == sorted([*first, ("observations", 30), ("observations", 31), ("observations", 40), ("prompts", 2)])


def test_cycle(spark, server, tmp_path):
    store = store_of(spark, tmp_path, [observation(1, sync_id="a"), observation(2, sync_id="b"), observation(3), observation(4, sync_id="c", version=7)])
    server.refused = {"b"}
    server.add("sessions", 11, content_session_id="c9", memory_session_id="m9", project="q")
    server.add("sessions", 12, content_session_id="c1", memory_session_id="m77", project="q")  # a known session
    server.add("observations", 50, memory_session_id="m9", title="new", embedding=[1.0, 2.0])
    server.add("observations", 51, memory_session_id="lost")
    server.add("observations", 52, memory_session_id="m1", sync_id="c")  # known by its sync_id
    server.add("observations", 53, memory_session_id="m1", sync_id=None)
    server.add("prompts", 6, content_session_id="c9", prompt="x", prompt_number=1)
    server.add("prompts", 7, content_session_id="c9", prompt="y", prompt_number=1)  # a number twice
    sync.cycle(store, server.remote, 0, now=NOW)
    seen = {r.id: r for r in store.read("observations").collect()}
    assert {i: (r.title, r.sync_version) for i, r in seen.items()} == {1: ("t1", int(NOW.timestamp())), 2: ("t2", 0), 3: ("t3", 0), 4: ("t4", 7), 5: ("new", 9), 6: (None, 9)}
    assert list(seen[5].embedding) == [1.0, 2.0] and seen[5].sync_source == "there"
    assert sorted((r.id, r.content_session_id) for r in store.read("sdk_sessions").collect()) == [(1, "c1"), (2, "c9")]
    assert [(r.id, r.prompt) for r in store.read("user_prompts").collect()] == [(1, "x")]
    assert settings(store) == {"last_push": "2024-05-01T00:00:00Z", "last_pull": "2024-05-01T00:00:00Z", "pull_cursor:observations": "53", "pull_cursor:sessions": "12", "pull_cursor:prompts": "7"}
    assert [r["embedding"] for r in server.pushes[0]["observations"]] == [[0.5, 1.0], [0.5, 2.0]]
    # the same batch again is known; the next one sends only what was refused, or a sign of life
    version, sent = store.manifest().version, len(server.pushes)
    sync.cycle(store, server.remote, 0, now=NOW)
    assert store.manifest().version == version and len(server.pushes) == sent
    server.refused = set()
    sync.cycle(store, server.remote, 1, now=NOW)
    assert [r["sync_id"] for r in server.pushes[sent]["observations"]] == ["b"]
    sync.cycle(store, server.remote, 2, now=NOW)
    assert server.pushes[-1]["observations"] == [] and len(store.read("observations").collect()) == 6


def test_neither_failure_stops_the_other(spark, server, tmp_path):
    store = store_of(spark, tmp_path, [observation(1, sync_id="a")])
    server.down = True
    sync.cycle(store, server.remote, 0, now=NOW)
    assert settings(store) == {} and store.read("observations").first().sync_version == 0
    server.down = False
    sync.cycle(store, server.remote, 1, now=NOW)
    assert settings(store).keys() >= {"last_push", "last_pull"} and store.read("observations").first().sync_version > 0


@pytest.mark.parametrize("step", ["push", "pull", "imported", "_publish"])
def test_a_cycle_that_dies_repeats_safely(spark, server, tmp_path, monkeypatch, step):
    rows = [observation(i, sync_id=f"a{i}") for i in range(1, 6)]
    server.add("sessions", 3, content_session_id="c9", memory_session_id="m9")
    for i in range(1, 30):
        server.add("observations", i, memory_session_id="m9")
    plain = store_of(spark, tmp_path / "plain", rows)
    other = Server()
    other.rows = json.loads(json.dumps(server.rows), object_hook=lambda d: {int(k) if k.isdigit() else k: v for k, v in d.items()})
    sync.cycle(plain, other.remote, 0, now=NOW)

    store = store_of(spark, tmp_path / "dying", rows)
    where = {"push": sync, "pull": sync, "imported": sync.changes, "_publish": TableSet}[step]
    real = getattr(where, step)

    def dies(*args, **kwargs):
        if step == "push":
            real(*args, **kwargs).collect()  # the other side has taken the rows
        raise RuntimeError("killed")

    monkeypatch.setattr(where, step, dies)
    before = contents(store)
    with pytest.raises(RuntimeError, match="killed"):
        sync.cycle(store, server.remote, 0, now=NOW)
    assert contents(store) == before
    monkeypatch.setattr(where, step, real)
    sync.cycle(store, server.remote, 0, now=NOW)
    assert contents(store) == contents(plain)
    assert sorted(r["sync_id"] for r in server.rows["observations"].values()) == sorted(r["sync_id"] for r in other.rows["observations"].values())
    other.http.shutdown()


def test_cycles_on_a_trigger(spark, server, tmp_path):
    store = store_of(spark, tmp_path / "t", [observation(1, sync_id="a")])
    server.add("observations", 1, memory_session_id="m1")
    q = sync.run_sync(store, server.remote, str(tmp_path / "cp"), "1 second")
    for _ in range(120):
        if store.manifest().batch >= 1 or q.exception():
            break
        q.awaitTermination(1)
    q.stop()
    assert q.exception() is None and store.manifest().batch >= 1
    assert store.read("observations").count() == 2 and len(server.rows["observations"]) == 2


def test_receiving_and_answering(spark, tmp_path):
    store = TableSet(spark, str(tmp_path / "t"), sync.TABLES, parts=4)
    session = {"id": 77, "content_session_id": "c1", "memory_session_id": "m1", "sync_id": "s", "sync_source": "a"}
    bodies = [{"machine_id": "a", "sessions": [session], "observations": [observation(9, sync_id="x") | {"sync_source": "a"}]}, {"machine_id": "b", "observations": [observation(3, sync_id="x"), observation(4, "lost", "y")]}, {"machine_id": ""}]
    (tmp_path / "in").mkdir()
    for n, body in enumerate(bodies):
        (tmp_path / "in" / f"{n}.txt").write_text(json.dumps(body))
        stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
        sync.run_receiver(store, stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert [(r.id, r.sync_id) for r in store.read("observations").collect()] == [(1, "x")]
    assert set(settings(store)) == {"client_push:a", "client_push:b"}
    assert {r.machine_id: (r.last_push is None, r.last_pull is None) for r in changes.client_sync_times(store.read("settings")).collect()} == {"a": (False, True), "b": (False, True)}
    assert [(r.collection, r.id) for r in sync.answer_pull(store, "b", {}).collect()] == [("sessions", 1), ("observations", 1)]
    assert sync.answer_pull(store, "a", {}).count() == 0 == sync.answer_pull(store, "b", {"sessions": 1, "observations": 1}).count()
    assert {r.machine_id: r.last_pull is None for r in changes.client_sync_times(store.read("settings")).collect()} == {"a": False, "b": False}


def test_upserts_rewrite_touched_parts_alone(spark, tmp_path):
    store = TableSet(spark, str(tmp_path), {"settings": ("key string, value string", "key")}, parts=8)
    rows = spark.createDataFrame([(f"k{i}", "old") for i in range(100)], "key string, value string")
    store.commit(store.manifest(), {"settings": Change(rows)})
    before = store.manifest()
    one = spark.createDataFrame([("k5", "new", 1)], "key string, value string, seq long")
    store.upsert("settings", one, changes.settings_upsert)
    after = store.manifest()
    (part,) = store.touched(one, "settings")
    assert {p for p in range(8) if before.parts["settings"][p] != after.parts["settings"][p]} == {part}
    assert [f.name for f in next((tmp_path / "settings").glob("v=2-*")).iterdir() if f.is_dir()] == [f"part={part}"]
    got = {r.key: r.value for r in store.read("settings").collect()}
    assert len(got) == 100 and [k for k, v in got.items() if v == "new"] == ["k5"]


def test_of_two_writers_one_fails(spark, tmp_path):
    store = TableSet(spark, str(tmp_path), {"settings": ("key string, value string", "key")})
    base = store.manifest()
    store.commit(base, {"settings": Change(spark.createDataFrame([("a", "1")], "key string, value string"))})
    with pytest.raises(Conflict):
        store.commit(base, {"settings": Change(spark.createDataFrame([("b", "2")], "key string, value string"))})
    assert [r.key for r in store.read("settings").collect()] == ["a"]
