"""Steps that must not grow faster than their input: one reading of a payload, one making of a body."""

from pyspark.sql import functions as F

from engramlake.functions.json import normalize_hook
from engramlake.operators import changes
from engramlake.streaming import ingest

PAYLOADS = ['{"sessionId": "u1", "toolInput": {"b": 1, "a": [1.0, null]}, "cwd": " "}', '{"session_id": "", "sessionId": 7, "prompt": null, "text": "é\\"x"}', '{"a": 1} x', "[1]", '"x"', "", None, '{"session_id": "a", "session_id": "b"}', '{"cwd": "/w", "tool_response": true, "user_prompt": "p", "input": "\\t"}', '{"last_assistant_message": "\\ud83d\\ude00", "transcriptPath": "t"', " {\"toolName\": \"Ed\\u0069t\"} "]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hooks_are_read_once_and_as_before(spark):
    raw = spark.createDataFrame([("stop", p) for p in PAYLOADS], "event string, payload string").withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    made = ingest.normalized(raw)
    assert made.collect() == raw.select("event", "received_at", *normalize_hook(F.col("payload"), F.lit(""))).collect()
    assert "get_json_object" not in plan_of(made) and plan_of(made).count("json_tuple") == 1


def test_a_page_moves_ids_before_rows(spark):
    rows = spark.createDataFrame([(i, f"m:{i}" if i % 3 else None, i % 2, "m1" if i % 4 else None, "x" * 9) for i in range(500, 0, -1)], "id long, sync_id string, sync_version long, sync_source string, text string")
    assert [r["id"] for r in changes.unsynced(rows, 5).collect()] == [2, 4, 8, 10, 14]
    assert [r["id"] for r in changes.pull_page(rows, "m1", 10, 3).collect()] == [12, 16, 20]
    assert changes.unsynced(rows).columns == rows.columns and "LeftSemi" in plan_of(changes.unsynced(rows))


def test_a_body_is_made_once(spark):
    tables = {t: spark.createDataFrame([(i, f"{t}{i}", 0) for i in range(3)], "id long, sync_id string, sync_version long") for t in changes.COLLECTIONS}
    rows = changes.pushed_rows(changes.push_body(tables, "m1", 2))
    assert sorted(map(tuple, rows.select("table_name", F.get_json_object("row", "$.sync_id")).collect())) == sorted((t, f"{t}{i}") for t in tables for i in range(2))
    assert plan_of(rows).count("collect_list") == len(tables)
