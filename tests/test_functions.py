"""Column functions on their edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from engramlake.functions import fts, json as js, scalar
from engramlake.functions.models import HashEmbedder, embed, with_retry
from engramlake.functions.stemming import stem


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cwd, want", [("/home/me/proj", "proj"), ("/home/me/proj/", "proj"), ("proj", "proj"), ("", ""), ("/", "/"), (None, "")])
def test_project_from_path(spark, cwd, want):
    assert one(spark, scalar.project_from_path(F.lit(cwd).cast("string"))) == want


@pytest.mark.parametrize("project, allow, deny, want", [("A", "a, b", "a", True), ("c", "a,b", "", False), ("c", "", "C", False), ("c", " , ", "", True), ("", "", "", False)])
def test_project_allowed(spark, project, allow, deny, want):
    assert one(spark, scalar.project_allowed(F.lit(project), F.lit(allow), F.lit(deny))) is want


@pytest.mark.parametrize("epoch, want", [(1704067200, 1704067200), (1704067200123, 1704067200), (1_000_000_000_000, 1_000_000_000_000), (None, None)])
def test_epoch_seconds(spark, epoch, want):
    assert one(spark, scalar.epoch_seconds(F.lit(epoch).cast("long"))) == want


@pytest.mark.parametrize("name, want", [("", "claude"), ("claude", "claude"), ("codex", "codex"), ("CODEX", "codex"), ("other", None), (None, "claude")])
def test_provider(spark, name, want):
    assert one(spark, scalar.normalize_provider(F.lit(name).cast("string"))) == want


def test_day_bounds(spark):
    now = F.lit(99).cast("long")
    bounds = lambda a, b: tuple(one(spark, c) for c in scalar.day_bounds(a, b, now))
    assert bounds(None, None) == (0, 99)
    assert bounds("2024-01-01", "2024-01-01") == (1704067200, 1704067200 + 86399)
    assert bounds("junk", "junk") == (0, 0)


@pytest.mark.parametrize("text, limit, want", [("abc", 3, "abc"), ("abcd", 3, "abc... (truncated)"), ("aéb", 2, "a... (truncated)"), ("a😀b", 4, "a... (truncated)"), ("", 3, "")])
def test_truncate_bytes(spark, text, limit, want):
    assert one(spark, scalar.truncate_bytes(F.lit(text), limit)) == want


def test_keys_and_urls(spark):
    assert [one(spark, scalar.mask_key(F.lit(k))) for k in ("", "abc", "abcd", "abcdef")] == ["", "****", "****", "**cdef"]
    assert one(spark, scalar.redact_url(F.lit("postgresql://u:secret@h:5432/d"))) == "postgresql://u:***@h:5432/d"
    assert one(spark, scalar.redact_url(F.lit("short"))) == "short"


@pytest.mark.parametrize("line, level, message", [("6:20PM INF started", "info", "started"), ("\x1b[90m6PM\x1b[0m \x1b[31mERR\x1b[0m \x1b[1mboom", "error", "boom"), ("no tag", "info", "no tag"), ("ends ERR", "info", "ends ERR"), ("WRN x DBG y", "debug", "y")])
def test_log_lines(spark, line, level, message):
    assert (one(spark, scalar.log_level(F.lit(line))), one(spark, scalar.log_message(F.lit(line)))) == (level, message)


def test_levels(spark):
    assert one(spark, scalar.level_reaches(F.lit("warn"), F.lit("info"))) and one(spark, scalar.level_reaches(F.lit("odd"), F.lit("fatal")))
    assert not one(spark, scalar.level_reaches(F.lit("debug"), F.lit("info")))


@pytest.mark.parametrize(
    "payload, want",
    [
        ('{"session_id":"s","prompt":"p","tool_name":"t"}', {"session_id": "s", "prompt": "p", "tool_name": "t", "cwd": "/here"}),
        ('{"sessionId":"s","input":"p","toolName":"t","toolInput":{"cmd":"ls"},"toolResponse":{"output":"ok"},"transcriptPath":"/t","lastAssistantMessage":"m","cwd":"/w"}', {"session_id": "s", "prompt": "p", "tool_name": "t", "tool_input": '{"cmd":"ls"}', "tool_response": '{"output":"ok"}', "transcript_path": "/t", "last_assistant_message": "m", "cwd": "/w"}),
        ('{"session_id":"  ","sessionId":"s"}', {"session_id": "s"}),
        ("not json", {"session_id": None, "cwd": "/here"}),
        ("[1]", {"session_id": None}),
    ],
)
def test_hooks(spark, payload, want):
    row = spark.range(1).select(F.lit(payload).alias("p")).select(*js.normalize_hook(F.col("p"), F.lit("/here"))).first().asDict()
    assert {k: row[k] for k in want} == want


@pytest.mark.parametrize("text, want", [(None, "[]"), ("", "[]"), ("[1", "[]"), ("null", "null"), ('["a"]', '["a"]')])
def test_json_arrays(spark, text, want):
    assert one(spark, js.json_array_or_empty(F.lit(text).cast("string"))) == want


def test_content(spark):
    of = lambda t: one(spark, js.content_text(F.lit(t)))
    assert of('"a\\nb"') == "a\nb"
    assert of('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]') == "a\nb"
    assert of("3") == ""


def test_reminders_and_previews(spark):
    assert one(spark, scalar.strip_reminders(F.lit("a <system-reminder>x\ny</system-reminder> b"))) == "a  b"
    assert one(spark, scalar.prompt_preview(F.lit("<b>x</b>\n\n y" + "z" * 300))) == "x y" + "z" * 197 + "..."


def test_embedding_text(spark):
    assert one(spark, scalar.embedding_text(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), facts=F.array(F.lit("f"), F.lit("g")))) == "a  c f g"
    assert one(spark, scalar.embedding_text(F.lit("a"), facts=F.lit(None).cast("array<string>"))) == "a"


@pytest.mark.parametrize("word, want", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("generously", "generous"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("happy", "happi"), ("at", "at"), ("national", "nation"), ("communication", "communic")])
def test_stems(word, want):
    assert stem(word) == want


def test_queries_parse():
    assert fts.parse_query("The cat", "english") == [[fts.Term(("cat",))]]
    assert fts.parse_query('a "b c" -d or e') == [[fts.Term(("a",)), fts.Term(("b", "c")), fts.Term(("d",), True)], [fts.Term(("e",))]]
    assert fts.parse_query("the of", "english") == [] and fts.parse_query('"') == []


def test_ranks(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat x x x dog"), (3, "cat cat"), (4, "dog"), (5, None)], "id long, t string")
    rows = lambda q: {r.id: r.r for r in fts.with_vector(docs, [("t", "D")]).filter(fts.matches(F.col("vector"), fts.parse_query(q))).select("id", fts.rank(F.col("vector"), fts.parse_query(q)).alias("r")).collect()}
    single = rows("cat")
    assert single[1] == pytest.approx(0.1 / 1.64493406685) and single[3] == pytest.approx(0.125 / 1.64493406685)
    both = rows("cat dog")
    assert set(both) == {1, 2} and both[1] > both[2]
    assert set(rows('"cat dog"')) == {1} and set(rows("dog -cat")) == {4} and set(rows("x or cat")) == {1, 2, 3} and rows("") == {}


def test_embedder(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    v = {r.id: r.embedding for r in embed(docs, "t", HashEmbedder(8)).collect()}
    assert v[1] == v[2] and v[3] is None and sum(x * x for x in v[1]) == pytest.approx(1, abs=1e-6)


def test_retry():
    waits, left = [], [ConnectionError(), ConnectionError()]

    def call():
        if left:
            raise left.pop()
        return 7

    assert with_retry(call, sleep=waits.append) == 7 and waits == [1, 2]
    with pytest.raises(ConnectionError):
        with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), retries=2, sleep=waits.append)


def test_times(spark):
    assert one(spark, scalar.parse_time(F.lit("junk"), F.lit(0))) == dt.datetime(1970, 1, 1)
    assert one(spark, scalar.parse_time(F.lit("junk"))) is None
