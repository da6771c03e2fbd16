"""Every registered query of the memory engine, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fts, json as js, scalar, vectors
from ..functions.models import HashEmbedder, embed
from ..operators import changes, context, lists, search
from ..sources import memory, versions
from ..sources.postings import Postings
from ..sources.remote import COLLECTIONS
from ..sources.vector_cells import VectorIndex
from ..sources.tables import Change, TableSet
from ..streaming import ingest, lifecycle
from .oracles import NEWEST, PLAIN, STEMS, TOKENS, cosine, single_rank, sql, stems_to

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PROJECT, OTHER, WORD = "src1", "src2", "that"
FIRST, LAST = 1704067200 + 100 * 600, 1704067200 + 400 * 600
VECTORS = memory.observations  # observations with their vectors
OBS, SUMS, SESS, PROMPTS = partial(memory.observations, vectors=False), memory.summaries, memory.sessions, memory.user_prompts
TABLES = {"observations": (OBS, "obs"), "sdk_sessions": (SESS, "sess"), "session_summaries": (SUMS, "sums"), "user_prompts": (PROMPTS, "prompts")}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 1) -> list[float]:
    """The vector of one row, as a caller would hand it in."""
    return list(memory.read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


_indexes: dict[tuple[str, str, str], object] = {}


def _built(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> object:
    """An index that is built when a session first asks for it, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = build(f"{versions.scratch_path(spark)}/{name}")
    return _indexes[key]


def postings(spark: SparkSession, sf_dir: str, table: str = "observations", config: str = "simple") -> Postings:
    rows, fields = (OBS, search.OBSERVATION_FIELDS) if table == "observations" else (SUMS, search.SUMMARY_FIELDS)

    def build(root: str) -> Postings:
        made = Postings(spark, root, fields, config)
        made.append(rows(spark, sf_dir), 0)
        return made

    return _built(spark, sf_dir, f"postings-{table}-{config}", build)


def cells(spark: SparkSession, sf_dir: str, table: str = "observations") -> VectorIndex:
    def build(root: str) -> VectorIndex:
        rows = (VECTORS if table == "observations" else SUMS)(spark, sf_dir).select("id", "project", "embedding")
        made = VectorIndex(spark, root)
        made.train(rows)
        made.append(rows, 0)
        return made

    return _built(spark, sf_dir, f"cells-{table}", build)


def indexes(spark: SparkSession, sf_dir: str, table: str) -> search.Indexes:
    return search.Indexes(postings(spark, sf_dir, table), cells(spark, sf_dir, table))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# lookups and lists


@query("observation_by_id", sql("SELECT id, type, title, narrative, project, created_at_epoch FROM obs WHERE id = 42"))
def _(s, d):
    return lists.by_id(OBS(s, d), 42).select("id", "type", "title", "narrative", "project", "created_at_epoch")


_SESSION = "id, content_session_id, memory_session_id, project, started_at_epoch, status, completed_at_epoch"


@query("session_by_content_id", sql(f"SELECT {_SESSION} FROM sess WHERE content_session_id = 'c7'"))
def _(s, d):
    return lists.by_content_session(SESS(s, d), "c7").select(*_SESSION.split(", "))


@query("list_observations", sql(f"SELECT {PLAIN} FROM obs WHERE project = '{PROJECT}' {NEWEST} LIMIT 20"))
def _(s, d):
    return lists.list_observations(OBS(s, d), PROJECT)


@query("list_observations_by_type", sql(f"SELECT {PLAIN} FROM obs WHERE project = '{PROJECT}' AND type = 'en' {NEWEST} LIMIT 20"))
def _(s, d):
    return lists.list_observations(OBS(s, d), PROJECT, "en")


@query("list_summaries", sql(f"SELECT id, memory_session_id, project, coalesce(request, '') AS request, coalesce(investigated, '') AS investigated, coalesce(learned, '') AS learned, coalesce(completed, '') AS completed, coalesce(next_steps, '') AS next_steps, coalesce(files_read, []) AS files_read, coalesce(files_edited, []) AS files_edited, created_at_epoch FROM sums WHERE project = '{PROJECT}' {NEWEST} LIMIT 20"))
def _(s, d):
    return lists.list_summaries(SUMS(s, d), PROJECT)


@query("list_prompts", sql(f"SELECT id, content_session_id, project, prompt, prompt_number, created_at_epoch FROM prompts WHERE project = '{PROJECT}' {NEWEST} LIMIT 50"))
def _(s, d):
    return lists.list_prompts(PROMPTS(s, d), PROJECT)


@query("session_observations", sql("SELECT id, type, created_at_epoch FROM obs WHERE memory_session_id = 'm5'"))
def _(s, d):
    return lists.session_observations(OBS(s, d), "m5").select("id", "type", "created_at_epoch")


@query("session_prompts", sql("SELECT id, prompt_number, prompt FROM prompts WHERE content_session_id = 'c7'"))
def _(s, d):
    return lists.session_prompts(PROMPTS(s, d), "c7").select("id", "prompt_number", "prompt")


_FILE = f"src/{PROJECT}/f3.go"


@query("search_by_file", sql(f"SELECT {PLAIN} FROM obs WHERE project = '{PROJECT}' AND (list_contains(coalesce(files_read, []), '{_FILE}') OR list_contains(coalesce(files_modified, []), '{_FILE}')) {NEWEST} LIMIT 20"))
def _(s, d):
    return search.search_by_file(OBS(s, d), _FILE, PROJECT)


@query("timeline_range", sql(f"SELECT {PLAIN} FROM obs WHERE project = '{PROJECT}' AND created_at_epoch BETWEEN {FIRST} AND {LAST} {NEWEST} LIMIT 50"))
def _(s, d):
    return search.search_timeline(OBS(s, d), FIRST, LAST, PROJECT)


@query("timeline_days", sql(f"SELECT {PLAIN} FROM obs WHERE project = '{OTHER}' AND created_at_epoch BETWEEN epoch(DATE '2024-01-03') AND epoch(DATE '2024-01-05') + 86399 {NEWEST} LIMIT 50"))
def _(s, d):
    low, high = scalar.day_bounds("2024-01-03", "2024-01-05", F.unix_timestamp())
    return search._plain(search.newest(OBS(s, d).filter((F.col("project") == OTHER) & F.col("created_at_epoch").between(low, high)), 50))


_RECENT = sql(
    f"""SELECT o.id, type, coalesce(title, '') AS title, coalesce(narrative, '') AS narrative, coalesce(files_read, []) AS files_read, coalesce(files_modified, []) AS files_modified,
    CAST(coalesce((SELECT max(p.prompt_number) FROM prompts p JOIN sess s ON s.content_session_id = p.content_session_id WHERE s.memory_session_id = o.memory_session_id), 0) AS BIGINT) AS prompt_number, created_at, created_at_epoch
    FROM (SELECT * FROM obs WHERE project = '{PROJECT}' {NEWEST} LIMIT 50) o"""
)


@query("recent_observations", _RECENT)
def _recent(s, d):
    return lists.recent_observations(OBS(s, d), SESS(s, d), PROMPTS(s, d), PROJECT)


@query("recent_summaries", sql(f"SELECT id, coalesce(request, '') AS request, coalesce(completed, '') AS completed, coalesce(learned, '') AS learned, coalesce(next_steps, '') AS next_steps, created_at, created_at_epoch FROM sums WHERE project = '{PROJECT}' {NEWEST} LIMIT 10"))
def _(s, d):
    return lists.recent_summaries(SUMS(s, d), PROJECT)


_PREVIEW = "CASE WHEN length({0}) > 200 THEN substring({0}, 1, 200) || '...' ELSE {0} END".format(r"trim(regexp_replace(regexp_replace(prompt, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))")


@query("prompt_preview", sql(f"SELECT id, {_PREVIEW} AS preview FROM prompts"))
def _(s, d):
    return PROMPTS(s, d).select("id", scalar.prompt_preview(F.col("prompt")).alias("preview"))


_OBS_LINES = "SELECT 'observation' AS kind, id, coalesce(title, '') AS label, created_at_epoch AS epoch FROM (SELECT * FROM obs WHERE project = '{0}' {1} {2} LIMIT 100)"


@query("unified_timeline", sql(_OBS_LINES.format(PROJECT, "", NEWEST) + f" UNION ALL SELECT 'summary', id, coalesce(request, ''), created_at_epoch FROM (SELECT * FROM sums WHERE project = '{PROJECT}' {NEWEST} LIMIT 50) UNION ALL SELECT 'prompt', id, {_PREVIEW}, created_at_epoch FROM (SELECT * FROM prompts WHERE project = '{PROJECT}' {NEWEST} LIMIT 50)"))
def _(s, d):
    return lists.unified_timeline(OBS(s, d), SUMS(s, d), PROMPTS(s, d), PROJECT)


@query("unified_timeline_typed", sql(_OBS_LINES.format(PROJECT, "AND type = 'fr'", NEWEST)))
def _(s, d):
    return lists.unified_timeline(OBS(s, d), SUMS(s, d), PROMPTS(s, d), PROJECT, "fr")


# counts


@query("list_projects", sql("SELECT project, count(*) AS observations FROM obs WHERE project <> '' GROUP BY project"))
def _(s, d):
    return lists.list_projects(OBS(s, d))


@query("stats", sql("SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM sums) AS summaries"))
def _(s, d):
    return lists.stats(OBS(s, d), SUMS(s, d), SESS(s, d))


@query("stats_by_project", sql("SELECT project, count(*) FILTER (WHERE n = 's') AS sessions, count(*) FILTER (WHERE n = 'o') AS observations, count(*) FILTER (WHERE n = 'u') AS summaries FROM (SELECT project, 's' AS n FROM sess UNION ALL SELECT project, 'o' FROM obs UNION ALL SELECT project, 'u' FROM sums) GROUP BY project"))
def _(s, d):
    return lists.stats_by_project(OBS(s, d), SUMS(s, d), SESS(s, d))


@query("pending_count", sql("SELECT count(*) AS pending FROM pend WHERE status = 'pending'"))
def _(s, d):
    return memory.pending_messages(s, d).filter("status = 'pending'").agg(F.count("*").alias("pending"))


@query("missing_embeddings", sql("SELECT 'observations' AS table_name, count(*) FILTER (WHERE embedding IS NULL) AS missing, count(*) AS total FROM obs UNION ALL SELECT 'session_summaries', count(*) FILTER (WHERE embedding IS NULL), count(*) FROM sums UNION ALL SELECT 'user_prompts', count(*), count(*) FROM prompts"))
def _(s, d):
    return lists.missing_embeddings(VECTORS(s, d), SUMS(s, d), PROMPTS(s, d))


@query("prompt_numbering", sql("SELECT id, content_session_id, CAST(row_number() OVER (PARTITION BY content_session_id ORDER BY created_at_epoch, id) + coalesce((SELECT max(prompt_number) FROM prompts p WHERE p.content_session_id = t.content_session_id AND p.id % 2 = 0), 0) AS BIGINT) AS prompt_number FROM prompts t WHERE id % 2 = 1"))
def _(s, d):
    p = PROMPTS(s, d)
    return lists.prompt_numbering(p.filter("id % 2 = 1").drop("prompt_number"), p.filter("id % 2 = 0")).select("id", "content_session_id", "prompt_number")


# vectors and full text


@query("cosine_similarity", f"SELECT e.vec_id, round({cosine('e.embedding', 'q.embedding')}, 6) + 0.0 AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q")
def _(s, d):
    e = memory.read(s, d, "embeddings")
    v = vectors.vector_literal(query_vector(s, d))
    return e.select("vec_id", (F.round(vectors.cosine_similarity(F.col("embedding"), v), 6) + F.lit(0.0)).alias("similarity"))


@query("semantic_topk", sql(f"SELECT id, round(sc, 6) + 0.0 AS semantic_score FROM (SELECT id, {cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 1)')} AS sc FROM obs WHERE embedding IS NOT NULL) ORDER BY sc DESC, id LIMIT 30"))
def _(s, d):
    return rounded(search.nearest(VECTORS(s, d), query_vector(s, d), 30), "semantic_score")


@query("semantic_topk_cells", ORACLES["semantic_topk"])
def _(s, d):
    return rounded(cells(s, d).nearest(query_vector(s, d), 30, exact=True), "semantic_score")


@query("ann_topk_cells")
def _(s, d):
    return cells(s, d).nearest(query_vector(s, d), 30)


@query("ann_topk_lsh")
def _(s, d):
    return search.lsh_nearest(VECTORS(s, d), query_vector(s, d), 30)


@query("fts_tokens", sql("SELECT token, count(DISTINCT id) AS observations, count(*) AS occurrences FROM tok GROUP BY token", TOKENS))
def _(s, d):
    return postings(s, d).vocabulary().withColumnRenamed("rows", "observations")


def _match(text: str, condition: str, name: str) -> None:
    @query(name, sql(f"SELECT id FROM (SELECT id, list(token) AS l, ' ' || string_agg(token, ' ' ORDER BY pos) || ' ' AS t FROM tok GROUP BY id) WHERE {condition}", TOKENS))
    def _(s, d):
        return postings(s, d).found(text).select("id")


_match("that with", "list_contains(l, 'that') AND list_contains(l, 'with')", "fts_match_and")
_match("thing or avec", "list_contains(l, 'thing') OR list_contains(l, 'avec')", "fts_match_or")
_match("that -with", "list_contains(l, 'that') AND NOT list_contains(l, 'with')", "fts_match_not")
_match('"of the"', "t LIKE '% of the %'", "fts_match_phrase")


@query("fts_match_scan", ORACLES["fts_match_and"])
def _(s, d):
    return search.matching(OBS(s, d), search.OBSERVATION_FIELDS, "that with").select("id")


@query("fts_match_none_of", sql("SELECT id FROM obs WHERE id NOT IN (SELECT id FROM tok WHERE token IN ('that', 'avec'))", TOKENS))
def _(s, d):
    return postings(s, d).found("-that -avec").select("id")


@query("fts_weighted", sql("SELECT id, CAST(sum(pos) AS BIGINT) AS positions, round(sum(w), 6) AS weight, count(*) AS tokens FROM tok GROUP BY id", TOKENS))
def _(s, d):
    v = fts.with_vector(OBS(s, d), search.OBSERVATION_FIELDS, target="v").filter("size(v) > 0")
    total = F.aggregate(F.transform("v", lambda t: t["pos"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    weight = F.aggregate(F.transform("v", lambda t: t["weight"]), F.lit(0.0), lambda a, b: a + b)
    return v.select("id", total.alias("positions"), F.round(weight, 6).alias("weight"), F.size("v").cast("long").alias("tokens"))


@query("fts_rank_single", sql("SELECT id, round(r, 6) AS text_rank FROM rank1", TOKENS, single_rank(WORD)))
def _(s, d):
    return rounded(postings(s, d).hits(WORD), "text_rank")


_NEAR = "CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END"


@query("fts_rank_and", sql(f"SELECT a.id, round(1 - product(1 - sqrt(a.w * b.w * {_NEAR})), 6) AS text_rank FROM tok a JOIN tok b ON b.id = a.id AND b.token = 'with' WHERE a.token = 'that' GROUP BY a.id", TOKENS))
def _(s, d):
    return rounded(postings(s, d).hits("that with"), "text_rank")


@query("fts_rank_scan", ORACLES["fts_rank_and"])
def _(s, d):
    return rounded(search.text_hits(OBS(s, d), search.OBSERVATION_FIELDS, "that with"), "text_rank")


# words count by their stems, which SQL makes of every token
_THING, _THOR, _THON = map(stems_to, ("thing", "thor", "thon"))


@query("fts_english", sql(f"SELECT id, round(r, 6) AS text_rank FROM rank1 WHERE id NOT IN (SELECT id FROM tok WHERE token IN {_THOR})", TOKENS, STEMS, single_rank("thing").replace("= 'thing'", f"IN {_THING}")))
def _(s, d):
    return rounded(postings(s, d, config="english").hits("things -thorly"), "text_rank")


@query("fts_english_and", sql(f"SELECT a.id, round(1 - product(1 - sqrt(a.w * b.w * {_NEAR})), 6) AS text_rank FROM tok a JOIN tok b ON b.id = a.id AND b.token IN {_THON} WHERE a.token IN {_THING} GROUP BY a.id", TOKENS, STEMS))
def _(s, d):
    return rounded(postings(s, d, config="english").hits("the thinging of thons"), "text_rank")


@query("fts_english_scan", ORACLES["fts_english"])
def _(s, d):
    return rounded(search.text_hits(OBS(s, d), search.OBSERVATION_FIELDS, "things -thorly", "english"), "text_rank")


_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 1)"


def _hybrid_sql(table: str, where: str) -> str:
    return f"""near AS (SELECT id, {cosine('embedding', _VECTOR)} AS sc FROM {table} WHERE {where} AND embedding IS NOT NULL ORDER BY sc DESC, id LIMIT 30)"""


_HYBRID_OBS = f"""SELECT o.id, type, coalesce(title, '') AS title, coalesce(subtitle, '') AS subtitle, coalesce(narrative, '') AS narrative, project, created_at,
  coalesce(r, 0) AS tr, coalesce(sc, 0) AS ss, coalesce(r, 0) * CAST(0.4 AS DOUBLE) + coalesce(sc, 0) * CAST(0.6 AS DOUBLE) AS cs
  FROM obs o LEFT JOIN rank1 USING (id) LEFT JOIN near ON near.id = o.id WHERE o.project = '{PROJECT}' AND (rank1.id IS NOT NULL OR near.id IS NOT NULL) ORDER BY cs DESC, o.id LIMIT 10"""
_SHOWN = "id, type, title, subtitle, narrative, project, created_at, round(tr, 6) + 0.0 AS text_rank, round(ss, 6) + 0.0 AS semantic_score, round(cs, 6) + 0.0 AS combined_score"


@query("hybrid_search", sql(f"SELECT {_SHOWN} FROM ({_HYBRID_OBS})", TOKENS, single_rank(WORD, f"project = '{PROJECT}'"), _hybrid_sql("obs", f"project = '{PROJECT}'")))
def hybrid(s, d):
    return rounded(search.hybrid_search(OBS(s, d), WORD, query_vector(s, d), PROJECT, indexes=indexes(s, d, "observations")), *search._SCORES)


@query("hybrid_search_scan", ORACLES["hybrid_search"])
def _(s, d):
    return rounded(search.hybrid_search(VECTORS(s, d), WORD, query_vector(s, d), PROJECT), *search._SCORES)


_SUM_TOKENS = """
sfields AS (
  SELECT id, 1 AS f, 1.0 AS w, request AS t FROM sums UNION ALL SELECT id, 3, 0.4, learned FROM sums UNION ALL SELECT id, 4, 0.2, completed FROM sums UNION ALL SELECT id, 5, 0.2, next_steps FROM sums
), socc AS (
  SELECT id, CAST(w AS DOUBLE) AS w, row_number() OVER (PARTITION BY id ORDER BY f, i) AS j FROM (
    SELECT id, f, w, l[i] AS token, i FROM (SELECT id, f, w, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, f, w, list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM sfields))
  ) WHERE token = 'that'
), sbest AS (SELECT id, max(w) AS w FROM socc GROUP BY id),
srank AS (SELECT o.id, (max(b.w) + sum(o.w / (o.j * o.j)) - max(b.w) / pow(min(CASE WHEN o.w = b.w THEN o.j END), 2)) / 1.64493406685 AS r FROM socc o JOIN sbest b ON b.id = o.id GROUP BY o.id),
snear AS (SELECT id, """ + cosine("embedding", _VECTOR) + """ AS sc FROM sums WHERE embedding IS NOT NULL ORDER BY sc DESC, id LIMIT 30)"""
_HYBRID_SUMS = """SELECT o.id, 'summary' AS type, coalesce(request, '') AS title, coalesce(completed, '') AS subtitle, coalesce(learned, '') AS narrative, project, created_at,
  coalesce(r, 0) AS tr, coalesce(sc, 0) AS ss, coalesce(r, 0) * CAST(0.4 AS DOUBLE) + coalesce(sc, 0) * CAST(0.6 AS DOUBLE) AS cs
  FROM sums o LEFT JOIN srank ON srank.id = o.id LEFT JOIN snear ON snear.id = o.id WHERE srank.id IS NOT NULL OR snear.id IS NOT NULL ORDER BY cs DESC, o.id LIMIT 10"""


@query("hybrid_search_summaries", sql(f"SELECT {_SHOWN} FROM ({_HYBRID_SUMS})", _SUM_TOKENS))
def _(s, d):
    return rounded(search.hybrid_search_summaries(SUMS(s, d), WORD, query_vector(s, d), indexes=indexes(s, d, "summaries")), *search._SCORES)


_HYBRID_ALL_OBS = _HYBRID_OBS.replace(f"o.project = '{PROJECT}' AND ", "")


@query("hybrid_search_all", sql(f"SELECT {_SHOWN} FROM (SELECT * FROM ({_HYBRID_ALL_OBS}) UNION ALL SELECT * FROM ({_HYBRID_SUMS})) ORDER BY cs DESC, type, id LIMIT 10", TOKENS, single_rank(WORD), _hybrid_sql("obs", "TRUE"), _SUM_TOKENS))
def _(s, d):
    both = indexes(s, d, "observations"), indexes(s, d, "summaries")
    return rounded(search.hybrid_search_all(OBS(s, d), SUMS(s, d), WORD, query_vector(s, d), indexes=both), *search._SCORES)


# context

_NUM = f"num AS (SELECT *, row_number() OVER ({NEWEST}) AS n, strftime(created_at, '%b %-d, %Y') AS day, strftime(created_at, '%-I:%M %p') AS time FROM (SELECT * FROM obs WHERE project = '{PROJECT}' {NEWEST} LIMIT 50))"
_LINE = "'| ' || n || ' | ' || time || ' | ' || type || ' | ' || coalesce(title, '') || ' |'"
_FILES = "array_to_string(CASE WHEN len(coalesce(files_modified, [])) > 0 THEN files_modified ELSE files_read END, ', ')"
_ENTRY = f"'#### [' || n || '] ' || coalesce(title, '') || chr(10) || CASE WHEN coalesce(narrative, '') <> '' THEN '> ' || narrative || chr(10) ELSE '' END || CASE WHEN {_FILES} <> '' THEN '> Files: ' || {_FILES} || chr(10) ELSE '' END || chr(10)"
_BY_DAY = f"days AS (SELECT day, min(n) AS first_n, count(*) AS entries, string_agg({_LINE}, chr(10) ORDER BY n) AS lines FROM num GROUP BY day)"


@query("context_numbering", sql("SELECT n, id, day, time FROM num", _NUM))
def _(s, d):
    return context.numbered(_recent(s, d)).select("n", "id", "day", "time")


@query("timeline_by_day", sql("SELECT * FROM days", _NUM, _BY_DAY))
def _(s, d):
    return context.by_day(_recent(s, d))


@query("context_full", sql(f"SELECT n, day, {_ENTRY} AS entry FROM num WHERE n <= 5", _NUM))
def _(s, d):
    return context.full_entries(_recent(s, d), 5)


_SUMMARY_LINE = "'- **Session ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '**: ' || array_to_string(list_filter([request, 'Completed: ' || nullif(completed, ''), 'Learned: ' || nullif(learned, '')], lambda x: x IS NOT NULL AND x <> ''), '. ') || chr(10)"


@query(
    "context_markdown",
    sql(
        f"""SELECT '<memory-context>' || chr(10) || '# Recent Activity' || chr(10) || chr(10) || a.t || '### Recent Sessions' || chr(10) || chr(10) || b.t || chr(10) || '</memory-context>' AS context FROM
        (SELECT string_agg('### ' || days.day || chr(10) || chr(10) || '| # | Time | Type | Title |' || chr(10) || '|---|------|------|-------|' || chr(10) || lines || chr(10) || chr(10) || coalesce(e.t, ''), '' ORDER BY first_n) AS t FROM days LEFT JOIN (SELECT day, string_agg({_ENTRY}, '' ORDER BY n) AS t FROM num WHERE n <= 5 GROUP BY day) e ON e.day = days.day) a,
        (SELECT string_agg({_SUMMARY_LINE}, '' {NEWEST}) AS t FROM (SELECT * FROM sums WHERE project = '{PROJECT}' {NEWEST} LIMIT 10)) b""",
        _NUM,
        _BY_DAY,
    ),
)
def _(s, d):
    return context.markdown(_recent(s, d), lists.recent_summaries(SUMS(s, d), PROJECT))


@query(
    "fallback_summary",
    sql(
        """SELECT s.content_session_id, array_to_string(list_filter(['## User Prompts' || chr(10) || p.t, chr(10) || '## Session Activity' || chr(10) || o.t], lambda x: x IS NOT NULL), chr(10)) AS content
        FROM sess s LEFT JOIN (SELECT content_session_id, string_agg('- ' || prompt, chr(10) ORDER BY prompt_number, id) AS t FROM prompts GROUP BY 1) p ON p.content_session_id = s.content_session_id
        LEFT JOIN (SELECT memory_session_id, string_agg('- [' || type || '] ' || coalesce(title, '') || ': ' || coalesce(narrative, ''), chr(10) ORDER BY created_at_epoch, id) AS t FROM obs GROUP BY 1) o ON o.memory_session_id = s.memory_session_id"""
    ),
)
def _(s, d):
    return context.fallback_summaries(SESS(s, d), PROMPTS(s, d), OBS(s, d))


@query(
    "fallback_lines",
    sql(
        """SELECT content_session_id, 'prompts' AS part, row_number() OVER (PARTITION BY content_session_id ORDER BY prompt_number, id) AS n, '- ' || prompt AS line FROM prompts
        UNION ALL SELECT s.content_session_id, 'activity', row_number() OVER (PARTITION BY s.content_session_id ORDER BY o.created_at_epoch, o.id), '- [' || type || '] ' || coalesce(title, '') || ': ' || coalesce(narrative, '') FROM obs o JOIN sess s ON s.memory_session_id = o.memory_session_id"""
    ),
)
def _(s, d):
    return context.fallback_lines(SESS(s, d), PROMPTS(s, d), OBS(s, d))


# changes


@query("upsert_sessions", sql("SELECT content_session_id, arg_min(started_at_epoch, (gen, started_at_epoch, project)) AS started_at_epoch, arg_max(project, (gen, started_at_epoch, project)) AS project FROM (SELECT content_session_id, project, started_at_epoch, 0 AS gen FROM sess WHERE id % 2 = 0 UNION ALL SELECT content_session_id, 'new' || (id % 5), epoch, 1 FROM (SELECT *, conv_id AS id FROM turns)) GROUP BY 1"))
def _(s, d):
    arriving = memory._turns(s, d).select("content_session_id", F.concat(F.lit("new"), (F.col("conv_id") % 5).cast("string")).alias("project"), F.col("epoch").alias("started_at_epoch"))
    return changes.upsert_sessions(SESS(s, d).filter("id % 2 = 0"), arriving)


@query("upsert_session_rows", sql("SELECT s.id, content_session_id, memory_session_id, coalesce(n.project, s.project) AS project, started_at_epoch, status FROM sess s LEFT JOIN (SELECT content_session_id, arg_max('new' || (conv_id % 5), (epoch, 'new' || (conv_id % 5))) AS project FROM turns GROUP BY 1) n USING (content_session_id) WHERE s.id % 2 = 0 UNION ALL SELECT NULL, content_session_id, 'mem-' || content_session_id, 'new' || (conv_id % 5), min(epoch), 'active' FROM turns WHERE conv_id % 2 = 1 GROUP BY ALL"))
def _(s, d):
    arriving = memory._turns(s, d).select("content_session_id", F.concat(F.lit("new"), (F.col("conv_id") % 5).cast("string")).alias("project"), F.col("epoch").alias("started_at_epoch"))
    out = changes.upsert_session_rows(SESS(s, d).filter("id % 2 = 0"), arriving, F.concat(F.lit("mem-"), F.col("content_session_id")))
    new = F.col("memory_session_id").startswith("mem-")
    return out.select(F.when(~new, F.col("id")).alias("id"), "content_session_id", "memory_session_id", "project", "started_at_epoch", "status")


@query("complete_sessions", sql("SELECT s.id, CASE WHEN t.e IS NULL THEN status ELSE 'completed' END AS status, coalesce(t.e, completed_at_epoch) AS completed_at_epoch FROM sess s LEFT JOIN (SELECT content_session_id, max(created_at_epoch) AS e FROM prompts WHERE id % 3 = 0 GROUP BY 1) t ON t.content_session_id = s.content_session_id"))
def _(s, d):
    stops = PROMPTS(s, d).filter("id % 3 = 0").select("content_session_id", F.col("created_at_epoch").alias("at_epoch"))
    return changes.complete_sessions(SESS(s, d), stops).select("id", "status", "completed_at_epoch")


@query("queue_claim_oldest", sql("SELECT id, content_session_id, message_type, created_at FROM pend WHERE status = 'pending' ORDER BY created_at, id LIMIT 1"))
def _(s, d):
    return changes.claim_oldest(memory.pending_messages(s, d)).select("id", "content_session_id", "message_type", "created_at")


@query("queue_status", sql("SELECT id, CASE WHEN status <> 'processing' THEN status WHEN id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN status = 'processing' AND id % 3 = 0 THEN 'boom' END AS error FROM pend"))
def _(s, d):
    q = memory.pending_messages(s, d)
    results = q.filter("status = 'processing'").select("id", F.when(F.col("id") % 3 == 0, "boom").alias("error"))
    return changes.queue_outcome(q, results).select("id", "status", "error")


@query("queue_route", sql("SELECT message_type, count(*) AS messages, message_type IN ('observation', 'summary') AS handled FROM pend GROUP BY 1, 3"))
def _(s, d):
    return memory.pending_messages(s, d).groupBy("message_type", F.col("message_type").isin("observation", "summary").alias("handled")).agg(F.count("*").alias("messages"))


@query("queue_resolve_session", sql("SELECT q.id, s.memory_session_id, s.project, CASE WHEN s.id IS NULL THEN 'session not found: ' || q.content_session_id END AS error FROM pend q LEFT JOIN sess s ON s.content_session_id = q.content_session_id"))
def _(s, d):
    return changes.resolve_sessions(memory.pending_messages(s, d), SESS(s, d)).select("id", "memory_session_id", "project", "error")


def _sync_tables() -> None:
    for name, (frame, view) in TABLES.items():
        @query(f"sync_unsynced_{name}", sql(f"SELECT id, sync_id, sync_version FROM {view} WHERE sync_id IS NOT NULL AND sync_version = 0 ORDER BY id LIMIT 100"))
        def _(s, d, frame=frame):
            return changes.unsynced(frame(s, d)).select("id", "sync_id", "sync_version")

        @query(f"sync_pull_page_{name}", sql(f"SELECT id, sync_id, sync_source FROM {view} WHERE id > 10 AND sync_source IS DISTINCT FROM 'm1' ORDER BY id LIMIT 100"))
        def _(s, d, frame=frame):
            return changes.pull_page(frame(s, d), "m1", 10).select("id", "sync_id", "sync_source")


_sync_tables()


@query("sync_pull_cursors", sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, max(id) AS cursor, count(*) AS rows FROM (SELECT id FROM {v} WHERE id > 10 AND sync_source IS DISTINCT FROM 'm1' ORDER BY id LIMIT 100)" for n, (_, v) in TABLES.items())))
def _(s, d):
    return changes.pull_cursors({n: changes.pull_page(f(s, d), "m1", 10) for n, (f, _) in TABLES.items()})


@query("sync_stats", sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS total, count(*) FILTER (WHERE sync_id IS NOT NULL AND sync_version = 0) AS unsynced FROM {v}" for n, (_, v) in TABLES.items())))
def _(s, d):
    return changes.sync_stats({n: f(s, d) for n, (f, _) in TABLES.items()})


@query("mark_synced", sql("SELECT id, CASE WHEN sync_id IN (SELECT sync_id FROM obs WHERE sync_version = 0 AND id % 2 = 0 AND sync_id IS NOT NULL) THEN 1800000000 ELSE sync_version END AS sync_version FROM obs"))
def _(s, d):
    o = OBS(s, d)
    return changes.mark_synced(o, o.filter("sync_version = 0 and id % 2 = 0"), 1_800_000_000).select("id", "sync_version")


@query("sync_import_dedup", sql("SELECT id, sync_id FROM obs WHERE sync_id IS NULL OR sync_id NOT IN (SELECT sync_id FROM obs WHERE id % 3 = 0 AND sync_id IS NOT NULL)"))
def _(s, d):
    o = OBS(s, d)
    page = o.select("id", "sync_id")
    return changes.new_rows(page.unionByName(page.filter("sync_id is not null")), o.filter("id % 3 = 0"), "sync_id")


@query("sync_import_counts", sql("SELECT count(*) FILTER (WHERE memory_session_id IN (SELECT memory_session_id FROM sess)) AS received, count(*) FILTER (WHERE memory_session_id NOT IN (SELECT memory_session_id FROM sess)) AS rejected FROM obs"))
def _(s, d):
    return changes.import_counts(OBS(s, d), SESS(s, d))


@query("sync_fk_orphans", sql("SELECT id, memory_session_id FROM obs WHERE memory_session_id NOT IN (SELECT memory_session_id FROM sess WHERE id % 3 <> 0)"))
def _(s, d):
    return changes.orphans(OBS(s, d), SESS(s, d).filter("id % 3 <> 0")).select("id", "memory_session_id")


_PUSHED = " UNION ALL ".join(f"(SELECT 'm1' AS machine_id, '{t}' AS table_name, id, sync_id, CAST({v} AS BIGINT) AS dims FROM {view} WHERE sync_id IS NOT NULL AND sync_version = 0 ORDER BY id LIMIT 100)" for t, view, v in (("sdk_sessions", "sess", "0"), ("observations", "obs", "coalesce(len(embedding), 0)"), ("session_summaries", "sums", "coalesce(len(embedding), 0)"), ("user_prompts", "prompts", "0")))


@query("sync_push_batch", sql(_PUSHED))
def _(s, d):
    body = changes.push_body({"sdk_sessions": SESS(s, d), "observations": VECTORS(s, d), "session_summaries": SUMS(s, d), "user_prompts": PROMPTS(s, d)}, "m1")
    field = lambda name: F.get_json_object("row", f"$.{name}")
    dims = F.coalesce(F.size(F.from_json(field("embedding"), "array<double>")), F.lit(0))
    return changes.pushed_rows(body).select("machine_id", "table_name", field("id").cast("long").alias("id"), field("sync_id").alias("sync_id"), F.greatest(dims, F.lit(0)).cast("long").alias("dims"))


def _imported_sql(table: str, view: str, own: str, where: str) -> str:
    return f"SELECT '{table}' AS table_name, (SELECT max(id) FROM {view} WHERE {own}) + row_number() OVER (ORDER BY id) AS id, sync_id, id AS remote_id FROM {view} t WHERE sync_source IS DISTINCT FROM 'm1' AND (sync_id IS NULL OR sync_id NOT IN (SELECT sync_id FROM {view} WHERE {own} AND sync_id IS NOT NULL)) AND {where}"


_KNOWN = "known AS (SELECT * FROM sess WHERE id % 3 = 0 OR sync_source IS DISTINCT FROM 'm1')"
_IMPORTED = " UNION ALL ".join(
    [
        _imported_sql("sdk_sessions", "sess", "id % 3 = 0", "id % 3 <> 0"),
        _imported_sql("observations", "obs", "id % 2 = 0", "memory_session_id IN (SELECT memory_session_id FROM known)"),
        _imported_sql("session_summaries", "sums", "id % 2 = 0", "memory_session_id IN (SELECT memory_session_id FROM known)"),
        _imported_sql("user_prompts", "prompts", "id % 2 = 0", "content_session_id IN (SELECT content_session_id FROM known) AND id % 2 <> 0"),
    ]
)


@query("sync_import_tables", sql(_IMPORTED, _KNOWN))
def _(s, d):
    """What a pull brings to tables that hold some of the rows: the rest, with ids of their own."""
    tables = {"sdk_sessions": (SESS(s, d), 3), "observations": (OBS(s, d), 2), "session_summaries": (SUMS(s, d), 2), "user_prompts": (PROMPTS(s, d), 2)}
    local = {t: df.filter(F.col("id") % n == 0) for t, (df, n) in tables.items()}
    incoming = {}
    for t, (df, _) in tables.items():
        df = df.withColumn("remote_id", F.col("id"))
        seen = df.filter(~F.col("sync_source").eqNullSafe("m1"))
        rows = seen.select(F.lit(COLLECTIONS[t]).alias("collection"), F.to_json(F.struct(*df.columns)).alias("row"))
        incoming[t] = changes.table_rows(rows, COLLECTIONS[t], df.schema)
    first = {t: df.agg(F.max("id")).first()[0] + 1 for t, df in local.items()}
    made = changes.imported(incoming, local, first)
    return reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("table_name"), "id", "sync_id", "remote_id") for t, df in made.items()])


@query("default_sync_source", sql("SELECT id, coalesce(sync_source, (SELECT value FROM setts WHERE key = 'machine_id'), 'unknown') AS sync_source FROM obs"))
def _(s, d):
    return changes.default_source(OBS(s, d), memory.settings(s, d)).select("id", "sync_source")


@query("settings_map", sql("SELECT key, value FROM setts"))
def _(s, d):
    return memory.settings(s, d)


@query("settings_upsert", sql("SELECT key, arg_max(value, (seq, value)) AS value FROM (SELECT key, value, -1 AS seq FROM setts UNION ALL SELECT 'client_push:u' || user_id, event_type, event_id FROM events) GROUP BY key"))
def _(s, d):
    incoming = memory.read(s, d, "events").select(F.concat(F.lit("client_push:u"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return changes.settings_upsert(memory.settings(s, d), incoming)


_DEFAULTS = {"context_observations": "50", "log_level": "info", "client_push:u1": "none", "pull_cursor:u3": "7", "machine_id": "local"}
_ENV = {"log_level": "debug"}


@query("settings_overlay", sql("SELECT t.key, coalesce(env, CASE WHEN regexp_matches(fallback, '^[0-9]+$') AND TRY_CAST(value AS INTEGER) IS NULL THEN NULL ELSE nullif(value, '') END, fallback) AS value FROM (VALUES " + ", ".join(f"('{k}', '{v}', {repr(_ENV[k]) if k in _ENV else 'NULL'})" for k, v in _DEFAULTS.items()) + ") t(key, fallback, env) LEFT JOIN setts ON setts.key = t.key"))
def _(s, d):
    return changes.overlay_settings(_DEFAULTS, memory.settings(s, d), _ENV)


@query("client_sync_times", sql("SELECT substring(key, 13) AS machine_id, max(CASE WHEN key LIKE 'client\\_push:%' ESCAPE '\\' THEN CAST(replace(value, 'Z', '') AS TIMESTAMP) END) AS last_push, max(CASE WHEN key LIKE 'client\\_pull:%' ESCAPE '\\' THEN CAST(replace(value, 'Z', '') AS TIMESTAMP) END) AS last_pull FROM setts WHERE (key LIKE 'client\\_push:%' ESCAPE '\\' OR key LIKE 'client\\_pull:%' ESCAPE '\\') AND length(key) > 12 GROUP BY 1"))
def _(s, d):
    return changes.client_sync_times(memory.settings(s, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_push", "last_pull")})


@query("apply_embeddings", sql("SELECT o.id, e.label IS NOT NULL AS arrived, coalesce(list_sum(CAST(coalesce(e.embedding, o.embedding)[1:1] AS DOUBLE[])), 0) AS first FROM obs o LEFT JOIN (SELECT vec_id + 200 AS id, embedding, label FROM embeddings) e ON e.id = o.id"))
def _(s, d):
    e = memory.read(s, d, "embeddings").select((F.col("vec_id") + 200).alias("id"), "embedding")
    out = changes.apply_embeddings(VECTORS(s, d), e).join(e.select("id", F.lit(True).alias("a")), "id", "left")
    return out.select("id", F.coalesce("a", F.lit(False)).alias("arrived"), F.coalesce(F.try_element_at("embedding", F.lit(1)).cast("double"), F.lit(0.0)).alias("first"))


@query("backfill_embeddings")
def _(s, d):
    o = VECTORS(s, d).filter("embedding is null").select("id", scalar.embedding_text(*map(F.col, ("title", "subtitle", "narrative"))).alias("t"))
    return embed(o, "t", HashEmbedder()).select("id", "embedding")


# legacy import

_LEGACY_AT = "CASE WHEN id % 2 = 0 THEN created_at_epoch * 1000 ELSE created_at_epoch END"
_SEC = "CASE WHEN {0} > 1000000000000 THEN {0} // 1000 ELSE {0} END"


@query("epoch_normalize", sql(f"SELECT id, {_SEC.format('e')} AS epoch FROM (SELECT id, CASE WHEN id % 17 = 0 THEN NULL ELSE {_LEGACY_AT} END AS e FROM obs)"))
def _(s, d):
    e = F.when(F.col("id") % 17 != 0, F.when(F.col("id") % 2 == 0, F.col("created_at_epoch") * 1000).otherwise(F.col("created_at_epoch")))
    return OBS(s, d).select("id", scalar.epoch_seconds(e).alias("epoch"))


_LISTS = "CASE id % 5 WHEN 0 THEN '[\"a\", \"b\"]' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '[broken' ELSE 'null' END"


@query("json_array_normalize", sql("SELECT id, CASE id % 5 WHEN 0 THEN '[\"a\", \"b\"]' WHEN 4 THEN 'null' ELSE '[]' END AS list FROM obs"))
def _(s, d):
    return OBS(s, d).select("id", js.json_array_or_empty(F.expr(_LISTS)).alias("list"))


@query("legacy_import_sessions", sql("SELECT content_session_id, started_at_epoch, completed_at_epoch FROM sess WHERE id % 4 <> 0"))
def _(s, d):
    raw = SESS(s, d).withColumns({"started_at": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("string"), "started_at_epoch": F.col("started_at_epoch") * 1000, "completed_at_epoch": F.col("completed_at_epoch") * 1000})
    return changes.legacy_sessions(raw, SESS(s, d).filter("id % 4 = 0")).select("content_session_id", "started_at_epoch", "completed_at_epoch")


@query("legacy_import_observations", sql("SELECT id, sync_id, created_at_epoch, created_at, CASE id % 5 WHEN 0 THEN '[\"a\", \"b\"]' WHEN 4 THEN 'null' ELSE '[]' END AS facts FROM obs WHERE sync_id IS NULL OR id % 3 <> 0"))
def _(s, d):
    o = OBS(s, d)
    raw = o.select("id", "sync_id", F.lit("no time").alias("created_at"), F.expr(_LEGACY_AT).alias("created_at_epoch"), F.expr(_LISTS).alias("facts"))
    return changes.legacy_rows(raw, o.filter("id % 3 = 0"), ("facts",)).select("id", "sync_id", "created_at_epoch", "created_at", "facts")


# times as older stores have them: ISO with and without fractions and offsets, none, and what is no time
_LEGACY_TIMES = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'.250Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")


@query("legacy_import_times", sql("SELECT id, created_at_epoch, CASE id % 5 WHEN 0 THEN created_at + INTERVAL 1 DAY WHEN 1 THEN created_at + INTERVAL 1 DAY + INTERVAL 250 MILLISECOND WHEN 2 THEN created_at + INTERVAL 22 HOUR ELSE created_at END AS created_at FROM obs"))
def _(s, d):
    o = OBS(s, d)
    later = F.timestamp_seconds(F.col("created_at_epoch") + 86400)
    text = F.lit(None).cast("string")
    for k, form in enumerate(_LEGACY_TIMES):
        text = F.when(F.col("id") % 5 == k, F.date_format(later, form)).otherwise(text)
    raw = o.select("id", "sync_id", F.when(F.col("id") % 5 == 3, "no time").otherwise(text).alias("created_at"), F.expr(_LEGACY_AT).alias("created_at_epoch"), F.lit("[]").alias("facts"))
    return changes.legacy_rows(raw, o.limit(0), ("facts",)).select("id", "created_at_epoch", "created_at")


@query("legacy_import_summaries", sql("SELECT id, sync_id, created_at_epoch FROM sums WHERE sync_id IS NULL OR id % 3 <> 0"))
def _(s, d):
    u = SUMS(s, d)
    raw = u.select("id", "sync_id", F.lit(None).cast("string").alias("created_at"), (F.col("created_at_epoch") * 1000).alias("created_at_epoch"), F.lit("[]").alias("files_read"))
    return changes.legacy_rows(raw, u.filter("id % 3 = 0"), ("files_read",)).select("id", "sync_id", "created_at_epoch")


@query("legacy_import_prompts", sql("SELECT p.id, p.content_session_id, p.prompt_number, p.prompt, s.project, p.created_at_epoch FROM prompts p JOIN sess s ON s.content_session_id = p.content_session_id WHERE s.id % 2 = 0 AND p.id % 3 <> 0"))
def _(s, d):
    p = PROMPTS(s, d)
    raw = p.select("id", "content_session_id", "prompt_number", F.col("prompt").alias("prompt_text"), (F.col("created_at_epoch") * 1000).alias("created_at_epoch"))
    return changes.legacy_prompts(raw, SESS(s, d).filter("id % 2 = 0"), p.filter("id % 3 = 0")).select("id", "content_session_id", "prompt_number", "prompt", "project", "created_at_epoch")


@query("import_verify", sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS source_rows, count(*) FILTER (WHERE id % 9 <> 0) AS target_rows, count(*) FILTER (WHERE id % 9 <> 0) >= count(*) AS complete FROM {v}" for n, (_, v) in TABLES.items())))
def _(s, d):
    return changes.import_verify({n: f(s, d) for n, (f, _) in TABLES.items()}, {n: f(s, d).filter("id % 9 <> 0") for n, (f, _) in TABLES.items()})


# scalar functions over real columns


def _pages(s: SparkSession, d: str) -> DataFrame:
    return memory.read(s, d, "pages").select("page_id", "url")


@query("project_from_path", "SELECT page_id, CASE WHEN rtrim(url, '/') = '' THEN '/' ELSE list_extract(string_split(rtrim(url, '/'), '/'), -1) END AS project FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", scalar.project_from_path(F.col("url")).alias("project"))


@query("project_filter", sql("SELECT project, lower(project) IN ('src1', 'src3', 'src5') AS allowed, lower(project) NOT IN ('src2') AS not_denied FROM (SELECT DISTINCT project FROM obs)"))
def _(s, d):
    p = OBS(s, d).select("project").distinct()
    return p.select("project", scalar.project_allowed(F.col("project"), F.lit("SRC1, src3 ,,src5"), F.lit("src1")).alias("allowed"), scalar.project_allowed(F.col("project"), F.lit(" "), F.lit("Src2")).alias("not_denied"))


@query("tool_skip_filter", "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click')")
def _(s, d):
    return memory.read(s, d, "events").filter(scalar.tool_kept(F.col("event_type"), F.lit("View, CLICK"))).select("event_id")


@query("normalize_provider", "SELECT event_id, CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'codex' WHEN 'error' THEN 'gemini' END AS provider FROM events")
def _(s, d):
    raw = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", " CODEX ").when(F.col("event_type") == "error", "Gemini").otherwise("other")
    return memory.read(s, d, "events").select("event_id", scalar.normalize_provider(raw).alias("provider"))


@query("normalize_hook", "SELECT event_id, 'u' || user_id AS session_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS tool_name, CASE WHEN event_id % 2 = 0 THEN 'hello' END AS prompt, '/w/' || user_id AS cwd, '{\"k\":' || (props ->> '$.k') || '}' AS tool_input FROM events")
def _(s, d):
    e = memory.read(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    tool = F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type"))
    made = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sessionId"), tool.alias("toolName"), F.when(F.col("event_id") % 2 == 0, "hello").alias("userPrompt"), F.lit("").alias("prompt"), F.struct("k").alias("toolInput")))
    cwd = F.concat(F.lit("/w/"), F.col("user_id").cast("string"))
    return e.select("event_id", *js.normalize_hook(made, cwd)).select("event_id", "session_id", "tool_name", "prompt", "cwd", "tool_input")


@query("strip_reminders", "SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN '<system-reminder>x' || chr(10) || 'y</system-reminder> ' || text ELSE text || ' <system-reminder></system-reminder>' END, '<system-reminder>.*?</system-reminder>', '', 'gs')) AS text FROM conversations")
def _(s, d):
    wrapped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<system-reminder>x\ny</system-reminder> "), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit(" <system-reminder></system-reminder>")))
    return memory.read(s, d, "conversations").select("conv_id", "turn", scalar.strip_reminders(wrapped).alias("text"))


@query("content_text", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || role END AS content FROM conversations")
def _(s, d):
    c = memory.read(s, d, "conversations")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    plain = F.substring(F.to_json(F.array("text")), F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    return c.select("conv_id", "turn", js.content_text(F.when(F.col("turn") % 2 == 0, plain).otherwise(blocks)).alias("content"))


@query("last_assistant_message", "SELECT 'c' || conv_id AS path, trim(arg_max(text, turn)) AS message FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(s, d):
    c = memory.read(s, d, "conversations")
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.when(F.col("turn") % 4 == 1, F.col("text")).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")))).alias("content")).alias("message")))
    lines = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("line_no"), line.alias("value"))
    broken = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") + 100).alias("line_no"), F.lit("{broken").alias("value"))
    return memory.last_assistant_messages(lines.unionByName(broken))


@query("truncate_text", "SELECT doc_id, CASE WHEN strlen(text) <= 900 THEN text ELSE left(text, list_max(list_filter(range(200, 901), lambda n: strlen(left(text, n)) <= 900))) || '... (truncated)' END AS text FROM documents")
def _(s, d):
    return memory.read(s, d, "documents").select("doc_id", scalar.truncate_bytes(F.col("text"), 900).alias("text"))


@query("rfc3339", sql("SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM obs"))
def _(s, d):
    return OBS(s, d).select("id", scalar.rfc3339(F.col("created_at")).alias("at"))


@query("random_ids", sql("SELECT count(*) AS ids, true AS formed FROM obs"))
def _(s, d):
    made = OBS(s, d).select(scalar.random_id().alias("r"))
    return made.agg(F.count_distinct("r").alias("ids"), F.bool_and(F.col("r").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("formed"))


def _listed(body: DataFrame, kind: str) -> DataFrame:
    rows = F.from_json(F.get_json_object("body", f"$.{kind}"), "array<string>")
    return body.select(F.get_json_object("body", "$.total").alias("total"), F.posexplode(rows).alias("n", "r"))


@query("summaries_response_json", sql(f"SELECT CAST(count(*) OVER () AS VARCHAR) AS total, CAST(row_number() OVER ({NEWEST}) - 1 AS INTEGER) AS n, id, memory_session_id, nullif(request, '') AS request, nullif(completed, '') AS completed, 8 - CAST(coalesce(request, '') = '' AS INTEGER) - CAST(coalesce(completed, '') = '' AS INTEGER) - CAST(coalesce(learned, '') = '' AS INTEGER) - CAST(coalesce(next_steps, '') = '' AS INTEGER) AS fields, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM (SELECT * FROM sums WHERE project = '{PROJECT}' {NEWEST} LIMIT 20)"))
def _(s, d):
    rows = lists.list_summaries(SUMS(s, d), PROJECT).withColumns({"created_at": F.timestamp_seconds("created_at_epoch"), "notes": F.lit("")})
    body = js.list_response(rows, "summaries", (-F.col("created_at_epoch"), -F.col("id")))
    field = lambda n: F.get_json_object("r", f"$.{n}")
    fields = F.size(F.json_object_keys("r"))
    return _listed(body, "summaries").select("total", "n", field("id").cast("long").alias("id"), field("memory_session_id").alias("memory_session_id"), field("request").alias("request"), field("completed").alias("completed"), fields.alias("fields"), field("created_at").alias("created_at"))


@query("prompts_response_json", sql(f"SELECT CAST(count(*) OVER () AS VARCHAR) AS total, CAST(row_number() OVER ({NEWEST}) - 1 AS INTEGER) AS n, id, prompt, prompt_number, strftime(make_timestamp(created_at_epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM (SELECT * FROM prompts WHERE project = '{PROJECT}' {NEWEST} LIMIT 50)"))
def _(s, d):
    rows = lists.list_prompts(PROMPTS(s, d), PROJECT).withColumn("created_at", F.timestamp_seconds("created_at_epoch"))
    field = lambda n: F.get_json_object("r", f"$.{n}")
    body = js.list_response(rows, "prompts", (-F.col("created_at_epoch"), -F.col("id")))
    return _listed(body, "prompts").select("total", "n", field("id").cast("long").alias("id"), field("prompt").alias("prompt"), field("prompt_number").cast("long").alias("prompt_number"), field("created_at").alias("created_at"))


@query("search_response_json", sql(f"SELECT CAST(count(*) OVER () AS VARCHAR) AS total, 'fi\"le' AS query, id, title, project, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM (SELECT {PLAIN} FROM obs WHERE project = '{PROJECT}' AND (list_contains(coalesce(files_read, []), '{_FILE}') OR list_contains(coalesce(files_modified, []), '{_FILE}')) {NEWEST} LIMIT 20)"))
def _(s, d):
    found = search.search_by_file(OBS(s, d), _FILE, PROJECT)
    body = js.response(found, 'fi"le', (-F.unix_timestamp("created_at"), -F.col("id")))
    field = lambda n: F.get_json_object("r", f"$.{n}")
    rows = body.select(F.get_json_object("body", "$.total").alias("total"), F.get_json_object("body", "$.query").alias("query"), F.explode(F.from_json(F.get_json_object("body", "$.results"), "array<string>")).alias("r"))
    return rows.select("total", "query", field("id").cast("long").alias("id"), field("title").alias("title"), field("project").alias("project"), field("created_at").alias("created_at"))


@query("stats_json", sql("SELECT '{\"sessions\":' || (SELECT count(*) FROM sess) || ',\"observations\":' || (SELECT count(*) FROM obs) || ',\"summaries\":' || (SELECT count(*) FROM sums) || '}' AS json"))
def _(s, d):
    return js.encoded(lists.stats(OBS(s, d), SUMS(s, d), SESS(s, d)), "stats").select("json")


@query("parse_summary_json", "SELECT event_id, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 <> 0 THEN event_type END AS request FROM events")
def _(s, d):
    o = js.parse_summary(F.when(F.col("event_id") % 3 == 0, "[]").otherwise(F.to_json(F.struct(F.col("event_type").alias("request")))))
    return memory.read(s, d, "events").select("event_id", o.isNotNull().alias("valid"), o["request"].alias("request"))


@query("append_batches", sql("SELECT id, sync_id, id % 3 AS batch FROM obs"))
def _(s, d):
    o = OBS(s, d).select("id", "sync_id")
    made = versions.AppendedTable(s, f"{versions.scratch_path(s)}/observations", "id bigint, sync_id string")
    for n in (0, 1, 2, 1):  # a batch that is written again replaces itself
        made.append(o.filter(F.col("id") % 3 == n), n)
    return made.read()


@query("embedding_text", sql("SELECT id, coalesce(title, '') || ' ' || coalesce(subtitle, '') || ' ' || coalesce(narrative, '') || CASE WHEN facts IS NULL THEN '' ELSE ' ' || array_to_string(facts, ' ') END AS live, coalesce(title, '') || ' ' || coalesce(subtitle, '') || ' ' || coalesce(narrative, '') AS backfill FROM obs"))
def _(s, d):
    parts = list(map(F.col, ("title", "subtitle", "narrative")))
    return OBS(s, d).select("id", scalar.embedding_text(*parts, facts=F.col("facts")).alias("live"), scalar.embedding_text(*parts).alias("backfill"))


@query("llm_prompt", "SELECT event_id, 'Tool: ' || event_type || chr(10) || 'Project: p' || user_id || chr(10) || 'Working Directory: /w' || chr(10) || chr(10) || 'Input:' || chr(10) || props || chr(10) || chr(10) || 'Output:' || chr(10) || 'ok' AS prompt FROM events")
def _(s, d):
    return memory.read(s, d, "events").select("event_id", scalar.tool_prompt(F.col("event_type"), F.col("props"), F.lit("ok"), F.lit("/w"), F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("prompt"))


@query("summary_prompt", "SELECT conv_id, turn, strlen(text) > 8000 AS cut, CASE WHEN strlen(text) <= 8000 THEN 'Project: p' || chr(10) || chr(10) || 'Last assistant message:' || chr(10) || text END AS prompt FROM conversations")
def _(s, d):
    c = memory.read(s, d, "conversations").withColumn("cut", F.octet_length("text") > 8000)
    return c.select("conv_id", "turn", "cut", F.when(~F.col("cut"), scalar.summary_prompt(F.col("text"), F.lit("p"))).alias("prompt"))


@query(
    "llm_prompt_cut",
    """WITH chars AS (SELECT doc_id, strlen(c) AS b, i FROM (SELECT doc_id, unnest(string_split(left(text, 4000), '')) AS c, generate_subscripts(string_split(left(text, 4000), ''), 1) AS i FROM documents)),
    cuts AS (SELECT doc_id, count(*) FILTER (b <= 4000) AS n FROM (SELECT doc_id, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM chars) GROUP BY doc_id)
    SELECT doc_id, 'Tool: Read' || chr(10) || 'Project: ' || source || chr(10) || 'Working Directory: /w' || chr(10) || chr(10) || 'Input:' || chr(10) || CASE WHEN strlen(text) <= 4000 THEN text ELSE left(text, n) || '... (truncated)' END || chr(10) || chr(10) || 'Output:' || chr(10) || 'ok' AS prompt FROM documents LEFT JOIN cuts USING (doc_id)""",
)
def _(s, d):
    c = memory.read(s, d, "documents")
    return c.select("doc_id", scalar.tool_prompt(F.lit("Read"), F.col("text"), F.lit("ok"), F.lit("/w"), F.col("source")).alias("prompt"))


@query("parse_observation_json", "SELECT event_id, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 <> 0 THEN event_type END AS title, CASE WHEN event_id % 3 <> 0 THEN ['a', event_type] END AS facts FROM events")
def _(s, d):
    good = F.to_json(F.struct(F.col("event_type").alias("title"), F.array(F.lit("a"), F.col("event_type")).alias("facts")))
    o = js.parse_observation(F.when(F.col("event_id") % 3 == 0, "not json").otherwise(good))
    return memory.read(s, d, "events").select("event_id", o.isNotNull().alias("valid"), o["title"].alias("title"), o["facts"].alias("facts"))


@query("mask_key", sql("SELECT key, CASE WHEN key = '' THEN '' WHEN length(key) <= 4 THEN '****' ELSE repeat('*', length(key) - 4) || right(key, 4) END AS masked FROM setts"))
def _(s, d):
    return memory.settings(s, d).select("key", scalar.mask_key(F.col("key")).alias("masked"))


@query("redact_url", "SELECT page_id, 'postgresql://user:***@' || url AS url FROM pages")
def _(s, d):
    return _pages(s, d).select("page_id", scalar.redact_url(F.concat(F.lit("postgresql://user:pass"), F.col("page_id").cast("string"), F.lit("@"), F.col("url"))).alias("url"))


_LINES = "SELECT event_id AS seq, '6:20PM ' || CASE event_type WHEN 'error' THEN 'ERR' WHEN 'view' THEN 'DBG' WHEN 'click' THEN 'INF' WHEN 'signup' THEN 'WRN' ELSE '???' END || ' ' || event_type || ' v' AS line, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, CASE WHEN event_type = 'purchase' THEN '6:20PM ??? purchase v' ELSE event_type || ' v' END AS message FROM events"


def _log(s: SparkSession, d: str) -> DataFrame:
    e = memory.read(s, d, "events")
    tag = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("error", "ERR", "view", "DBG", "click", "INF", "signup", "WRN"))), F.col("event_type")), F.lit("???"))
    lines = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("6:20PM "), tag, F.lit(" "), F.col("event_type"), F.lit(" v")).alias("line"))
    return lines.select("seq", "line", scalar.log_level(F.col("line")).alias("level"), scalar.log_message(F.col("line")).alias("message"))


@query("parse_log_line", _LINES)
def _(s, d):
    return _log(s, d)


@query("log_level_filter", f"SELECT seq, level FROM ({_LINES}) WHERE level IN ('warn', 'error')")
def _(s, d):
    return _log(s, d).filter(scalar.level_reaches(F.col("level"), F.lit("warn"))).select("seq", "level")


@query("log_tail", f"SELECT seq, level, message FROM ({_LINES}) WHERE level IN ('warn', 'error') ORDER BY seq DESC LIMIT 5000")
def _(s, d):
    return changes.log_tail(_log(s, d), 5000, "warn").select("seq", "level", "message")


# streams over the given tables: they run until what is there is done, and what they wrote is read back

_TOOL_EVENTS = "SELECT 'u' || user_id AS session_id, event_type AS tool_name, 'p' || (user_id % 5) AS project, count(*) AS events FROM events WHERE event_type NOT IN ('view') AND user_id % 5 <> 3 GROUP BY ALL"


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    return s.readStream.schema(memory.read(s, d, name).schema).parquet(f"{d}/{name}.parq[u]et")


def _run(df: DataFrame, s: SparkSession, mode: str = "append") -> DataFrame:
    path = versions.scratch_path(s)
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(df.schema).parquet(f"{path}/out")


def _hooks(e: DataFrame) -> DataFrame:
    """The events table as raw hook payloads."""
    body = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sessionId"), F.col("event_type").alias("toolName"), F.col("props").alias("toolInput"), F.concat(F.lit("/w/p"), (F.col("user_id") % 5).cast("string")).alias("cwd")))
    return e.select(F.lit("post-tool-use").alias("event"), F.col("ts").cast("timestamp").alias("received_at"), body.alias("payload"))


@query("hook_stream", _TOOL_EVENTS)
def _(s, d):
    events = ingest.accepted_tools(ingest.normalized(_hooks(_stream(s, d, "events"))), deny="P3", skip="View")
    return _run(events, s).groupBy("session_id", "tool_name", "project").agg(F.count("*").alias("events"))


_KINDS = "CASE event_type WHEN 'view' THEN 'session-start' WHEN 'click' THEN 'prompt-submit' WHEN 'error' THEN 'stop' ELSE 'post-tool-use' END"
_HOOKED = f"(SELECT *, {_KINDS} AS event, 'u' || user_id AS s, 'p' || (user_id % 5) AS project FROM events WHERE user_id % 5 <> 3)"


def _branches(s: SparkSession, d: str) -> ingest.Branches:
    """The events table as hook events of all kinds; every second stop brings its last message."""
    e = memory.read(s, d, "events")
    kinds = F.create_map(*map(F.lit, ("view", "session-start", "click", "prompt-submit", "error", "stop")))
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("please do "), F.col("event_id").cast("string")))
    last = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("done "), F.col("event_id").cast("string")))
    body = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sessionId"), F.col("event_type").alias("toolName"), F.col("props").alias("toolInput"), said.alias("userPrompt"), last.alias("lastAssistantMessage"), F.concat(F.lit("/w/p"), (F.col("user_id") % 5).cast("string")).alias("cwd")))
    raw = e.select(F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("post-tool-use")).alias("event"), F.col("ts").cast("timestamp").alias("received_at"), body.alias("payload"))
    known = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("content_session_id"), "user_id").distinct().select("content_session_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("from "), F.col("content_session_id"))).otherwise("").alias("content"))
    return ingest.fan_out(ingest.normalized(raw), known, deny="P3")


@query("hook_session_start", f"SELECT s AS session_id, project, count(*) AS n FROM {_HOOKED} WHERE event = 'session-start' GROUP BY ALL")
def _(s, d):
    return _branches(s, d).contexts.groupBy("session_id", "project").agg(F.count("*").alias("n"))


@query("hook_prompt_submit", f"SELECT s AS content_session_id, project, 'please do ' || event_id AS prompt FROM {_HOOKED} WHERE event = 'prompt-submit'")
def _(s, d):
    return _branches(s, d).prompts.select("content_session_id", "project", "prompt")


@query("hook_prompt_embedding", f"SELECT 'please do ' || event_id AS prompt, 64 AS dimensions FROM {_HOOKED} WHERE event = 'prompt-submit'")
def _(s, d):
    return embed(_branches(s, d).prompts.select("prompt"), "prompt", HashEmbedder()).select("prompt", F.size("embedding").alias("dimensions"))


@query("hook_stop", f"SELECT s AS content_session_id, message_type, count(*) AS n, min(m) AS least FROM (SELECT s, 'summary' AS message_type, CASE WHEN event_id % 2 = 0 THEN 'done ' || event_id WHEN user_id % 2 = 0 THEN 'from ' || s END AS m FROM {_HOOKED} WHERE event = 'stop' UNION ALL SELECT s, 'observation', 'o' FROM {_HOOKED} WHERE event = 'post-tool-use') WHERE m IS NOT NULL GROUP BY ALL")
def _(s, d):
    q = _branches(s, d).messages
    said = F.when(F.col("message_type") == "observation", "o").otherwise(F.get_json_object("payload", "$.last_assistant_message"))
    return q.groupBy("content_session_id", "message_type").agg(F.count("*").alias("n"), F.min(said).alias("least"))


@query("hook_sessions_over", f"SELECT s AS content_session_id, CAST(max(epoch(date_trunc('second', ts))) AS BIGINT) AS at_epoch FROM {_HOOKED} WHERE event = 'stop' GROUP BY 1")
def _(s, d):
    return _branches(s, d).stops.groupBy("content_session_id").agg(F.max("at_epoch").alias("at_epoch"))


@query("queue_enqueue", "SELECT content_session_id, message_type, status, created_at FROM (SELECT 'u' || user_id AS content_session_id, 'observation' AS message_type, 'pending' AS status, epoch_us(ts) AS created_at FROM events)")
def _(s, d):
    queue = ingest.queue_messages(ingest.accepted_tools(ingest.normalized(_hooks(_stream(s, d, "events")))))
    return _run(queue, s).select("content_session_id", "message_type", "status", F.unix_micros("created_at").alias("created_at"))


@query("stream_prompt_numbering", "SELECT 'c' || conv_id AS session_id, text AS prompt, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS BIGINT) AS prompt_number FROM conversations WHERE role = 'user'")
def _(s, d):
    said = _stream(s, d, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.timestamp_seconds(F.lit(memory.EPOCH0) + F.col("turn") * 60).alias("received_at"), F.col("text").alias("prompt"))
    path = versions.scratch_path(s)
    store = TableSet(s, f"{path}/numbered", ingest.NUMBERED)
    ingest.run_numbering(said, store, f"{path}/state", availableNow=True).awaitTermination()
    return store.read("prompts").select("session_id", "prompt", "prompt_number")


# what sessions come to, an hour of silence after their last work; of a stop before the first work nothing is said
_LIVES = f"""begun AS (SELECT s, min(ts) AS started, max(ts) AS last, arg_max(project, ts) AS project FROM {_HOOKED} WHERE event IN ('prompt-submit', 'post-tool-use') GROUP BY s),
ended AS (SELECT s, max(ts) AS stopped FROM {_HOOKED} WHERE event = 'stop' GROUP BY s),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM {_HOOKED})"""


@query("session_lives", f"WITH {_LIVES} SELECT s AS session_id, project, CASE WHEN stopped >= started OR date_trunc('milliseconds', last) + INTERVAL 1 HOUR <= w THEN 'completed' ELSE 'active' END AS status, epoch_us(started) AS started_at, epoch_us(CASE WHEN stopped >= started THEN stopped WHEN date_trunc('milliseconds', last) + INTERVAL 1 HOUR <= w THEN last + INTERVAL 1 HOUR END) AS ended_at, CASE WHEN stopped >= started THEN 'stop' WHEN date_trunc('milliseconds', last) + INTERVAL 1 HOUR <= w THEN 'silence' END AS ended_by FROM begun LEFT JOIN ended USING (s), mark")
def _(s, d):
    e = _stream(s, d, "events").filter("user_id % 5 <> 3")
    kinds = F.create_map(*map(F.lit, ("view", "session-start", "click", "prompt-submit", "error", "stop")))
    events = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("post-tool-use")).alias("event"), F.col("ts").cast("timestamp").alias("received_at"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"))
    lifecycle.state_store(s)
    told = _run(lifecycle.session_lives(events, timedelta(hours=1)), s)
    last = told.groupBy("session_id").agg(F.max_by(F.struct(*told.columns[2:]), "version").alias("r")).select("session_id", "r.*")
    return last.select("session_id", "project", "status", F.unix_micros("started_at").alias("started_at"), F.unix_micros("ended_at").alias("ended_at"), "ended_by")


@query("stream_without_replays", "SELECT count(DISTINCT (user_id, ts, event_type)) AS messages FROM events")
def _(s, d):
    queue = ingest.queue_messages(ingest.normalized(_hooks(_stream(s, d, "events").union(_stream(s, d, "events")))).withColumn("project", F.lit("p")))
    return _run(ingest.without_replays(queue, "60 days"), s).agg(F.count("*").alias("messages"))


# the same changes on stored tables: an upsert rewrites the parts that it touches


def _stored(s: SparkSession, rows: DataFrame, schema: str, key: str) -> TableSet:
    store = TableSet(s, versions.scratch_path(s), {"t": (schema, key)})
    store.commit(store.manifest(), {"t": Change(rows)})
    return store


@query("upsert_sessions_stored", ORACLES["upsert_sessions"])
def _(s, d):
    old = SESS(s, d).filter("id % 2 = 0").select("content_session_id", "project", "started_at_epoch")
    store = _stored(s, old, "content_session_id string, project string, started_at_epoch bigint", "content_session_id")
    arriving = memory._turns(s, d).select("content_session_id", F.concat(F.lit("new"), (F.col("conv_id") % 5).cast("string")).alias("project"), F.col("epoch").alias("started_at_epoch"))
    store.upsert("t", arriving, changes.upsert_sessions)
    return store.read("t")


@query("settings_upsert_stored", ORACLES["settings_upsert"])
def _(s, d):
    store = _stored(s, memory.settings(s, d), "key string, value string", "key")
    incoming = memory.read(s, d, "events").select(F.concat(F.lit("client_push:u"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    store.upsert("t", incoming, changes.settings_upsert)
    return store.read("t")


@query("mark_synced_stored", ORACLES["mark_synced"])
def _(s, d):
    o = OBS(s, d).select("id", "sync_id", "sync_version")
    store = _stored(s, o, "id bigint, sync_id string, sync_version bigint", "id")
    accepted = o.filter("sync_version = 0 and id % 2 = 0 and sync_id is not null")
    store.upsert("t", accepted, lambda rows, taken: changes.mark_synced(rows, taken, 1_800_000_000))
    return store.read("t").select("id", "sync_version")
