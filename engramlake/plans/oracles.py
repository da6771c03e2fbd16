"""The logical tables once more, as SQL for DuckDB over the driver's views."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import stemming

PRELUDE = """
obs AS (
  SELECT d.doc_id AS id, 'm' || (d.doc_id % 97) AS memory_session_id, d.source AS project, d.lang AS type,
    CASE WHEN d.doc_id % 13 <> 0 THEN substring(d.text, 1, 80) END AS title,
    CASE WHEN d.doc_id % 3 <> 0 THEN substring(d.text, 81, 40) END AS subtitle,
    d.text AS narrative, CAST(NULL AS VARCHAR) AS text, 1704067200 + d.doc_id * 600 AS created_at_epoch, e.embedding,
    make_timestamp((1704067200 + d.doc_id * 600) * 1000000) AS created_at,
    ['src/' || d.source || '/f' || (d.doc_id % 11) || '.go'] AS files_read,
    CASE WHEN d.doc_id % 4 <> 0 THEN ['src/' || d.source || '/f' || (d.doc_id % 7) || '.go', 'src/' || d.source || '/f' || (d.doc_id % 5) || '.go'] END AS files_modified,
    CASE WHEN d.doc_id % 2 = 0 THEN [d.lang, d.source] END AS facts,
    CASE WHEN d.doc_id % 11 <> 0 THEN 'm' || (d.doc_id % 3) || ':' || d.doc_id END AS sync_id,
    CASE WHEN d.doc_id % 5 = 0 THEN 0 ELSE 1704067200 + d.doc_id * 600 END AS sync_version,
    CASE WHEN d.doc_id % 7 <> 0 THEN 'm' || (d.doc_id % 3) END AS sync_source
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), turns AS (
  SELECT *, 'c' || conv_id AS content_session_id, 'm' || conv_id AS memory_session_id, 'src' || (conv_id % 20) AS project,
    1704067200 + conv_id * 3600 + turn * 60 AS epoch
  FROM conversations
), prompts AS (
  SELECT *, CASE WHEN id % 11 <> 0 THEN 'm' || (id % 3) || ':' || id END AS sync_id,
    CASE WHEN id % 5 = 0 THEN 0 ELSE created_at_epoch END AS sync_version, CASE WHEN id % 7 <> 0 THEN 'm' || (id % 3) END AS sync_source
  FROM (SELECT conv_id * 1000 + turn AS id, content_session_id, project, text AS prompt,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS prompt_number, epoch AS created_at_epoch FROM turns WHERE role = 'user')
), sess AS (
  SELECT *, CASE WHEN id % 11 <> 0 THEN 'm' || (id % 3) || ':' || id END AS sync_id,
    CASE WHEN id % 5 = 0 THEN 0 ELSE started_at_epoch END AS sync_version, CASE WHEN id % 7 <> 0 THEN 'm' || (id % 3) END AS sync_source
  FROM (SELECT conv_id AS id, content_session_id, memory_session_id, project, min(epoch) AS started_at_epoch,
    CASE WHEN arg_max(role, turn) = 'assistant' THEN 'completed' ELSE 'active' END AS status,
    CASE WHEN arg_max(role, turn) = 'assistant' THEN max(epoch) END AS completed_at_epoch
    FROM turns GROUP BY ALL)
), sums AS (
  SELECT s.id, memory_session_id, project, substring(t, 1, 60) AS request, CAST(NULL AS VARCHAR) AS investigated, t AS learned,
    CASE WHEN s.id % 3 <> 0 THEN substring(t, 61, 60) END AS completed, substring(t, 121, 40) AS next_steps,
    CASE WHEN s.id % 2 = 0 THEN [project] END AS files_read, CAST(NULL AS VARCHAR[]) AS files_edited, created_at_epoch,
    make_timestamp(created_at_epoch * 1000000) AS created_at, e.embedding,
    CASE WHEN s.id % 11 <> 0 THEN 'm' || (s.id % 3) || ':' || s.id END AS sync_id,
    CASE WHEN s.id % 5 = 0 THEN 0 ELSE created_at_epoch END AS sync_version, CASE WHEN s.id % 7 <> 0 THEN 'm' || (s.id % 3) END AS sync_source
  FROM (SELECT conv_id AS id, memory_session_id, project, arg_max(text, turn) AS t, max(epoch) + 1 AS created_at_epoch FROM turns WHERE role = 'assistant' GROUP BY ALL) s
  LEFT JOIN embeddings e ON e.vec_id = s.id
), pend AS (
  SELECT event_id AS id, 'c' || user_id AS content_session_id,
    CASE event_type WHEN 'purchase' THEN 'summary' WHEN 'signup' THEN 'continuation' ELSE 'observation' END AS message_type, props AS payload,
    (['pending', 'processing', 'completed', 'failed'])[event_id % 4 + 1] AS status, epoch_us(ts) AS created_at, CAST(NULL AS VARCHAR) AS error
  FROM events
), setts AS (
  SELECT CASE event_type WHEN 'view' THEN 'client_pull:u' WHEN 'click' THEN 'client_push:u' ELSE 'pull_cursor:u' END || user_id AS key,
    strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS value FROM events GROUP BY 1
  UNION ALL SELECT 'machine_id', 'm1'
)
"""


def sql(body: str, *ctes: str) -> str:
    """A statement over the logical tables and further common table expressions."""
    return "WITH " + ",\n".join([PRELUDE.strip(), *ctes]) + "\n" + body.strip()


PLAIN = "id, type, coalesce(title, '') AS title, coalesce(subtitle, '') AS subtitle, coalesce(narrative, '') AS narrative, project, created_at, CAST(0 AS DOUBLE) AS text_rank, CAST(0 AS DOUBLE) AS semantic_score, CAST(0 AS DOUBLE) AS combined_score"
NEWEST = "ORDER BY created_at_epoch DESC, id DESC"

# tokens of the weighted fields with positions that go on from field to field
TOKENS = """
fields AS (
  SELECT id, project, 1 AS f, 1.0 AS w, title AS t FROM obs UNION ALL SELECT id, project, 2, 0.4, subtitle FROM obs UNION ALL SELECT id, project, 3, 0.2, narrative FROM obs
), split_fields AS (
  SELECT id, project, f, w, list_filter(regexp_split_to_array(lower(coalesce(t, '')), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM fields
), shifted AS (
  SELECT *, coalesce(sum(len(l)) OVER (PARTITION BY id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM split_fields
), tok AS (
  SELECT id, project, CAST(w AS DOUBLE) AS w, CAST(i + shift AS BIGINT) AS pos, l[i] AS token FROM (SELECT id, project, w, shift, l, unnest(range(1, len(l) + 1)) AS i FROM shifted)
)"""


def single_rank(token: str, where: str = "TRUE") -> str:
    """rank1(id, r): the rank of one term."""
    return f"""
occ AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY pos) AS j FROM tok WHERE token = '{token}' AND {where}),
best AS (SELECT id, max(w) AS w FROM occ GROUP BY id),
rank1 AS (SELECT o.id, (max(b.w) + sum(o.w / (o.j * o.j)) - max(b.w) / pow(min(CASE WHEN o.w = b.w THEN o.j END), 2)) / 1.64493406685 AS r FROM occ o JOIN best b ON b.id = o.id GROUP BY o.id)"""


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


# full-text search in English: Porter2 step by step over the distinct tokens, as ``functions.stemming`` has it


def _quoted(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _cut(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _first_suffix(rules: Iterable[tuple[str, str]], region: str, otherwise: str) -> str:
    """The first suffix that a word has is replaced, if it lies in the region; without any of them ``otherwise``."""
    whens = [f"WHEN suffix(w, '{end}') THEN CASE WHEN length(w) - {len(end)} >= {region} THEN {_cut(len(end))} || '{new}' ELSE w END" for end, new in rules]
    return f"CASE {' '.join(whens)} {otherwise} ELSE w END"


def _stems() -> str:
    short = "(regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_full_match({0}, '[aeiouy][^aeiouy]'))"
    behind = "length(regexp_extract({}, '^.*?[aeiouy][^aeiouy]'))"  # the first consonant that follows a vowel
    head, rest = "regexp_extract(w, '^(gener|commun|arsen)')", "substr(w, r1 + 1)"
    verb = "regexp_extract(w, '(ed|edly|ing|ingly)$')"
    mended = f"CASE WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e' WHEN right(base, 2) IN ({_quoted(stemming.DOUBLES)}) THEN substr(base, 1, length(base) - 1) WHEN {short.format('base')} AND r1 >= length(base) THEN base || 'e' ELSE base END"
    plural = f"CASE WHEN suffix(w, 'sses') THEN {_cut(2)} WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END WHEN suffix(w, 's') AND NOT regexp_matches(w, '[us]s$') AND regexp_matches(w, '[aeiouy].*.s$') THEN {_cut(1)} ELSE w END"
    li = f"WHEN suffix(w, 'ogi') THEN CASE WHEN suffix(w, 'logi') AND length(w) - 3 >= r1 THEN {_cut(1)} ELSE w END WHEN regexp_matches(w, '[cdeghkmnrt]li$') AND length(w) - 2 >= r1 THEN {_cut(2)}"
    ative = f"WHEN suffix(w, 'ative') AND length(w) - 5 >= r2 THEN {_cut(5)}"
    ion = f"WHEN regexp_matches(w, '[st]ion$') AND length(w) - 3 >= r2 THEN {_cut(3)}"
    stages = {
        "spelt": f"SELECT DISTINCT token, regexp_replace(token, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM tok WHERE token NOT IN ({_quoted(stemming.STOP_WORDS)})",
        "region1": f"SELECT token, w, CASE WHEN {head} <> '' THEN length({head}) WHEN {behind.format('w')} > 0 THEN {behind.format('w')} ELSE length(w) END AS r1 FROM spelt",
        "region2": f"SELECT token, w, r1, CASE WHEN {behind.format(rest)} > 0 THEN r1 + {behind.format(rest)} ELSE length(w) END AS r2 FROM region1",
        "step1a": f"SELECT token, r1, r2, {plural} AS w FROM region2",
        "verbs": f"SELECT token, r1, r2, w, regexp_extract(w, '(eed|eedly)$') AS eed, {verb} AS verb, substr(w, 1, length(w) - length({verb})) AS base FROM step1a",
        "step1b": f"SELECT token, r1, r2, w AS plain, CASE WHEN eed <> '' THEN CASE WHEN length(w) - length(eed) >= r1 THEN substr(w, 1, length(w) - length(eed)) || 'ee' ELSE w END WHEN verb <> '' AND regexp_matches(base, '[aeiouy]') THEN {mended} ELSE w END AS w FROM verbs",
        "step1c": f"SELECT token, r1, r2, plain, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {_cut(1)} || 'i' ELSE w END AS w FROM step1b",
        "step2": f"SELECT token, r1, r2, plain, {_first_suffix(stemming.STEP2, 'r1', li)} AS w FROM step1c",
        "step3": f"SELECT token, r1, r2, plain, {_first_suffix(stemming.STEP3, 'r1', ative)} AS w FROM step2",
        "step4": f"SELECT token, r1, r2, plain, {_first_suffix([(end, '') for end in stemming.STEP4], 'r2', ion)} AS w FROM step3",
        "step5": f"SELECT token, plain, CASE WHEN suffix(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {short.format(_cut(1))} THEN {_cut(1)} ELSE w END WHEN suffix(w, 'll') AND length(w) - 1 >= r2 THEN {_cut(1)} ELSE w END AS w FROM step4",
    }
    special = " ".join(f"WHEN '{word}' THEN '{base}'" for word, base in stemming.SPECIAL.items())
    last = f"SELECT token, CASE WHEN length(token) < 3 THEN token ELSE CASE token {special} ELSE CASE WHEN plain IN ({_quoted(stemming.AFTER_1A)}) THEN plain ELSE replace(w, 'Y', 'y') END END END AS stem FROM step5"
    return ",\n".join([*(f"{name} AS ({body})" for name, body in stages.items()), f"stems AS MATERIALIZED ({last})"])


#: stems(token, stem): what the tokens stem to that are no stop words.
STEMS = _stems()


def stems_to(stem: str) -> str:
    return f"(SELECT token FROM stems WHERE stem = '{stem}')"
