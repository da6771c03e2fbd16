"""Column functions for JSON payloads of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import EXTRACTED_OBSERVATION, EXTRACTED_SUMMARY
from .scalar import list_or_empty, rfc3339, strip_reminders, text_or_empty

# fixed values: other names under which hooks send a field
ALIASES = {
    "session_id": ("sessionId",),
    "prompt": ("input", "user_prompt", "userPrompt", "text"),
    "tool_name": ("toolName",),
    "tool_input": ("toolInput",),
    "tool_response": ("toolResponse",),
    "transcript_path": ("transcriptPath",),
    "last_assistant_message": ("lastAssistantMessage",),
}


def object_or_empty(json: Column) -> Column:
    """A JSON object as it is, ``{}`` for anything else."""
    return F.when(F.try_parse_json(json).isNotNull() & json.rlike(r"^\s*\{"), json).otherwise("{}")


def json_field(json: Column, *names: str) -> Column:
    """The first of several fields that isn't blank; objects come as JSON text."""
    values = [F.get_json_object(json, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def normalize_hook(json: Column, cwd: Column | None = None) -> list[Column]:
    """The fields of a hook payload under their proper names; a blank working directory is ``cwd``."""
    body = object_or_empty(json)
    where = json_field(body, "cwd")
    return [*[json_field(body, name, *others).alias(name) for name, others in ALIASES.items()], (where if cwd is None else F.coalesce(where, cwd)).alias("cwd")]


def normalized_hooks(rows: DataFrame, payload: str, *keep: str) -> DataFrame:
    """The columns to keep and what ``normalize_hook`` makes of a payload without a folder of its own, all
    fields taken from one reading of it."""
    names = [n for name, others in ALIASES.items() for n in (name, *others)] + ["cwd"]
    read = rows.select(*keep, F.json_tuple(object_or_empty(F.col(payload)), *names).alias(*[f"__{n}" for n in names]))
    field = lambda *fields: F.coalesce(*[F.when(F.trim(f"__{n}") != "", F.col(f"__{n}")) for n in fields])
    return read.select(*keep, *[field(name, *others).alias(name) for name, others in ALIASES.items()], F.coalesce(field("cwd"), F.lit("")).alias("cwd"))


def json_array_or_empty(json: Column) -> Column:
    """``[]`` for null, empty and invalid text; any valid JSON stays."""
    return F.when((text_or_empty(json) == "") | F.try_parse_json(json).isNull(), "[]").otherwise(json)


def string_list(json: Column) -> Column:
    """The strings of a JSON array; anything else is an empty list."""
    return list_or_empty(F.from_json(json, "array<string>"))


def content_text(content: Column) -> Column:
    """Message content: a JSON string, or the texts of its blocks of type text, line by line."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: text_or_empty(b["text"]))
    plain = F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v")
    return F.when(content.rlike(r"^\s*\["), F.array_join(texts, "\n")).when(content.rlike(r'^\s*"'), plain).otherwise("")


def transcript_role(line: Column) -> Column:
    return F.get_json_object(line, "$.message.role")


def transcript_text(line: Column) -> Column:
    """The text of a transcript line, which may hold its content as a string or as blocks."""
    content = F.get_json_object(line, "$.message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: text_or_empty(b["text"]))
    return F.when(content.rlike(r"^\s*\["), F.array_join(texts, "\n")).otherwise(text_or_empty(content))


def clean_message(text: Column) -> Column:
    return strip_reminders(text)


def parse_observation(json: Column) -> Column:
    """What a language model extracted; absent fields are empty, text that isn't JSON is null."""
    return F.when(F.try_parse_json(json).isNotNull() & json.rlike(r"^\s*\{"), F.from_json(json, EXTRACTED_OBSERVATION))


def parse_summary(json: Column) -> Column:
    return F.when(F.try_parse_json(json).isNotNull() & json.rlike(r"^\s*\{"), F.from_json(json, EXTRACTED_SUMMARY))


# fixed values: the fields of responses, by kind
RESPONSES = {
    "search": ("id", "type", "title", "subtitle", "narrative", "project", "created_at", "combined_score"),
    "timeline": ("id", "type", "title", "subtitle", "narrative", "project", "created_at"),
    "stats": ("sessions", "observations", "summaries"),
}


def encoded(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with ``json``: each row as a response of a kind shows it, times as RFC 3339."""
    times = {f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp"}
    fields = [(rfc3339(F.col(c)) if c in times else F.col(c)).alias(c) for c in RESPONSES[kind]]
    return rows.withColumn("json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def response(results: DataFrame, query: str, by: tuple[Column, ...], kind: str = "search") -> DataFrame:
    """One row: the JSON of a search response, its results (a limited list) in order."""
    rows = encoded(results, kind).select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], "json").alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"])
    head = F.concat(F.lit('{"query":'), F.substring(F.to_json(F.array(F.lit(query))), F.lit(2), F.length(F.to_json(F.array(F.lit(query)))) - 2), F.lit(',"total":'))
    return rows.agg(F.concat(head, F.count("*").cast("string"), F.lit(',"results":['), F.array_join(listed, ","), F.lit("]}")).alias("body"))


# fixed values: lists as responses show them; fields in the second tuple are left out where they are empty
LISTS = {
    "summaries": (("id", "memory_session_id", "project", "request", "investigated", "learned", "completed", "next_steps", "notes", "created_at"), ("request", "investigated", "learned", "completed", "next_steps", "notes")),
    "prompts": (("id", "content_session_id", "project", "prompt", "prompt_number", "created_at"), ()),
}


def list_response(rows: DataFrame, kind: str, by: tuple[Column, ...]) -> DataFrame:
    """One row: the JSON of a list response (a limited list), its rows in order."""
    shown, optional = LISTS[kind]

    def field(c: str) -> Column:
        if c in optional:
            return F.nullif(F.col(c), F.lit(""))
        return rfc3339(F.col(c)) if c == "created_at" else F.col(c)

    made = rows.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)], F.to_json(F.struct(*[field(c).alias(c) for c in shown])).alias("json")).alias("r"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["json"]), ",")
    return made.agg(F.concat(F.lit(f'{{"{kind}":['), listed, F.lit('],"total":'), F.count("*").cast("string"), F.lit("}")).alias("body"))
