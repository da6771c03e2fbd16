"""Column functions for paths, keys, times, lists and log lines.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tags of console log lines in the order in which they are looked for
LOG_TAGS = (("TRC", "trace"), ("DBG", "debug"), ("INF", "info"), ("WRN", "warn"), ("ERR", "error"), ("FTL", "fatal"))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def list_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def project_from_path(cwd: Column) -> Column:
    """The last segment of a directory; an empty path stays empty, the root is ``/``."""
    trimmed = F.regexp_replace(text_or_empty(cwd), "/+$", "")
    return F.when(text_or_empty(cwd) == "", "").when(trimmed == "", "/").otherwise(F.element_at(F.split(trimmed, "/"), -1))


def split_list(csv: Column) -> Column:
    """A comma list as an array, entries trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text_or_empty(csv), ","), lambda x: F.trim(x)), lambda x: x != "")


def in_list(csv: Column, item: Column) -> Column:
    """Whether a comma list has an item, whatever their case."""
    return F.exists(split_list(csv), lambda x: F.lower(x) == F.lower(item))


def project_allowed(project: Column, allow: Column, deny: Column) -> Column:
    """An allow list decides alone where there is one; else the deny list.  No project is never allowed."""
    listed = F.size(split_list(allow)) > 0
    return (text_or_empty(project) != "") & F.when(listed, in_list(allow, project)).otherwise(~in_list(deny, project))


def tool_kept(tool: Column, skip: Column) -> Column:
    return ~in_list(skip, text_or_empty(tool))


def epoch_seconds(epoch: Column) -> Column:
    """Milliseconds (beyond 1e12) as seconds; seconds and null as they are."""
    return F.when(epoch > 1_000_000_000_000, (epoch - F.pmod(epoch, F.lit(1000))) / 1000).otherwise(epoch).cast("long")


def parse_time(text: Column, epoch: Column | None = None) -> Column:
    """An ISO timestamp, else that of an epoch in seconds if one is given."""
    t = F.try_to_timestamp(text)
    return t if epoch is None else F.coalesce(t, F.timestamp_seconds(epoch))


def day_bounds(first: str | None, last: str | None, now: Column) -> tuple[Column, Column]:
    """Epochs of an inclusive range of days in UTC.

    No or a wrong first day is 0; no last day is now; a wrong last day is 0, so that nothing matches."""
    def start(day: str) -> Column:
        return F.unix_timestamp(F.try_to_timestamp(F.lit(day), F.lit("yyyy-MM-dd")))

    low = F.coalesce(start(first), F.lit(0)) if first else F.lit(0)
    high = F.coalesce(start(last) + 86399, F.lit(0)) if last else now
    return low.cast("long"), high.cast("long")


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8 and a note; a character that the limit would split is left out."""
    cut = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(limit)).cast("string")
    # a character that was cut becomes replacement marks at the very end
    whole = F.regexp_replace(F.make_valid_utf8(cut), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit("... (truncated)")))


def mask_key(key: Column) -> Column:
    """All but the last four characters starred; short keys wholly."""
    return F.when(text_or_empty(key) == "", "").when(F.length(key) <= 4, "****").otherwise(F.concat(F.repeat(F.lit("*"), F.length(key) - 4), F.substring(key, -4, 4)))


def redact_url(url: Column) -> Column:
    """What stands between the first colon behind the eleventh character and the next @ is starred."""
    return F.regexp_replace(url, r"(?s)^(.{11,}?:).*?@", "$1***@")


def normalize_provider(name: Column, known: tuple[str, ...] = ("claude", "codex", "gemini")) -> Column:
    """The first known provider where none is named; null for an unknown one."""
    n = F.lower(F.trim(text_or_empty(name)))
    return F.when(n == "", known[0]).when(n.isin(*known), n)


def strip_reminders(text: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?s)<system-reminder>.*?</system-reminder>", ""))


def prompt_preview(text: Column, limit: int = 200) -> Column:
    """Tags removed, white space collapsed, cut at a number of characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text_or_empty(text), "<[^>]+>", ""), r"\s+", " "))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("..."))).otherwise(clean)


def log_level(line: Column) -> Column:
    out = None
    for tag, level in LOG_TAGS:
        # a tag at the very end of a line doesn't count
        found = (F.instr(line, tag) > 0) & (F.instr(line, tag) <= F.length(line) - len(tag))
        out = F.when(found, level) if out is None else out.when(found, level)
    return out.otherwise("info")


def log_message(line: Column) -> Column:
    """What follows the level's tag, without spaces and colour codes; the whole line where that is nothing."""
    out = None
    for tag, _ in LOG_TAGS:
        found = (F.instr(line, tag) > 0) & (F.instr(line, tag) <= F.length(line) - len(tag))
        rest = F.regexp_replace(F.substring(line, F.instr(line, tag) + len(tag), F.length(line)), "^(?: |\x1b[^m]*m)+", "")
        value = F.when(rest != "", rest).otherwise(line)
        out = F.when(found, value) if out is None else out.when(found, value)
    return out.otherwise(line)


def level_reaches(level: Column, least: Column) -> Column:
    """Whether a log level is at least another; unknown levels pass."""
    rank = F.create_map(*[F.lit(x) for i, (_, name) in enumerate(LOG_TAGS) for x in (name, i)])
    return F.coalesce(F.try_element_at(rank, level) >= F.try_element_at(rank, least), F.lit(True))


def embedding_text(*parts: Column, facts: Column | None = None) -> Column:
    """Parts with one space between them, empty ones too; facts follow if there are any."""
    base = F.concat_ws(" ", *map(text_or_empty, parts))
    if facts is None:
        return base
    return F.when(F.size(list_or_empty(facts)) > 0, F.concat(base, F.lit(" "), F.array_join(facts, " "))).otherwise(base)


def tool_prompt(tool: Column, given: Column, response: Column, cwd: Column, project: Column, limit: int = 4000) -> Column:
    """The message that asks a language model for an observation."""
    return F.concat(F.lit("Tool: "), tool, F.lit("\nProject: "), project, F.lit("\nWorking Directory: "), cwd, F.lit("\n\nInput:\n"), truncate_bytes(given, limit), F.lit("\n\nOutput:\n"), truncate_bytes(response, limit))


def summary_prompt(message: Column, project: Column, limit: int = 8000) -> Column:
    return F.concat(F.lit("Project: "), project, F.lit("\n\nLast assistant message:\n"), truncate_bytes(message, limit))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")


def rfc3339(ts: Column) -> Column:
    """A time in UTC to the second, as responses give it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def random_id() -> Column:
    """A random id in the form of a UUID, a new one for each row."""
    return F.uuid()
