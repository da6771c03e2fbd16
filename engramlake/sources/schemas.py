"""The logical tables of an agent's memory."""

from __future__ import annotations

_SYNC = "sync_id string, sync_version bigint, sync_source string"

SESSIONS = f"id bigint, content_session_id string, memory_session_id string, project string, user_prompt string, started_at timestamp, started_at_epoch bigint, completed_at timestamp, completed_at_epoch bigint, status string, {_SYNC}"
OBSERVATIONS = f"id bigint, memory_session_id string, project string, type string, title string, subtitle string, narrative string, text string, facts array<string>, concepts array<string>, files_read array<string>, files_modified array<string>, discovery_tokens int, created_at timestamp, created_at_epoch bigint, embedding array<float>, {_SYNC}"
SUMMARIES = f"id bigint, memory_session_id string, project string, request string, investigated string, learned string, completed string, next_steps string, notes string, files_read array<string>, files_edited array<string>, discovery_tokens int, created_at timestamp, created_at_epoch bigint, embedding array<float>, {_SYNC}"
PROMPTS = f"id bigint, content_session_id string, project string, prompt string, prompt_number bigint, created_at timestamp, created_at_epoch bigint, embedding array<float>, {_SYNC}"
PENDING = "id bigint, content_session_id string, message_type string, payload string, status string, created_at timestamp, processed_at timestamp, error string"
SETTINGS = "key string, value string"

HOOK_EVENT = "session_id string, cwd string, prompt string, tool_name string, tool_input string, tool_response string, transcript_path string, last_assistant_message string"
EXTRACTED_OBSERVATION = "skip boolean, type string, title string, subtitle string, narrative string, facts array<string>, concepts array<string>, files_read array<string>, files_modified array<string>"
EXTRACTED_SUMMARY = "request string, investigated string, learned string, completed string, next_steps string"

# fixed values of the data model
SESSION_STATUS = ("active", "completed", "failed")
OBSERVATION_TYPES = ("decision", "bugfix", "feature", "refactor", "discovery", "change")
MESSAGE_TYPES = ("observation", "summary", "continuation")
QUEUE_STATUS = ("pending", "processing", "completed", "failed")
