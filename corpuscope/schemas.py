"""Column layout of the tables the jobs exchange (Spark DDL)."""

CHUNKS = (
    "project_id STRING, id STRING, file STRING, name STRING, type STRING, "
    "line INT, line_end INT, content STRING, body STRING, lang STRING"
)
EDGES = (
    "project_id STRING, source_file STRING, source_symbol STRING, "
    "target_file STRING, target_symbol STRING, kind STRING, n BIGINT"
)
REFERENCES = "project_id STRING, source_file STRING, source_symbol STRING, kind STRING, name STRING, n_refs BIGINT"
IMPORTS = "project_id STRING, source_file STRING, source_symbol STRING, path STRING, n BIGINT"
COMMITS = "project_id STRING, kind STRING, seq BIGINT"
CORPUS = "project_id STRING, file STRING, length BIGINT, content STRING"
FILE_HASHES = "project_id STRING, file STRING, hash STRING"
META = "project_id STRING, key STRING, value STRING, ts TIMESTAMP"
PROJECTS = (
    "id STRING, path STRING, name STRING, last_seen TIMESTAMP, chunks BIGINT, files BIGINT"
)
USAGE_EVENTS = (
    "project_id STRING, id BIGINT, event_type STRING, tokens_saved BIGINT, "
    "tokens_used BIGINT, meta STRING, ts TIMESTAMP"
)
FILE_CHANGES = "project_id STRING, file STRING, action STRING, ts TIMESTAMP"
TOOL_CALLS = (
    "call_id STRING, session_id STRING, ts TIMESTAMP, tool STRING, args STRING, project_dir STRING"
)
TOOL_OUTPUTS = "call_id STRING, session_id STRING, tool_id STRING, ts TIMESTAMP, output STRING"
SESSION_EDITS = "session_id STRING, path STRING, ts TIMESTAMP"
AUDIT = (
    "ts TIMESTAMP, session_id STRING, tool_name STRING, path STRING, "
    "original_chars BIGINT, substitute_chars BIGINT"
)
EDIT_TOOLS = ("Write", "Edit")
