"""Schemas of the tables the operators exchange."""

FILES = "repo string, path string, size_bytes bigint, mtime timestamp_ntz, text string"

SYMBOL = "struct<name:string,line:int,end_line:int,tokens:bigint>"

FILE_INDEX = (
    "repo string, path string, lang string, size_bytes bigint, n_chars bigint, lines bigint, tokens bigint, "
    "summary string, skipped boolean, skip_reason string, mtime timestamp_ntz, sha256 string, "
    f"symbols array<string>, symbol_lines array<{SYMBOL}>"
)

RULE_LINES = "repo string, source string, rule_no int, line string"

ACCESS_LOG = (
    "session_id string, repo string, ts timestamp_ntz, seq bigint, op string, path string, is_error boolean"
)

USAGE_EVENTS = (
    "session_id string, agent string, ts timestamp_ntz, seq bigint, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, cache_write_tokens bigint, meter_tokens bigint"
)

LEDGER = (
    "session_id string, agent string, measured_tokens bigint, estimated_tokens bigint, "
    "first_seen timestamp_ntz, at timestamp_ntz, seq bigint"
)

BUGS = (
    "repo string, id string, error_message string, fix string, file string, at timestamp_ntz, "
    "extra map<string,string>"
)

LEARNED = "repo string, section string, seq bigint, entry string, at timestamp_ntz"

HANDOFF = "repo string, at timestamp_ntz, body string"

SCAN_STATE = (
    "repo string, last_scanned timestamp_ntz, git_head string, total_files bigint, total_lines bigint"
)

TASKS = (
    "repo string, id string, name string, expr string, action string, enabled boolean, last_run timestamp_ntz, "
    "last_status string, last_detail string, created_at timestamp_ntz"
)
