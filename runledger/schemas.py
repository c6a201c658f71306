"""Fixed schemas. Nothing is inferred from data."""

from __future__ import annotations

# Tokens, labels and icons of the run-log contract.
EVENT_SCHEMA_VERSION = 1
EVENT_KINDS = [
    "run_started",
    "task_started",
    "task_output",
    "task_attempt_started",
    "task_finished",
    "run_finished",
]
STREAMS = ["stdout", "stderr"]
STATUSES = ["completed", "cached", "failed", "timed_out", "output_limit", "cancelled", "blocked"]
STATUS_LABELS = [
    ("completed", "completed", "✓"),
    ("cached", "cache hit", "✓"),
    ("failed", "failed", "✗"),
    ("timed_out", "timed out", "✗"),
    ("output_limit", "output limit exceeded", "✗"),
    ("cancelled", "cancelled", "×"),
    ("blocked", "blocked", "·"),
]
RUNNING_LABEL = ("running", "⠹")
FAILED_STATUSES = ["failed", "timed_out", "output_limit"]
ERROR_STATUSES = [*FAILED_STATUSES, "cancelled"]
ERROR_KIND_STATUS = [
    ("timed_out", "timed_out"),
    ("output_limit", "output_limit"),
    ("cancelled", "cancelled"),
    ("empty_command", "failed"),
    ("spawn", "failed"),
    ("wait", "failed"),
    ("output_read", "failed"),
    ("terminate", "failed"),
    ("failed", "failed"),
]

# Manifest defaults and bounds.
MANIFEST_SCHEMA_VERSION = 1
DEFAULT_PIPELINE = "ci"
DEFAULT_TIMEOUT_SECONDS = 600
DEFAULT_MAX_OUTPUT_BYTES = 16 * 1024 * 1024
MAX_RETRY_BACKOFF_SECONDS = 86_400
# Key that a manifest document carries to tell projects apart.
FLEET_KEY = "project_id"
MAX_MATRIX_INSTANCES = 1024
MAX_TAIL_LINES = 1000

# Fingerprint format and release metadata names.
FINGERPRINT_VERSION = 3
UNSET_VARIABLE = "<unset>"
REDACTED = "<redacted>"
RELEASE_MANIFEST_VERSION = 1
RELEASE_METADATA_FILE = "BUILD-METADATA.json"
RELEASE_CHECKSUM_FILE = "SHA256SUMS"
IDENTITY_FIELDS = ["repository", "release_tag", "source_commit", "tag_object", "workflow_run"]

RUN_LOG = """
    run_id DECIMAL(20,0), sequence BIGINT, event STRING, schema BIGINT,
    project STRING, task_count BIGINT,
    task STRING,
    stream STRING, bytes ARRAY<SMALLINT>,
    attempt BIGINT, max_attempts BIGINT,
    status STRING, elapsed_ms DECIMAL(38,0),
    completed BIGINT, cached BIGINT, failed BIGINT, cancelled BIGINT, blocked BIGINT,
    kind STRING, code BIGINT, message STRING, step BIGINT
"""

_TASK = """
    command: ARRAY<STRING>, depends_on: ARRAY<STRING>, cwd: STRING,
    env: MAP<STRING,STRING>, stdin: STRING, cache: BOOLEAN, inputs: ARRAY<STRING>,
    outputs: ARRAY<STRING>, cache_env: ARRAY<STRING>, timeout_seconds: BIGINT,
    max_output_bytes: BIGINT, resource_group: STRING, retries: BIGINT,
    retry_backoff_seconds: BIGINT, matrix: MAP<STRING,ARRAY<STRING>>
"""

MANIFEST = f"""
    project_id STRING, schema BIGINT,
    project STRUCT<name: STRING, default_pipeline: STRING>,
    pipelines MAP<STRING, STRUCT<tasks: ARRAY<STRING>, `finally`: ARRAY<STRING>>>,
    tasks MAP<STRING, STRUCT<{_TASK}>>
"""

# The keys a manifest may declare at each level.
MANIFEST_KEYS = ["schema", "project", "tasks", "pipelines"]
PROJECT_KEYS = ["name", "default_pipeline"]
PIPELINE_KEYS = ["tasks", "finally"]
TASK_KEYS = [
    "command",
    "depends_on",
    "cwd",
    "env",
    "stdin",
    "cache",
    "inputs",
    "outputs",
    "cache_env",
    "timeout_seconds",
    "max_output_bytes",
    "resource_group",
    "retries",
    "retry_backoff_seconds",
    "matrix",
]

DOCUMENT = """
    schema BIGINT, kind STRING, project STRING, root STRING, default_pipeline STRING,
    pipeline STRING, first BIGINT, tasks ARRAY<STRUCT<id: STRING, command: ARRAY<STRING>, cwd: STRING, stdin: STRING,
        cache: BOOLEAN, inputs: ARRAY<STRING>, outputs: ARRAY<STRING>,
        cache_env: ARRAY<STRING>, timeout_seconds: BIGINT, max_output_bytes: BIGINT,
        resource_group: STRING, retries: BIGINT, retry_backoff_seconds: BIGINT,
        finalizer: BOOLEAN, depends_on: ARRAY<STRING>, env: ARRAY<STRING>>>,
    edges ARRAY<STRUCT<task: STRING, depends_on: ARRAY<STRING>>>,
    pipelines ARRAY<STRUCT<name: STRING, tasks: ARRAY<STRING>, `finally`: ARRAY<STRING>>>
"""
