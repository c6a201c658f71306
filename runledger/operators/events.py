"""Projections and filters over run-log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import schemas


def _event_is_valid() -> Column:
    token_ok = (
        (F.col("schema") == schemas.EVENT_SCHEMA_VERSION)
        & F.col("run_id").isNotNull()
        & F.col("sequence").isNotNull()
        & F.col("event").isin(schemas.EVENT_KINDS)
    )
    payload_ok = (
        F.when(F.col("event") == "task_output", F.col("stream").isin(schemas.STREAMS))
        .when(F.col("event") == "task_finished", F.col("status").isin(schemas.STATUSES))
        .otherwise(F.lit(True))
    )
    task_ok = ~F.col("event").startswith("task_") | F.col("task").isNotNull()
    return F.coalesce(token_ok & payload_ok & task_ok, F.lit(False))


def normalize_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows that follow the event contract and rows that do not."""
    valid = _event_is_valid()
    return events.where(valid), events.where(~valid)


def output_bytes() -> Column:
    """The integer array ``bytes`` of an output event as binary."""
    digits = F.transform(
        F.col("bytes"), lambda byte: F.lpad(F.hex(byte.cast("bigint")), 2, "0")
    )
    return F.unhex(F.array_join(digits, ""))


def decode_output(events: DataFrame) -> DataFrame:
    """Turn the integer arrays of output events into binary chunks, losslessly."""
    return events.where(F.col("event") == "task_output").select(
        "run_id", "sequence", "task", "stream", output_bytes().alias("data")
    )


def encode_output(chunks: DataFrame) -> DataFrame:
    """The inverse of :func:`decode_output`: binary chunks as integer arrays."""
    pairs = F.transform(
        F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0)),
        lambda pair: F.conv(pair, 16, 10).cast("smallint"),
    )
    return chunks.withColumn("bytes", pairs).drop("data")


def attempt_outcomes(events: DataFrame) -> DataFrame:
    """How each attempt in a log ended: run_id, task, sequence, attempt, outcome.

    An attempt that another one follows was ``retried``. The last attempt of a task
    ended as its finish says, or is still ``running`` where the log holds no finish
    after it.
    """
    task = ["run_id", "task"]
    started = F.col("event") == "task_attempt_started"
    finished = F.col("event") == "task_finished"
    ends = events.where(started | finished).groupBy(*task).agg(
        F.max(F.when(started, F.col("sequence"))).alias("last"),
        F.max(F.when(finished, F.struct("sequence", "status"))).alias("finish"),
    )
    outcome = (
        F.when(F.col("sequence") < F.col("last"), "retried")
        .when(F.col("finish.sequence") > F.col("sequence"), F.col("finish.status"))
        .otherwise("running")
    )
    return events.where(started).select(*task, "sequence", "attempt").join(ends, task).select(
        *task, "sequence", "attempt", outcome.alias("outcome")
    )


def _lookup(pairs: list[tuple[str, str]], key: str) -> Column:
    """A handful of constants as a map literal; no join is needed."""
    flat = [F.lit(part) for pair in pairs for part in pair]
    return F.create_map(*flat)[F.col(key)]


def map_error_status(errors: DataFrame) -> DataFrame:
    """Task status for each of the nine error kinds; null for an unknown kind."""
    return errors.withColumn("status", _lookup(schemas.ERROR_KIND_STATUS, "kind"))


def label_status(results: DataFrame) -> DataFrame:
    """Human label and icon of a status; a null status is still running."""
    running_label, running_icon = schemas.RUNNING_LABEL
    labels = [(status, label) for status, label, _ in schemas.STATUS_LABELS]
    icons = [(status, icon) for status, _, icon in schemas.STATUS_LABELS]
    return results.withColumn(
        "label", F.coalesce(_lookup(labels, "status"), F.lit(running_label))
    ).withColumn("icon", F.coalesce(_lookup(icons, "status"), F.lit(running_icon)))


def redact_env(tasks: DataFrame) -> DataFrame:
    """Replace the environment by its sorted names, values shown as redacted."""
    names = F.array_sort(F.map_keys("env"))
    return tasks.withColumn("env_names", names).withColumn(
        "env_text",
        F.array_join(
            F.transform(names, lambda n: F.concat(n, F.lit(f"={schemas.REDACTED}"))), " "
        ),
    ).drop("env")
