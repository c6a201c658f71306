"""Run aggregations.

Everything here combines map-side before the shuffle; ranks inside a run use
the block-wise helpers, so one run may hold most of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import ordered
from runledger.session import settle

COUNTS = ["completed", "cached", "failed", "cancelled", "blocked"]


def _is(event: str) -> Column:
    return F.col("event") == event


def _task_states(events: DataFrame) -> DataFrame:
    """One row per task of a run: what was seen of it and how it ended.

    The events of the run itself form one more row, with a null task.
    """
    finish = F.when(_is("task_finished"), F.struct("sequence", "status", "elapsed_ms"))
    attempt = lambda column: F.max(F.when(_is("task_attempt_started"), F.col(column)))
    return events.groupBy("run_id", "task").agg(
        F.coalesce(F.bool_or(_is("task_started")), F.lit(False)).alias("started"),
        F.coalesce(attempt("attempt"), F.lit(0)).alias("attempts"),
        attempt("max_attempts").alias("max_attempts"),
        F.max(finish).alias("finish"),
        F.coalesce(F.bool_or(_is("run_finished")), F.lit(False)).alias("run_finished"),
    )


def task_results(events: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Start, attempts and finish of every task, with its place in the plan.

    Finish events are logged in plan order, so the plan position is the rank
    of the finish event in its run. Tasks without a finish have no position.
    The log is read once: the rank works on the task rows, which are stored.
    """
    states = settle(_task_states(events).where(F.col("task").isNotNull()).select(
        "run_id",
        "task",
        "started",
        "attempts",
        "max_attempts",
        F.col("finish.sequence").alias("finish_sequence"),
        F.col("finish.status").alias("status"),
        F.col("finish.elapsed_ms").alias("elapsed_ms"),
    ), "task-states")
    finished = ordered.position(
        states.where(F.col("finish_sequence").isNotNull()),
        ["run_id"],
        ["finish_sequence"],
        ordered.block_of("finish_sequence", block_rows),
        "plan_pos",
    )
    unfinished = states.where(F.col("finish_sequence").isNull()).withColumn(
        "plan_pos", F.lit(None).cast("bigint")
    )
    return finished.unionByName(unfinished).drop("finish_sequence")


def summary_counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "cached").alias("cached"),
        F.count_if(status.isin(schemas.FAILED_STATUSES)).alias("failed"),
        F.count_if(status == "cancelled").alias("cancelled"),
        F.count_if(status.isNull() | (status == "blocked")).alias("blocked"),
    ]


def summary_text() -> Column:
    return F.format_string(
        "summary: %d completed, %d cached, %d failed, %d cancelled, %d blocked", *COUNTS
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Five counts per run that add up to the plan, and the summary line."""
    return results.groupBy("run_id").agg(*summary_counts()).withColumn("summary", summary_text())


def first_error(results: DataFrame) -> DataFrame:
    """First task in plan order that failed, timed out, overflowed or was cancelled."""
    first = F.min(F.struct("plan_pos", "task", "status"))
    return (
        results.where(F.col("status").isin(schemas.ERROR_STATUSES))
        .groupBy("run_id")
        .agg(first.alias("first"))
        .select("run_id", "first.task", "first.status")
    )


def run_outcome(summaries: DataFrame, error_docs: DataFrame) -> DataFrame:
    """Exit code and reason per run.

    An error document belongs to the run logged in the same source file and
    states the code itself. Without one, a run that only has blocked tasks
    cannot be told apart (1 or 3), so its code is null.
    """
    documents = error_docs.groupBy("source_file").agg(
        F.min(F.struct("code", "message")).alias("document")
    )
    rule = (
        F.when((F.col("failed") > 0) | (F.col("cancelled") > 0), F.lit(1))
        .when(F.col("blocked") == 0, F.lit(0))
        .cast("bigint")
    )
    reason = (
        F.when(F.col("document").isNotNull(), F.col("document.message"))
        .when(F.col("failed") > 0, "task failed")
        .when(F.col("cancelled") > 0, "cancelled")
        .when(F.col("blocked") == 0, "ok")
        .otherwise("ambiguous: blocked tasks without an error document")
    )
    return summaries.join(documents, "source_file", "left").select(
        "run_id", F.coalesce("document.code", rule).alias("exit_code"), reason.alias("reason")
    )


def reconcile_summaries(results: DataFrame, finished_events: DataFrame) -> DataFrame:
    """Runs whose recorded counts differ from the recomputed ones.

    ``finished_events`` holds the five recorded counts and ``task_count``.
    """
    recomputed = results.groupBy("run_id").agg(*summary_counts()).select(
        "run_id", *[F.col(c).alias(f"real_{c}") for c in COUNTS]
    )
    recorded_sum = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    checks = [
        F.when(F.col("real_completed").isNull(), "no results"),
        F.when(F.col("task_count").isNull(), "no run_finished"),
        *[
            F.when(F.col(c) != F.col(f"real_{c}"), F.concat(F.lit(f"{c}: "), c, F.lit(" != "),
                                                            f"real_{c}"))
            for c in COUNTS
        ],
        F.when(
            recorded_sum != F.col("task_count"),
            F.concat(F.lit("parts: "), recorded_sum, F.lit(" != "), F.col("task_count")),
        ),
    ]
    return (
        recomputed.join(finished_events.select("run_id", "task_count", *COUNTS), "run_id", "full")
        .select("run_id", F.array_compact(F.array(*checks)).alias("differences"))
        .where(F.size("differences") > 0)
    )


def audit_sequence(events: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Gaps, duplicates and wrong first or last events, as violation rows."""
    numbered = events.where(F.col("run_id").isNotNull() & F.col("sequence").isNotNull())
    # The log is read once; all rules work on these narrow rows.
    occurrences = settle(
        numbered.groupBy("run_id", "sequence").agg(
            F.count("*").alias("count"),
            F.min("event").alias("first_event"),
            F.max("event").alias("last_event"),
        ),
        "sequence",
    )
    duplicates = occurrences.where(F.col("count") > 1).select(
        "run_id",
        "sequence",
        F.lit("duplicate").alias("rule"),
        F.concat(F.col("count"), F.lit(" events")).alias("detail"),
    )
    stepped = ordered.previous_value(
        occurrences.select("run_id", "sequence"),
        ["run_id"],
        "sequence",
        ordered.block_of("sequence", block_rows),
        "previous",
    )
    expected = F.coalesce(F.col("previous") + 1, F.lit(0))
    gaps = stepped.where(F.col("sequence") != expected).select(
        "run_id",
        "sequence",
        F.lit("gap").alias("rule"),
        F.concat(F.lit("expected "), expected).alias("detail"),
    )
    ends = occurrences.groupBy("run_id").agg(
        F.min(F.struct("sequence", F.col("first_event").alias("event"))).alias("first"),
        F.max(F.struct("sequence", F.col("last_event").alias("event"))).alias("last"),
    )
    wrong_first = ends.where(F.col("first.event") != "run_started").select(
        "run_id",
        "first.sequence",
        F.lit("first event").alias("rule"),
        F.col("first.event").alias("detail"),
    )
    wrong_last = ends.where(F.col("last.event") != "run_finished").select(
        "run_id",
        "last.sequence",
        F.lit("last event").alias("rule"),
        F.col("last.event").alias("detail"),
    )
    return duplicates.unionByName(gaps).unionByName(wrong_first).unionByName(wrong_last)


def retry_history(events: DataFrame) -> DataFrame:
    """Retries used per task and whether none were left."""
    return (
        events.where(_is("task_attempt_started") & (F.col("attempt") > 1))
        .groupBy("run_id", "task")
        .agg(F.max("attempt").alias("attempt"), F.max("max_attempts").alias("max_attempts"))
        .select(
            "run_id",
            "task",
            (F.col("attempt") - 1).alias("retries_used"),
            (F.col("attempt") >= F.col("max_attempts")).alias("exhausted"),
        )
    )


def progress(events: DataFrame) -> DataFrame:
    """Live header per run: running, completed and failed tasks.

    Cache hits count in neither; a run is finished once it says so.
    """
    status = F.col("finish.status")
    is_task = F.col("task").isNotNull()
    return (
        _task_states(events)
        .groupBy("run_id")
        .agg(
            F.count_if(is_task & F.col("finish").isNull()).alias("running"),
            F.count_if(is_task & (status == "completed")).alias("completed"),
            F.count_if(is_task & status.isin(schemas.FAILED_STATUSES)).alias("failed"),
            F.bool_or("run_finished").alias("finished"),
        )
    )
