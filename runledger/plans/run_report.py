"""From a run log to one report row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import events as ev
from runledger.operators import runs
from runledger.sources.run_log import read_run_log


def run_report(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts, summary line, first error, exit code and reason of every run."""
    good, _ = ev.normalize_events(events)
    results = runs.task_results(good)
    origin = good.groupBy("run_id").agg(F.min("source_file").alias("source_file"))
    summaries = runs.run_summary(results).join(origin, "run_id")
    first = runs.first_error(results).select(
        "run_id", F.col("task").alias("first_error_task"), F.col("status").alias("first_error")
    )
    return (
        summaries.join(first, "run_id", "left")
        .join(runs.run_outcome(summaries, documents), "run_id")
        .drop("source_file")
    )


def report_logs(spark: SparkSession, path: str) -> DataFrame:
    """:func:`run_report` over all logs below ``path``."""
    return run_report(*read_run_log(spark, path))
