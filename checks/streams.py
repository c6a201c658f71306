"""Checks for streaming jobs: each is run to its end and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.run_log import _COUNTS_SQL, _FRAMED, _STATES
from checks.views import with_views
from runledger.operators import events as ev
from runledger.session import scratch_path, settle
from runledger.sources import run_log
from runledger.streaming import frame_stream as fs
from runledger.streaming import run_stream as rs

# The log is dealt to this many files, of which a trigger reads two.
FILES = 3


def _log(spark: SparkSession, events: DataFrame) -> str:
    """Write the events as a log of several files, dealt to them without any order."""
    path = scratch_path(spark, "live-log")
    _write(events, path, F.pmod(F.xxhash64("run_id", "sequence"), F.lit(FILES)))
    return path


def _write(events: DataFrame, path: str, number: Column, label: str = "part") -> None:
    """Add one file for each number."""
    dealt = events.withColumn("run_date", F.concat(F.lit(f"{label}-"), number))
    run_log.write_run_log(dealt, path, mode="append", files=FILES)


def _stream(spark: SparkSession, path: str, **options) -> DataFrame:
    rs.use_rocksdb(spark)
    return rs.stream_run_log(spark, f"{path}/*/*.txt", **{"files_per_trigger": 2, "distinct": False, **options})


def _finished(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    return rs.run_to_table(stream, scratch_path(spark, label), scratch_path(spark, f"{label}-state"))


def _plain(table: DataFrame) -> DataFrame:
    return table.withColumn("run_id", F.col("run_id").cast("bigint"))


def t1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log delivered twice, the second time in other files."""
    events = settle(views.events(spark, sf_dir).drop("ts", "props"), "live-events")
    path = _log(spark, events)
    _write(events, path, F.pmod(F.xxhash64("sequence"), F.lit(FILES)), "again")
    stream = _stream(spark, path, distinct=True)
    return _plain(_finished(spark, stream, "t1").select("run_id", "sequence", "event", "task", "status"))


def t2_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = rs.progress_changes(rs.stream_transitions(_stream(spark, _log(spark, views.events(spark, sf_dir)))))
    header = rs.header_table(spark, scratch_path(spark, "header"), fold_every=2)
    header.follow(changes, scratch_path(spark, "header-state"))
    return _plain(rs.progress_of(header.read()))


def t3_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = views.chunks(spark, sf_dir)
    encoded = ev.encode_output(output).withColumn("event", F.lit("task_output"))
    retries = views.chunk_breaks(spark, sf_dir).select(
        "run_id", "task", "sequence", F.lit("task_attempt_started").alias("event"),
        F.lit(2).cast("bigint").alias("attempt"),
    )
    ends = output.groupBy("run_id", "task").agg((F.max("sequence") + 2).alias("sequence")).withColumn(
        "event", F.lit("task_finished")
    )
    events = encoded.unionByName(retries, True).unionByName(ends, True)
    path = _log(spark, fs.number_steps(settle(events, "live-events")))
    stream = _stream(spark, path).withColumn("data", ev.output_bytes())
    return _plain(_finished(spark, fs.stream_frame_lines(stream), "t3"))


def t4_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, _log(spark, views.events(spark, sf_dir)))
    summaries = rs.stream_run_finish(rs.stream_transitions(stream))
    return _plain(rs.latest_summaries(_finished(spark, summaries, "t4")))


QUERIES = {f.__name__: f for f in [t1_stream, t2_progress, t3_frame, t4_finish]}

ORACLE = {
    "t1_stream": with_views(["v_evt"], "SELECT run_id, sequence, event, task, status FROM v_evt"),
    "t2_progress": with_views(["v_evt"], _STATES + """
SELECT r.run_id, coalesce(running, 0) AS running, coalesce(completed, 0) AS completed,
  coalesce(failed, 0) AS failed, finished
FROM (SELECT run_id, bool_or(event = 'run_finished') AS finished FROM v_evt GROUP BY run_id) r
LEFT JOIN (SELECT run_id, count(*) FILTER (fin IS NULL) AS running,
  count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status IN ('failed', 'timed_out', 'output_limit')) AS failed
  FROM states GROUP BY run_id) s USING (run_id)"""),
    "t3_frame": with_views(["v_chunk", "v_break"], _FRAMED + """
SELECT run_id, task, stream, segment, line_no, '[' || task || '] ' || piece AS line, flushed
FROM framed"""),
    "t4_finish": with_views(["v_evt"], _STATES + """
SELECT run_id, coalesce(completed, 0) AS completed, coalesce(cached, 0) AS cached,
  coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, coalesce(blocked, 0) AS blocked,
  false AS abandoned
FROM (SELECT DISTINCT run_id FROM v_evt WHERE event = 'run_finished') r
LEFT JOIN (SELECT run_id, """ + _COUNTS_SQL + """ FROM states GROUP BY run_id) s USING (run_id)"""),
}
