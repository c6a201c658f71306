"""Checks for event, run and output-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.views import with_views
from runledger import schemas
from runledger.operators import events as ev
from runledger.operators import output_text as out
from runledger.operators import runs
from runledger.session import scratch_path, settle
from runledger.sources import rejects, run_log

_TASK_EVENTS = "event IN ('task_started', 'task_attempt_started', 'task_output', 'task_finished')"
_COUNTS_SQL = """
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'cached') AS cached,
  count(*) FILTER (status IN ('failed', 'timed_out', 'output_limit')) AS failed,
  count(*) FILTER (status = 'cancelled') AS cancelled,
  count(*) FILTER (status IS NULL OR status = 'blocked') AS blocked"""


def s1_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of a log that was written and read back, and the error documents beside it."""
    path = scratch_path(spark, "run-log")
    events = views.events(spark, sf_dir)
    run_log.write_run_log(events.withColumn("run_date", F.to_date("ts")), path)
    ends = events.where((F.col("event") == "run_finished") & (F.col("sequence") % 3 == 0))
    ends.select(
        F.lit(1).alias("schema"), F.lit("error").alias("kind"), (F.col("sequence") % 5).alias("code"),
        F.concat(F.lit("run "), "run_id", F.lit(" \"stopped\"\n")).alias("message"),
    ).write.mode("append").json(f"{path}/run_date=errors")
    read, documents = run_log.read_run_log(spark, path)
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    return read.select(
        F.col("run_id").cast("bigint").alias("run_id"), "sequence", "event", "schema", "project", "task", "stream",
        F.array_join(F.col("bytes").cast("array<string>"), ",").alias("bytes"), "status",
        *text("elapsed_ms", "attempt", "max_attempts", "task_count", *runs.COUNTS, "code"), "kind", "message",
    ).unionByName(
        documents.select("schema", "kind", F.col("code").cast("string").alias("code"), "message"), allowMissingColumns=True
    )


def s1_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which some lines were cut off."""
    path = scratch_path(spark, "run-log")
    run_log.write_run_log(
        views.events(spark, sf_dir).withColumn("run_date", F.to_date("ts")), path
    )
    broken = scratch_path(spark, "run-log-broken")
    value, number = F.col("value"), F.regexp_extract("value", r'"sequence":(\d+)', 1).cast("bigint")
    spark.read.text(path).select(
        F.when(number % 37 == 5, F.left(value, F.lit(20))).when(number % 37 == 6, "[1]").otherwise(value)
    ).write.text(broken)
    events, _ = run_log.read_run_log(spark, broken)
    told = rejects.malformed_lines(spark, broken).select("line", "reason")
    good = events.where(F.col("sequence").isNotNull()).agg(F.count("*").cast("string").alias("line"))
    return told.unionByName(good.withColumn("reason", F.lit("events")))


def e1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = ev.normalize_events(views.events(spark, sf_dir))
    columns = ["run_id", "sequence", "event", "schema", "stream", "status"]
    return good.select(*columns, F.lit(True).alias("valid")).unionByName(
        bad.select(*columns, F.lit(False).alias("valid"))
    )


def e2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = ev.decode_output(ev.encode_output(
        views.chunks(spark, sf_dir).withColumn("event", F.lit("task_output"))))
    return decoded.select(
        "run_id", "sequence", "task", "stream", F.col("data").cast("string").alias("text"),
        F.length("data").cast("bigint").alias("n_bytes"),
    )


def e3_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.attempt_outcomes(views.events(spark, sf_dir))


def e4_error_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k, _ in schemas.ERROR_KIND_STATUS], F.lit("other"))
    errors = views.events(spark, sf_dir).select(
        "run_id", "sequence",
        F.element_at(kinds, (F.col("sequence") % 10 + 1).cast("int")).alias("kind"),
    )
    return ev.map_error_status(errors)


def e5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.results(spark, sf_dir).select(
        "run_id", "task",
        F.when(F.col("elapsed_ms") % 9 != 0, F.col("status")).alias("status"),
    )
    return ev.label_status(results)


def a1_task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.task_results(views.events(spark, sf_dir)).select(
        "run_id", "task", F.col("plan_pos").cast("string").alias("plan_pos"), "started", "attempts",
        F.col("max_attempts").cast("string").alias("max_attempts"), "status",
        F.col("elapsed_ms").cast("string").alias("elapsed_ms"),
    )


def a2_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(views.results(spark, sf_dir))


def a3_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_error(views.results(spark, sf_dir))


def a4_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = runs.run_summary(views.results(spark, sf_dir)).withColumn(
        "source_file", F.concat(F.lit("log-"), "run_id")
    )
    key = F.col("o_orderkey")
    documents = views.table(spark, sf_dir, "orders").where(
        (key % 17 == 0) | (key % 19 == 0)
    ).select(
        F.concat(F.lit("log-"), key).alias("source_file"),
        F.when(key % 17 == 0, 3).otherwise(1).cast("bigint").alias("code"),
        F.concat(F.lit("stopped: "), "o_orderpriority").alias("message"),
    )
    return runs.run_outcome(summaries, documents).select(
        "run_id", F.col("exit_code").cast("string").alias("exit_code"), "reason"
    )


def a5_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.results(spark, sf_dir)
    run = F.col("run_id")
    recorded = (
        runs.run_summary(results)
        .where(run % 13 != 0)
        .select(
            F.when(run % 29 == 0, -1 - run).otherwise(run).alias("run_id"),
            F.when(run % 11 == 0, F.col("completed") + 1).otherwise(F.col("completed"))
            .alias("completed"),
            "cached", "failed", "cancelled",
            F.when(run % 7 == 0, F.lit(0)).otherwise(F.col("blocked")).cast("bigint")
            .alias("blocked"),
            sum((F.col(c) for c in runs.COUNTS[1:]), F.col("completed")).alias("task_count"),
        )
    )
    return runs.reconcile_summaries(results, recorded).select(
        "run_id", F.array_join("differences", "; ").alias("differences")
    )


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every 40th sequence number repeated and every 50th skipped."""
    sequence = F.col("sequence")
    return views.events(spark, sf_dir).withColumn(
        "sequence",
        F.when(sequence % 40 == 39, sequence - 1)
        .when(sequence % 50 == 49, sequence + 1)
        .otherwise(sequence),
    )


def a6_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.audit_sequence(_gappy(spark, sf_dir))


def a7_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.retry_history(views.events(spark, sf_dir))


def a8_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.progress(views.events(spark, sf_dir))


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.frame_lines(views.chunks(spark, sf_dir), views.chunk_breaks(spark, sf_dir))


def w1_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir).drop("end_sequence")


TAIL = 3


def w2_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.tail_lines(settle(_framed(spark, sf_dir), "lines"), TAIL).drop("end_sequence", "flushed")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        views.chunks(spark, sf_dir)
        .select("run_id", "task")
        .distinct()
        .withColumn("max_output_bytes", 100 + F.col("run_id") % 7 * 100)
    )


def w3_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = out.cap_output(views.chunks(spark, sf_dir), _limits(spark, sf_dir))
    return capped.select(
        "run_id", "task", "stream", "sequence", F.hex("data").alias("data"), "truncated"
    )


def w4_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    results = chunks.select("run_id", "task").distinct().select(
        "run_id", "task",
        F.substr("task", F.lit(6)).cast("bigint").alias("plan_pos"),
        views.status_of((F.col("run_id") + F.length("task")) % 7).alias("status"),
    )
    return out.failure_output(results, chunks)


QUERIES = {
    f.__name__: f
    for f in [
        s1_run_log, s1_malformed, e1_normalize, e2_decode, e3_attempts, e4_error_status, e5_labels,
        a1_task_results, a2_run_summary, a3_first_error, a4_outcome, a5_reconcile, a6_sequence,
        a7_retries, a8_progress, w1_frame, w2_tail, w3_cap, w4_failures,
    ]
}

_STATES = f""", states AS (
  SELECT run_id, task, bool_or(event = 'task_started') AS started,
    coalesce(max(attempt) FILTER (event = 'task_attempt_started'), 0) AS attempts,
    max(max_attempts) FILTER (event = 'task_attempt_started') AS max_attempts,
    max(sequence) FILTER (event = 'task_finished') AS fin,
    arg_max(status, sequence) FILTER (event = 'task_finished') AS status,
    arg_max(elapsed_ms, sequence) FILTER (event = 'task_finished') AS elapsed_ms
  FROM v_evt WHERE {_TASK_EVENTS} GROUP BY run_id, task)"""

_SUMMARY = f""", summary AS (SELECT run_id, {_COUNTS_SQL} FROM v_res GROUP BY run_id)"""

_FRAMED = """
, marks AS (
  SELECT run_id, task, stream, sequence, text, 0 AS cut FROM v_chunk
  UNION ALL SELECT run_id, task, NULL, sequence, NULL, 1 FROM v_break),
seg AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY run_id, task ORDER BY sequence, cut DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM marks),
streams AS (
  SELECT run_id, task, stream, segment, string_agg(text, '' ORDER BY sequence) AS whole
  FROM seg WHERE cut = 0 GROUP BY ALL),
pieces AS (
  SELECT *, string_split(whole, chr(10)) AS p FROM streams),
numbered AS (
  SELECT run_id, task, stream, segment, unnest(range(len(p))) AS i, unnest(p) AS piece, len(p) AS n
  FROM pieces),
framed AS (
  SELECT run_id, task, stream, segment, i::BIGINT AS line_no, piece, i = n - 1 AS flushed
  FROM numbered WHERE i < n - 1 OR piece <> '')"""

ORACLE = {
    "s1_run_log": with_views(["v_evt"], """
SELECT run_id, sequence, event, schema::BIGINT AS schema, project, task, stream,
  array_to_string(bytes, ',') AS bytes, status, elapsed_ms::VARCHAR AS elapsed_ms, attempt::VARCHAR AS attempt,
  max_attempts::VARCHAR AS max_attempts, task_count::VARCHAR AS task_count, completed::VARCHAR AS completed,
  cached::VARCHAR AS cached, failed::VARCHAR AS failed, cancelled::VARCHAR AS cancelled, blocked::VARCHAR AS blocked,
  NULL AS code, NULL AS kind, NULL AS message FROM v_evt
UNION ALL SELECT NULL, NULL, NULL, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  (sequence % 5)::VARCHAR, 'error', 'run ' || run_id || ' "stopped"' || chr(10)
FROM v_evt WHERE event = 'run_finished' AND sequence % 3 = 0"""),
    "e1_normalize": with_views(["v_evt"], """
SELECT run_id, sequence, event, schema::BIGINT AS schema, stream, status,
  schema = 1 AND coalesce(stream, 'stdout') IN ('stdout', 'stderr')
  AND coalesce(status, 'failed') <> 'exploded' AS valid FROM v_evt"""),
    "e2_decode": with_views(["v_chunk"], """
SELECT run_id, sequence, task, stream, text, strlen(text)::BIGINT AS n_bytes FROM v_chunk"""),
    "s1_malformed": with_views(["v_evt"], """
SELECT CASE sequence % 37 WHEN 5 THEN left('{"run_id":' || run_id || ',"sequence":' || sequence || ',', 20)
  ELSE '[1]' END AS line, CASE sequence % 37 WHEN 5 THEN 'malformed JSON' ELSE 'no object' END AS reason
FROM v_evt WHERE sequence % 37 IN (5, 6)
UNION ALL SELECT count(*)::VARCHAR, 'events' FROM v_evt WHERE sequence % 37 NOT IN (5, 6)"""),
    "e3_attempts": with_views(["v_evt"], """
SELECT run_id, task, sequence, attempt, CASE WHEN later IS NOT NULL THEN 'retried'
  WHEN fin > sequence THEN status ELSE 'running' END AS outcome
FROM (SELECT run_id, task, sequence, attempt, lead(sequence) OVER (PARTITION BY run_id, task ORDER BY sequence) AS later
  FROM v_evt WHERE event = 'task_attempt_started') a
LEFT JOIN (SELECT run_id, task, max(sequence) AS fin, arg_max(coalesce(status, ''), sequence) AS status FROM v_evt
  WHERE event = 'task_finished' GROUP BY ALL) f USING (run_id, task)"""),
    "e4_error_status": with_views(["v_evt"], """
SELECT run_id, sequence, kind, CASE kind WHEN 'timed_out' THEN 'timed_out'
  WHEN 'output_limit' THEN 'output_limit' WHEN 'cancelled' THEN 'cancelled'
  WHEN 'other' THEN NULL ELSE 'failed' END AS status
FROM (SELECT run_id, sequence, ['timed_out', 'output_limit', 'cancelled', 'empty_command', 'spawn',
  'wait', 'output_read', 'terminate', 'failed', 'other'][sequence % 10 + 1] AS kind FROM v_evt)"""),
    "e5_labels": with_views(["v_res"], """
SELECT run_id, task, status, CASE WHEN status IS NULL THEN 'running' WHEN status = 'cached'
    THEN 'cache hit' WHEN status = 'timed_out' THEN 'timed out' WHEN status = 'output_limit'
    THEN 'output limit exceeded' ELSE status END AS label,
  CASE WHEN status IS NULL THEN '⠹' WHEN status IN ('completed', 'cached') THEN '✓'
    WHEN status = 'cancelled' THEN '×' WHEN status = 'blocked' THEN '·' ELSE '✗' END AS icon
FROM (SELECT run_id, task, CASE WHEN elapsed_ms % 9 <> 0 THEN status END AS status FROM v_res)"""),
    "a1_task_results": with_views(["v_evt"], _STATES + """
SELECT run_id, task, started, attempts, max_attempts::VARCHAR AS max_attempts, status,
  elapsed_ms::VARCHAR AS elapsed_ms, CASE WHEN fin IS NOT NULL THEN row_number() OVER (
    PARTITION BY run_id ORDER BY fin NULLS LAST) - 1 END::VARCHAR AS plan_pos FROM states"""),
    "a2_run_summary": with_views(["v_res"], _SUMMARY + """
SELECT *, 'summary: ' || completed || ' completed, ' || cached || ' cached, ' || failed
  || ' failed, ' || cancelled || ' cancelled, ' || blocked || ' blocked' AS summary FROM summary"""),
    "a3_first_error": with_views(["v_res"], """
SELECT run_id, task, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY plan_pos, task, status) AS r FROM v_res
  WHERE status IN ('failed', 'timed_out', 'output_limit', 'cancelled')) WHERE r = 1"""),
    "a4_outcome": with_views(["v_res"], _SUMMARY + """
SELECT run_id,
  CASE WHEN run_id % 17 = 0 THEN 3 WHEN run_id % 19 = 0 THEN 1 WHEN failed > 0 THEN 1
    WHEN cancelled > 0 THEN 1 WHEN blocked = 0 THEN 0 END::VARCHAR AS exit_code,
  CASE WHEN run_id % 17 = 0 OR run_id % 19 = 0 THEN 'stopped: ' || o_orderpriority
    WHEN failed > 0 THEN 'task failed' WHEN cancelled > 0 THEN 'cancelled'
    WHEN blocked = 0 THEN 'ok' ELSE 'ambiguous: blocked tasks without an error document'
    END AS reason
FROM summary JOIN orders ON o_orderkey = run_id"""),
    "a5_reconcile": with_views(["v_res"], _SUMMARY + """, recorded AS (
  SELECT CASE WHEN run_id % 29 = 0 THEN -1 - run_id ELSE run_id END AS run_id,
    completed + CASE WHEN run_id % 11 = 0 THEN 1 ELSE 0 END AS completed, cached, failed, cancelled,
    CASE WHEN run_id % 7 = 0 THEN 0 ELSE blocked END AS blocked,
    completed + cached + failed + cancelled + blocked AS task_count
  FROM summary WHERE run_id % 13 <> 0)
SELECT run_id, differences FROM (
SELECT run_id, concat_ws('; ',
  CASE WHEN s.completed IS NULL THEN 'no results' END,
  CASE WHEN task_count IS NULL THEN 'no run_finished' END,
  CASE WHEN r.completed <> s.completed THEN 'completed: ' || r.completed || ' != ' || s.completed END,
  CASE WHEN r.cached <> s.cached THEN 'cached' END,
  CASE WHEN r.blocked <> s.blocked THEN 'blocked: ' || r.blocked || ' != ' || s.blocked END,
  CASE WHEN r.completed + r.cached + r.failed + r.cancelled + r.blocked <> task_count
    THEN 'parts: ' || (r.completed + r.cached + r.failed + r.cancelled + r.blocked)
      || ' != ' || task_count END) AS differences
FROM summary s FULL JOIN recorded r USING (run_id)) WHERE differences <> ''"""),
    "a6_sequence": with_views(["v_evt"], """, g AS (
  SELECT run_id, event, CASE WHEN sequence % 40 = 39 THEN sequence - 1
    WHEN sequence % 50 = 49 THEN sequence + 1 ELSE sequence END AS sequence FROM v_evt),
occ AS (SELECT run_id, sequence, count(*) AS n FROM g GROUP BY ALL),
st AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence) + 1, 0) AS want
  FROM occ),
ends AS (SELECT run_id, min({'s': sequence, 'e': event}) AS lo, max({'s': sequence, 'e': event}) AS hi
  FROM g GROUP BY run_id)
SELECT run_id, sequence, 'duplicate' AS rule, n || ' events' AS detail FROM occ WHERE n > 1
UNION ALL SELECT run_id, sequence, 'gap', 'expected ' || want FROM st WHERE sequence <> want
UNION ALL SELECT run_id, lo.s, 'first event', lo.e FROM ends WHERE lo.e <> 'run_started'
UNION ALL SELECT run_id, hi.s, 'last event', hi.e FROM ends WHERE hi.e <> 'run_finished'"""),
    "a7_retries": with_views(["v_evt"], """
SELECT run_id, task, max(attempt) - 1 AS retries_used, max(attempt) >= max(max_attempts) AS exhausted
FROM v_evt WHERE event = 'task_attempt_started' AND attempt > 1 GROUP BY run_id, task"""),
    "a8_progress": with_views(["v_evt"], _STATES + """
SELECT r.run_id, coalesce(running, 0) AS running, coalesce(completed, 0) AS completed,
  coalesce(failed, 0) AS failed, finished
FROM (SELECT run_id, bool_or(event = 'run_finished') AS finished FROM v_evt GROUP BY run_id) r
LEFT JOIN (SELECT run_id, count(*) FILTER (fin IS NULL) AS running,
  count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status IN ('failed', 'timed_out', 'output_limit')) AS failed
  FROM states GROUP BY run_id) s USING (run_id)"""),
    "w1_frame": with_views(["v_chunk", "v_break"], _FRAMED + """
SELECT run_id, task, stream, segment, line_no, '[' || task || '] ' || piece AS line, flushed
FROM framed"""),
    "w2_tail": with_views(["v_chunk", "v_break"], _FRAMED + f""", ends AS (
  SELECT f.*, (SELECT min(c.sequence) FROM (
      SELECT sequence, sum(length(text) - length(replace(text, chr(10), ''))) OVER (
        ORDER BY sequence) AS nl FROM seg x WHERE x.run_id = f.run_id AND x.task = f.task
        AND x.stream = f.stream AND x.segment = f.segment AND cut = 0) c
      WHERE c.nl > f.line_no) AS at_seq FROM framed f)
SELECT run_id, task, stream, segment, line_no,
  CASE stream WHEN 'stderr' THEN '! ' ELSE '' END || piece AS line
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task ORDER BY segment DESC, flushed DESC,
  CASE WHEN flushed THEN 0 ELSE at_seq END DESC, CASE stream WHEN 'stdout' THEN 0 ELSE 1 END DESC,
  line_no DESC) AS r FROM ends) WHERE r <= {TAIL}"""),
    "w3_cap": with_views(["v_chunk"], """, sized AS (
  SELECT *, 100 + run_id % 7 * 100 AS cap, coalesce(sum(strlen(text)) OVER (
    PARTITION BY run_id, task, stream ORDER BY sequence
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_chunk)
SELECT run_id, task, stream, sequence,
  substr(hex(encode(text)), 1, 2 * (cap - before)::BIGINT) AS data,
  strlen(text) > cap - before AS truncated
FROM sized WHERE cap >= before"""),
    "w4_failures": with_views(["v_chunk"], """, failed AS (
  SELECT DISTINCT run_id, task, substr(task, 6)::BIGINT AS plan_pos FROM v_chunk
  WHERE (run_id + length(task)) % 7 IN (0, 2, 3, 5)),
c AS (SELECT run_id, plan_pos, task, stream, sequence, text FROM v_chunk JOIN failed USING (run_id, task)
  WHERE text <> '')
SELECT DISTINCT run_id, plan_pos, task, 0 AS part, 0::BIGINT AS sequence,
  task || ' captured output:' AS text FROM c
UNION ALL SELECT DISTINCT run_id, plan_pos, task, CASE stream WHEN 'stdout' THEN 1 ELSE 3 END, 0,
  stream || ':' FROM c
UNION ALL SELECT run_id, plan_pos, task, CASE stream WHEN 'stdout' THEN 2 ELSE 4 END, sequence, text
FROM c"""),
}
