"""Run results, summaries and audits."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import ordered
from runledger.operators import events as ev
from runledger.operators import runs
from runledger.plans.run_report import report_logs
from runledger.sources.run_log import read_run_log, write_run_log

RESULT = "run_id bigint, plan_pos bigint, task string, status string"


def results(spark, *statuses):
    return spark.createDataFrame(
        [(1, i, chr(ord("a") + i), s) for i, s in enumerate(statuses)], RESULT
    )


@pytest.mark.parametrize(
    "statuses, counts, first",
    [
        (["completed", "cached", None], (1, 1, 0, 0, 1), []),
        (["timed_out", "failed", "output_limit"], (0, 0, 3, 0, 0), [(1, "a", "timed_out")]),
        (["cancelled", "failed"], (0, 0, 1, 1, 0), [(1, "a", "cancelled")]),
        (["completed", "blocked", "failed"], (1, 0, 1, 0, 1), [(1, "c", "failed")]),
    ],
)
def test_summary_and_first_error(spark, rows, statuses, counts, first):
    table = results(spark, *statuses)
    summary = runs.run_summary(table)
    assert rows(summary, *runs.COUNTS) == [counts]
    assert sum(counts) == len(statuses)
    assert rows(runs.first_error(table)) == first
    text = summary.first()["summary"]
    assert text == "summary: {} completed, {} cached, {} failed, {} cancelled, {} blocked".format(
        *counts
    )


def events(spark, items):
    columns = [c.split()[0] for c in schemas.RUN_LOG.replace("20,0", "").replace("38,0", "").split(",")]
    table = [tuple(item.get(c) for c in columns) for item in items]
    return spark.createDataFrame(table, schemas.RUN_LOG)


def event(run_id, sequence, kind, **payload):
    return {"run_id": Decimal(run_id), "sequence": sequence, "event": kind, "schema": 1, **payload}


def small_log():
    return [
        event(7, 0, "run_started", project="/p", task_count=3),
        event(7, 1, "task_started", task="a"),
        event(7, 2, "task_attempt_started", task="a", attempt=1, max_attempts=2),
        event(7, 3, "task_attempt_started", task="a", attempt=2, max_attempts=2),
        event(7, 4, "task_output", task="a", stream="stdout", bytes=[0, 255, 10]),
        event(7, 5, "task_finished", task="a", status="completed", elapsed_ms=Decimal(12)),
        event(7, 6, "task_started", task="b"),
        event(7, 7, "task_finished", task="b", status="cached", elapsed_ms=Decimal(0)),
        event(7, 8, "task_finished", task="c", status="blocked", elapsed_ms=Decimal(0)),
        event(7, 9, "run_finished", completed=1, cached=1, failed=0, cancelled=0, blocked=1),
    ]


def test_task_results_of_a_log(spark, rows):
    got = rows(runs.task_results(events(spark, small_log())), "task", "plan_pos", "started",
               "attempts", "max_attempts", "status")
    assert got == [
        ("a", 0, True, 2, 2, "completed"),
        ("b", 1, True, 0, None, "cached"),
        ("c", 2, False, 0, None, "blocked"),
    ]
    assert rows(runs.retry_history(events(spark, small_log())), "task", "retries_used",
                "exhausted") == [("a", 1, True)]
    assert rows(runs.audit_sequence(events(spark, small_log()))) == []


def test_log_round_trip_keeps_bytes_and_large_ids(spark, rows, tmp_path):
    largest = 2**64 - 1
    log = [{**e, "run_id": Decimal(largest)} for e in small_log()]
    path = str(tmp_path / "log")
    write_run_log(events(spark, log).withColumn("run_date", F.lit("2024-01-01")), path)
    read, documents = read_run_log(spark, path)
    assert documents.count() == 0
    assert rows(ev.decode_output(read), "data") == [(bytearray([0, 255, 10]),)]
    assert {int(r.run_id) for r in read.collect()} == {largest}
    again = ev.decode_output(ev.encode_output(ev.decode_output(read).withColumn(
        "event", F.lit("task_output"))))
    assert rows(again, "data") == [(bytearray([0, 255, 10]),)]


def test_error_document_decides_the_exit_code(spark, rows, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    lines = [
        '{"run_id":1,"sequence":0,"event":"run_started","schema":1,"project":"/p","task_count":1}',
        '{"run_id":1,"sequence":1,"event":"task_finished","schema":1,"task":"a","status":"blocked","elapsed_ms":0}',
        '{"schema":1,"kind":"error","code":3,"message":"cache broke"}',
    ]
    (path / "one.json").write_text("\n".join(lines) + "\n")
    (path / "two.json").write_text("\n".join(lines[:2]).replace('"run_id":1', '"run_id":2') + "\n")
    got = rows(report_logs(spark, str(path)), "run_id", "exit_code", "blocked", "reason")
    assert got == [
        (Decimal(1), 3, 1, "cache broke"),
        (Decimal(2), None, 1, "ambiguous: blocked tasks without an error document"),
    ]


def test_normalize_rejects_unknown_tokens(spark, rows):
    log = small_log() + [
        event(7, 10, "task_finished", task="x", status="exploded"),
        event(7, 11, "task_output", task="x", stream="stdin", bytes=[]),
        {**event(7, 12, "task_started", task="x"), "schema": 2},
        event(7, 13, "task_paused", task="x"),
    ]
    good, bad = ev.normalize_events(events(spark, log))
    assert good.count() == len(small_log())
    assert rows(bad, "sequence") == [(10,), (11,), (12,), (13,)]


def test_how_attempts_ended(spark, rows):
    started, ended = "task_attempt_started", "task_finished"
    log = [
        (1, 1, started, "a", 1, None), (1, 4, started, "a", 2, None), (1, 6, ended, "a", None, "failed"),
        (1, 2, started, "b", 1, None), (1, 9, started, "late", 2, None), (1, 3, ended, "late", None, "completed"),
        (2, 1, started, "a", 1, None), (2, 2, ended, "a", None, "timed_out"), (2, 5, ended, "c", None, "cached"),
    ]
    schema = "run_id bigint, sequence bigint, event string, task string, attempt bigint, status string"
    got = ev.attempt_outcomes(spark.createDataFrame(log, schema))
    assert rows(got, "run_id", "task", "attempt", "outcome") == [
        (1, "a", 1, "retried"), (1, "a", 2, "failed"), (1, "b", 1, "running"), (1, "late", 2, "running"),
        (2, "a", 1, "timed_out"),
    ]


def hot_rows(seed=3, n=400):
    """Sequences with gaps and repeats; run 1 holds most rows."""
    pick = random.Random(seed)
    return [(1 if pick.random() < 0.7 else pick.randint(2, 5), pick.randint(0, 300), pick.randint(0, 9))
            for _ in range(n)]


def test_blocked_totals_equal_plain_windows(spark, rows):
    table = spark.createDataFrame(
        [(r, s, v, i) for i, (r, s, v) in enumerate(hot_rows())],
        "g bigint, o bigint, v bigint, id bigint",
    )
    before = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
    plain = table.withColumn("t", F.coalesce(F.sum("v").over(before), F.lit(0)))
    for size in (1, 7, 1000):
        got = ordered.running_total(
            table, ["g"], ["o", "id"], ordered.block_of("o", size), F.col("v"), "t"
        )
        assert rows(got, "id", "t") == rows(plain, "id", "t")
    newest = Window.partitionBy("g").orderBy(F.desc("o"), F.desc("id"))
    tail = table.withColumn("r", F.row_number().over(newest)).where("r <= 9")
    for size in (1, 7, 1000):
        got = ordered.last_rows(table, ["g"], ["o", "id"], ordered.block_of("o", size), 9)
        assert rows(got, "id") == rows(tail, "id")
    ranged = ordered.position_by_range(table, ["g"], ["o", "id"], "p")
    places = table.withColumn("p", F.row_number().over(
        Window.partitionBy("g").orderBy("o", "id")).cast("bigint") - 1)
    assert rows(ranged, "id", "p") == rows(places, "id", "p")


def test_blocked_previous_equals_lag(spark, rows):
    table = spark.createDataFrame(hot_rows(), "g bigint, o bigint, v bigint").select("g", "o").distinct()
    plain = table.withColumn("b", F.lag("o").over(Window.partitionBy("g").orderBy("o")))
    for size in (1, 7, 1000):
        got = ordered.previous_value(table, ["g"], "o", ordered.block_of("o", size), "b")
        assert rows(got, "g", "o", "b") == rows(plain, "g", "o", "b")


def test_audit_finds_gaps_and_duplicates(spark, rows):
    log = [event(1, s, "task_started", task="a") for s in (1, 2, 2, 5)]
    for size in (1, 2, 100):
        assert rows(runs.audit_sequence(events(spark, log), size), "sequence", "rule", "detail") == [
            (1, "first event", "task_started"),
            (1, "gap", "expected 0"),
            (2, "duplicate", "2 events"),
            (5, "gap", "expected 3"),
            (5, "last event", "task_started"),
        ]
