"""Streaming jobs over several triggers."""

import json
import os
import random
import subprocess
import sys
import time
from collections import namedtuple

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from runledger.operators import events as ev
from runledger.operators import output_text as out
from runledger.operators import runs
from runledger.sources import run_log
from runledger.streaming import frame_stream as fs
from runledger.streaming import run_stream as rs
from runledger.streaming.count_table import CountTable


def write_log(folder, batches):
    """One file per batch, in the order the stream will read them."""
    folder.mkdir()
    for i, batch in enumerate(batches):
        path = folder / f"{i:02}.json"
        path.write_text("".join(json.dumps({"schema": 1, **e}) + "\n" for e in batch))
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    return str(folder)


def event(run_id, sequence, kind, **payload):
    return {"run_id": run_id, "sequence": sequence, "event": kind, **payload}


def output(sequence, task, stream, data):
    return event(1, sequence, "task_output", task=task, stream=stream, bytes=list(data))


def finish(sequence, task, status, run_id=1):
    return event(run_id, sequence, "task_finished", task=task, status=status, elapsed_ms=1)


BATCHES = [
    [event(1, 0, "run_started", project="/p", task_count=2), event(1, 1, "task_started", task="a"),
     output(2, "a", "stdout", b"one"), event(2, 0, "run_started", project="/q", task_count=1)],
    [output(3, "a", "stdout", b"\ntwo"), output(4, "a", "stderr", b"err\xff"),
     event(1, 5, "task_attempt_started", task="a", attempt=2, max_attempts=2),
     {"kind": "error", "code": 3, "message": "x"}],
    [output(6, "a", "stdout", b"three\n"), output(7, "b", "stdout", b"tail"),
     finish(8, "a", "failed"), finish(9, "b", "completed"), finish(1, "x", "cached", 2)],
    [event(1, 10, "run_finished", completed=1, cached=0, failed=1, cancelled=0, blocked=0),
     finish(11, "late", "completed")],
]


def live(spark, path, **options):
    rs.use_rocksdb(spark)
    return rs.stream_run_log(spark, path, **{"files_per_trigger": 1, "distinct": False, **options})


def run(stream, tmp_path, label):
    return rs.run_to_table(stream, str(tmp_path / label), str(tmp_path / f"{label}-state"))


def batch(spark, path):
    schema = live(spark, path).schema
    return spark.read.schema(schema).json(path).where("event is not null")


def shuffled(batches, seed=1, files=4):
    """The same events in other files and another order."""
    events = [e for own in batches for e in own]
    random.Random(seed).shuffle(events)
    return [events[k::files] for k in range(files)]


def repeated(batches):
    return [*shuffled(batches, 2), *shuffled(batches, 3, 2)]


def n_events(batches):
    return sum(len([e for e in own if "event" in e]) for own in batches)


@pytest.mark.parametrize("arrange", [lambda b: [*b, b[0], b[2]], repeated])
def test_repeated_events_are_dropped(spark, rows, tmp_path, arrange):
    path = write_log(tmp_path / "log", arrange(BATCHES))
    got = run(live(spark, path, distinct=True), tmp_path, "t1")
    assert got.count() == n_events(BATCHES)
    once = write_log(tmp_path / "once", BATCHES)
    columns = ["run_id", "sequence", "event", "task", "bytes", "elapsed_ms"]
    assert rows(got, *columns) == rows(batch(spark, once), *columns)


def test_events_without_a_number_all_stay(spark, tmp_path):
    lines = [{"event": "task_started", "task": "a"}, {"run_id": 1, "event": "task_started", "task": "a"}]
    path = write_log(tmp_path / "log", [lines, lines])
    assert run(live(spark, path, distinct=True), tmp_path, "t1").count() == 4


def test_state_follows_the_gaps():
    rng = random.Random(4)
    for _ in range(200):
        spans, held = np.empty((0, 2), np.int64), set()
        for _ in range(rng.randrange(1, 6)):
            added = sorted(set(rng.sample(range(60), rng.randrange(1, 30))) - held)
            if added:
                numbers = np.array(added)
                spans = rs._FirstSeen._merged(np.concatenate([spans, np.stack([numbers, numbers + 1], 1)]))
                held |= set(added)
        assert {n for a, b in spans.tolist() for n in range(a, b)} == held
        assert (spans[1:, 0] > spans[:-1, 1]).all()


@pytest.mark.parametrize("arrange", [list, shuffled])
def test_header_equals_its_batch_twin_after_every_trigger(spark, rows, tmp_path, arrange):
    (tmp_path / "log").mkdir()
    path = str(tmp_path / "log")
    header = rs.header_table(spark, str(tmp_path / "header"), fold_every=2)
    columns = ["run_id", "running", "completed", "failed", "finished"]
    for k, own in enumerate(arrange(BATCHES)):
        (tmp_path / "log" / f"{k}.json").write_text("".join(json.dumps({"schema": 1, **e}) + "\n" for e in own))
        header.follow(rs.progress_changes(rs.stream_transitions(live(spark, path))), str(tmp_path / "state"))
        assert rows(rs.progress_of(header.read()), *columns) == rows(runs.progress(batch(spark, path)), *columns)
    # What is read is the last base and what came after it.
    assert len(header._parts("base")) == 2


def test_count_table_keeps_no_history(spark, rows, tmp_path):
    table = CountTable(spark, str(tmp_path / "t"), "k string, n bigint", ["k"], fold_every=3)
    assert table.read().count() == 0
    rng, held = random.Random(6), {}
    for k in range(11):
        changes = [(rng.choice("abc"), rng.randrange(-2, 3)) for _ in range(4)]
        frame = spark.createDataFrame(changes, "k string, n bigint")
        # A batch that failed after it was written comes again.
        for _ in range(1 + (k in (2, 4))):
            table.add(frame, k)
        for key, n in changes:
            held[key] = held.get(key, 0) + n
        assert rows(table.read()) == sorted(held.items())
    assert table._parts("base") == [5, 8] and min(table._parts("changes")) == 6
    # A base that was not completed does not count.
    os.remove(tmp_path / "t" / "base=8" / "_SUCCESS")
    assert rows(table.read()) == sorted(held.items())


def numbered(batches):
    """The events with their place among those of their task."""
    steps, out = {}, []
    for e in sorted((e for own in batches for e in own if "event" in e), key=lambda e: e["sequence"]):
        if "task" in e:
            key = (e["run_id"], e["task"])
            e = {**e, "step": steps.get(key, 0)}
            steps[key] = e["step"] + 1
        out.append(e)
    return [out[k::4] for k in range(4)]


LINES = [
    ("a", "stderr", 0, 0, "[a] err\ufffd", True),
    ("a", "stdout", 0, 0, "[a] one", False),
    ("a", "stdout", 0, 1, "[a] two", True),
    ("a", "stdout", 1, 0, "[a] three", False),
    ("b", "stdout", 0, 0, "[b] tail", True),
]
FRAMED = ["task", "stream", "segment", "line_no", "line", "flushed"]


def framed(spark, path, tmp_path, **options):
    events = live(spark, path, **options).withColumn("data", ev.output_bytes())
    return run(fs.stream_frame_lines(events), tmp_path, "t3")


@pytest.mark.parametrize("arrange", [list, shuffled, repeated])
def test_lines_are_framed_in_any_order(spark, rows, tmp_path, arrange):
    path = write_log(tmp_path / "log", arrange(numbered(BATCHES)))
    assert rows(framed(spark, path, tmp_path), *FRAMED) == LINES


def some_output(seed):
    """Chunks of two tasks with retries, long unfinished lines and finishes."""
    rng, events = random.Random(seed), []
    for sequence in range(300):
        task = rng.choice("ab")
        kind = rng.random()
        if kind < 0.9:
            data = b"".join(rng.choice([b"x", b"\n", b"\xc3\xa9", b"long " * 9, b""]) for _ in range(rng.randrange(6)))
            events.append(output(sequence, task, rng.choice(["stdout", "stderr"]), data))
        else:
            events.append(event(1, sequence, "task_attempt_started", task=task, attempt=1 + (kind > 0.95), max_attempts=9))
    return [*events, finish(300, "a", "failed"), finish(301, "b", "completed")]


def test_live_lines_equal_those_framed_in_batch(spark, rows, tmp_path):
    path = write_log(tmp_path / "log", shuffled(numbered([some_output(8)]), 9, 7))
    events = batch(spark, path)
    breaks = events.where("event = 'task_finished' or attempt > 1").select("run_id", "task", "sequence")
    want = out.frame_lines(ev.decode_output(events), breaks)
    assert rows(framed(spark, path, tmp_path, files_per_trigger=2), *FRAMED) == rows(want, *FRAMED)


def test_steps_are_numbered_where_the_log_is_written(spark, rows):
    events = [e for own in BATCHES for e in own if "event" in e]
    frame = spark.createDataFrame([(e["run_id"], e["sequence"], e.get("task")) for e in events], "run_id int, sequence int, task string")
    want = [(e["run_id"], e["sequence"], e.get("task"), e.get("step")) for own in numbered(BATCHES) for e in own]
    assert rows(fs.number_steps(frame, 2), "run_id", "sequence", "task", "step") == sorted(want, key=repr)


@pytest.mark.parametrize("arrange", [list, shuffled])
def test_runs_are_summarised_as_in_batch(spark, rows, tmp_path, arrange):
    path = write_log(tmp_path / "log", arrange(BATCHES))
    told = run(rs.stream_run_finish(rs.stream_transitions(live(spark, path))), tmp_path, "t4")
    want = runs.run_summary(runs.task_results(batch(spark, path))).where("run_id = 1")
    assert rows(rs.latest_summaries(told), *runs.COUNTS) == rows(want, *runs.COUNTS) == [(2, 0, 1, 0, 0)]


def test_late_finishes_correct_a_summary(spark, rows, tmp_path):
    late = [finish(20, "b", "failed"), finish(19, "a", "cached")]
    path = write_log(tmp_path / "log", [*BATCHES, [finish(3, "a", "completed")], late])
    told = run(rs.stream_run_finish(rs.stream_transitions(live(spark, path))), tmp_path, "t4")
    # An older finish that comes late changes nothing and tells nothing.
    assert rows(told, "version", *runs.COUNTS) == [(1, 2, 0, 1, 0, 0), (2, 1, 1, 1, 0, 0)]


def test_late_and_old_files_are_not_lost(spark, rows, tmp_path):
    path = write_log(tmp_path / "log", BATCHES)
    run(live(spark, path, distinct=True), tmp_path, "t1")
    late = tmp_path / "log" / "late.json"
    late.write_text("".join(json.dumps({"schema": 1, **e}) + "\n" for e in [finish(20, "z", "cached"), *BATCHES[0]]))
    os.utime(late, (1_500_000_000,) * 2)
    got = run(live(spark, path, distinct=True), tmp_path, "t1")
    assert got.count() == 1 + n_events(BATCHES)
    assert got.where("task = 'z'").count() == 1


def started(stream, tmp_path, label, until):
    """A job with a clock, run until its table satisfies ``until``."""
    where, state = str(tmp_path / label), str(tmp_path / f"{label}-state")
    query = stream.writeStream.option("checkpointLocation", state).trigger(processingTime="1 second").format("parquet").start(where)
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            query.exception()
            got = stream.sparkSession.read.schema(stream.schema).parquet(where) if os.path.isdir(where) else None
            if got is not None and until(got):
                return got
            time.sleep(1)
        raise AssertionError("nothing came")
    finally:
        query.stop()


def test_silent_runs_are_reported(spark, rows, tmp_path):
    path = write_log(tmp_path / "log", BATCHES[2:3])
    stream = rs.stream_run_finish(rs.stream_transitions(live(spark, path)), silent_ms=2_000)
    got = started(stream, tmp_path, "ends", lambda t: t.count() >= 2)
    assert rows(got.select(F.col("run_id").cast("int"), *runs.COUNTS, "abandoned")) == [
        (1, 1, 0, 1, 0, 0, True), (2, 0, 1, 0, 0, 0, True),
    ]


def test_silent_tasks_are_flushed_past_a_gap(spark, rows, tmp_path):
    events = [e for own in numbered(BATCHES) for e in own if e.get("sequence") not in (3, 8)]
    path = write_log(tmp_path / "log", [[e for e in events if e.get("task") == "a"]])
    stream = fs.stream_frame_lines(live(spark, path).withColumn("data", ev.output_bytes()), idle_ms=2_000)
    got = started(stream, tmp_path, "gap", lambda t: t.where("flushed").count() >= 2)
    assert rows(got, *FRAMED) == [
        ("a", "stderr", 0, 0, "[a] err\ufffd", True), ("a", "stdout", 0, 0, "[a] one", True),
        ("a", "stdout", 1, 0, "[a] three", False),
    ]


def test_decode_on_a_stream(spark, tmp_path):
    path = write_log(tmp_path / "log", BATCHES)
    got = run(ev.decode_output(live(spark, path)), tmp_path, "decode")
    assert got.count() == 5


@pytest.mark.parametrize(
    "processor", [fs._FrameLines(None), rs._FirstSeen(), rs._Transitions(), rs._Summaries({}, None)]
)
def test_processors_load_without_this_package(processor, tmp_path):
    path = tmp_path / "processor.pickle"
    path.write_bytes(cloudpickle.dumps(processor))
    code = "import pickle, sys; pickle.load(open(sys.argv[1], 'rb')).close(); assert 'runledger' not in sys.modules"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env=clean, check=True, timeout=60)


@pytest.mark.parametrize("limit", [1, 4096])
def test_tasks_of_a_run_share_an_entry_and_few_keys(spark, rows, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(rs, "BUCKET_TASKS", limit)
    path = write_log(tmp_path / "log", [
        [event(1, 0, "run_started"), *[event(1, k, "task_started", task=f"t{k}") for k in range(1, 40)]],
        [*[finish(k + 50, f"t{k}", "completed") for k in range(1, 40, 2)], event(1, 99, "run_finished")],
        [finish(k + 150, f"t{k}", "failed") for k in range(1, 40, 4)],
    ])
    seen = []
    writer = rs.progress_changes(rs.stream_transitions(live(spark, path))).writeStream.foreachBatch(
        lambda batch, n: seen.append([sum(c) for c in zip(*batch.select("running", "completed", "failed").collect(), strict=True)])
    )
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [[39, 0, 0], [-20, 20, 0], [0, -10, 10]]
    operators = [s for p in query.recentProgress for s in p["stateOperators"]]
    if limit > 40:
        # One entry for each bucket; the tasks had 40 before.
        assert max(s["numRowsTotal"] for s in operators) <= rs.TASK_BUCKETS + 1


def test_runs_share_an_entry_of_numbers(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(rs, "RUN_BUCKETS", 4)
    ids = [*range(60), 2**63 + 5, 2**64 - 1]
    events = [event(r, k, "task_started", task="a") for r in ids for k in (0, 1, 7, 65_535, 65_536)]
    path = write_log(tmp_path / "log", [*shuffled([events], 5), *shuffled([events, events], 6, 3)])
    query = live(spark, path, distinct=True).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True
    ).format("parquet").start(str(tmp_path / "t1"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t1")).select(F.col("run_id").cast("string"), "sequence")
    assert rows(got) == sorted([(str(e["run_id"]), e["sequence"]) for e in events], key=repr)
    # An entry for each bucket and block; there was one for each run and block before.
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 2 * 4


def test_lines_of_a_log_are_made_before_they_are_dealt(spark, tmp_path):
    path, events = str(tmp_path / "log"), spark.range(1000).selectExpr("id AS run_id", "'task_started' AS event", "id % 3 AS run_date")
    run_log.write_run_log(events, path, files=3)
    assert len(list((tmp_path / "log").glob("*/*.txt"))) == 3
    assert spark.read.text(path).count() == 1000


class Counted:
    """State in memory that counts how often it is asked or told something."""

    def __init__(self, calls):
        self.calls, self.value, self.items, self.map = calls, None, [], {}

    def __getattribute__(self, name):
        if name in ("calls", "value", "items", "map"):
            return object.__getattribute__(self, name)
        self.calls.append(name)
        return object.__getattribute__(self, name)

    def get(self):
        return iter(list(self.items)) if self.items else self.value

    def update(self, value):
        self.value = value  # noqa: the only state

    def exists(self):
        return bool(self.items or self.map or self.value)

    def clear(self):
        self.items.clear()

    def appendList(self, values):  # noqa: N802
        self.items.extend(values)

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.map[key]


def test_events_of_a_trigger_wait_for_each_other_without_state():
    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *args: Counted(calls)

    framer = fs._FrameLines(None)
    framer.init(Handle())
    Event = namedtuple("Event", "step stream data")
    events = [Event(k, "stdout", b"x\n" if k % 3 else b"y") for k in range(30)] + [Event(30, "flush", None)]
    random.Random(3).shuffle(events)
    told = list(framer.handleInputRows((1, "a"), iter(events[::2]), None))
    told += framer.handleInputRows((1, "a"), iter(events[1::2]), None)
    want = b"".join(b"x\n" if k % 3 else b"y" for k in range(30)).decode().splitlines()
    assert [t.line for t in told] == [f"[a] {line}" for line in want]
    calls.clear()
    framer = fs._FrameLines(None)
    framer.init(Handle())
    assert len(list(framer.handleInputRows((1, "a"), iter(events), None))) == len(want)
    # The place is read and written; each early event took four messages before.
    assert calls == ["get", "update"]
