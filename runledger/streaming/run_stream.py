"""Live run logs: events without repeats, task transitions, run summaries.

Events carry no time of their own, so the ingestion time of their file stands
in for it. Every job gives the result of its batch twin, in whatever order files
arrive and however often: state follows the greatest sequence seen, and each
correction is a row of its own.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runledger import schemas
from runledger.operators import runs
from runledger.streaming.count_table import CountTable

# The state processors below travel with their query, so that workers need no
# copy of this package. They only use what this module itself defines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets that runs are dealt to, and consecutive sequence numbers: runs of a bucket share one entry for such a block.
RUN_BUCKETS = 1 << 12
BLOCK_BITS = 16
BLOCK_NUMBERS = 1 << BLOCK_BITS
#: Buckets that the tasks of a run are dealt to, and tasks of a bucket whose state is one entry.
TASK_BUCKETS = 2
BUCKET_TASKS = 4096
#: State of a task that has been seen and has not finished; a word no log uses.
RUNNING = "running"
#: States of the run itself, which has no task.
STARTED, FINISHED = "run started", "run finished"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which the stateful jobs need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _FirstSeen(StatefulProcessor):
    """Passes the rows on whose sequence number is new; keeps the numbers of many runs as spans.

    Runs are numbered as they come, and a run's numbers lie behind each other on one line:
    those of the next run start at the next multiple of ``2 * BLOCK_NUMBERS``, so that spans of
    two runs never touch.
    """

    OUTPUT = "value STRING, ingested BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "runs STRING, spans BINARY")

    def handleInputRows(self, key, rows, timerValues):
        stored = self.seen.get()
        places = {run: k for k, run in enumerate(stored[0].split(","))} if stored else {}
        # [start, stop) pairs, sorted and apart from each other.
        spans = np.frombuffer(stored[1], np.int64).reshape(-1, 2) if stored else np.empty((0, 2), np.int64)
        grown = False
        for frame in rows:
            codes, runs = pd.factorize(frame["run"])
            lines = np.array([places.setdefault(run, len(places)) for run in runs], np.int64)[codes]
            numbers = lines * (2 * BLOCK_NUMBERS) + frame["place"].to_numpy(np.int64)
            at = np.searchsorted(spans[:, 0], numbers, side="right") - 1
            known = (at >= 0) & (numbers < spans[at, 1]) if len(spans) else np.zeros(len(numbers), bool)
            fresh = ~known & ~pd.Series(numbers).duplicated().to_numpy()
            if not fresh.any():
                continue
            added = np.sort(numbers[fresh])
            spans = self._merged(np.concatenate([spans, np.stack([added, added + 1], 1)]))
            grown = True
            yield frame.loc[fresh, ["value", "ingested"]]
        if grown:
            self.seen.update((",".join(places), spans.tobytes()))

    @staticmethod
    def _merged(spans: np.ndarray) -> np.ndarray:
        """The same numbers as few spans; none overlap, some touch."""
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        opens = np.concatenate(([True], spans[1:, 0] > spans[:-1, 1]))
        last = np.concatenate((np.flatnonzero(opens)[1:] - 1, [len(spans) - 1]))
        return np.stack([spans[opens, 0], spans[last, 1]], 1)

    def close(self) -> None:
        pass


def stream_run_log(
    spark: SparkSession,
    path: str,
    delay: str | None = None,
    files_per_trigger: int | None = None,
    distinct: bool = True,
) -> DataFrame:
    """Events of the logs below ``path`` with their ingestion time.

    With ``distinct`` an event delivered again is dropped, however late. State is
    kept as spans: it grows with the runs and the gaps in the numbers seen, not with the
    events. An entry holds a block of :data:`BLOCK_NUMBERS` sequence numbers of all runs in
    one of :data:`RUN_BUCKETS` buckets, so a trigger visits so many entries at most for each
    block and not one for each run, and a long run is spread over its blocks. Events without a number cannot be told apart and all stay. With
    a ``delay`` state is dropped once the watermark has passed it, at a price: what is
    repeated later than that is no longer known, and rows of files that are older by
    more than ``delay`` than the newest one are dropped.
    """
    # A file counts by being new, not by its age: the reader would pass over old ones.
    reader = spark.readStream.option("maxFileAge", "36500d")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    ingested = F.col("_metadata.file_modification_time").alias("ingested")
    lines = reader.text(path).select("value", ingested)
    if distinct and delay is None:
        head = F.from_json("value", "run_id DECIMAL(20,0), sequence BIGINT, event STRING")
        told = lines.select(head.alias("h"), "value", F.unix_micros("ingested").alias("ingested")).where("h.event is not null")
        numbered = F.col("h.run_id").isNotNull() & F.col("h.sequence").isNotNull()
        known = (
            told.where(numbered)
            .select(
                F.pmod(F.xxhash64("h.run_id"), F.lit(RUN_BUCKETS)).alias("bucket"),
                F.shiftright("h.sequence", BLOCK_BITS).alias("block"),
                F.col("h.run_id").cast("string").alias("run"),
                F.col("h.sequence").bitwiseAND(BLOCK_NUMBERS - 1).alias("place"),
                "value",
                "ingested",
            )
            .groupBy("bucket", "block")
            .transformWithStateInPandas(
                statefulProcessor=_FirstSeen(), outputStructType=_FirstSeen.OUTPUT, outputMode="Append", timeMode="None"
            )
        )
        lines = known.unionByName(told.where(~numbered).select("value", "ingested")).select(
            "value", F.timestamp_micros("ingested").alias("ingested")
        )
    events = lines.select(F.from_json("value", schemas.RUN_LOG).alias("e"), "ingested").select("e.*", "ingested")
    events = events.where(F.col("event").isNotNull())
    if delay is None:
        return events
    events = events.withWatermark("ingested", delay)
    return events.dropDuplicatesWithinWatermark(["run_id", "sequence"]) if distinct else events


class _Transitions(StatefulProcessor):
    """Follows the tasks of a run that fall into one bucket, or the run itself, and tells every change.

    Each access to the state is a message to the JVM, so the tasks of a bucket are one
    entry, read and written once a trigger. Tasks beyond ``limit`` have entries of their own.
    """

    OUTPUT = "run_id DECIMAL(20,0), task STRING, before STRING, after STRING"

    def __init__(self, limit: int = BUCKET_TASKS):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getValueState("tasks", "states STRING")
        self.more = handle.getMapState("more", "task STRING", "sequence BIGINT, state STRING")

    def handleInputRows(self, key, rows, timerValues):
        run_id, _ = key
        stored = self.tasks.get()
        # The name of a task (null: the run itself) to its greatest sequence and state.
        known = dict(json.loads(stored[0])) if stored else {}
        before, beyond = {}, {}
        for row in rows:
            task = row.task
            if task in known:
                number, state = known[task]
            elif task in beyond:
                number, state = beyond[task]
            elif len(known) < self.limit:
                number, state = -1, None
            else:
                number, state = (self.more.getValue((task,)) if self.more.containsKey((task,)) else None) or (-1, None)
                beyond[task] = number, state
            before.setdefault(task, (number, state))
            if task is None:
                state = FINISHED if row.event == "run_finished" else state or STARTED
            elif row.event == "task_finished" and row.sequence > number:
                number, state = row.sequence, row.status or RUNNING
            else:
                state = state or RUNNING
            (beyond if task in beyond else known)[task] = number, state
        changed = [task for task, was in before.items() if tuple((beyond if task in beyond else known)[task]) != tuple(was)]
        for task in changed:
            if task in beyond:
                self.more.updateValue((task,), beyond[task])
        if any(task not in beyond for task in changed):
            self.tasks.update((json.dumps(list(known.items())),))
        for task in changed:
            state = (beyond if task in beyond else known)[task][1]
            if state != before[task][1]:
                yield Row(run_id=run_id, task=task, before=before[task][1], after=state)

    def close(self) -> None:
        pass


def stream_transitions(events: DataFrame) -> DataFrame:
    """``run_id, task, before, after``: every change of a task's state, as it becomes known.

    ``before`` is null when a task is first seen, ``after`` is its status or
    :data:`RUNNING`. The last finish by sequence counts, so a late older one changes
    nothing, and an event that comes again neither. The run itself is a row without
    task that goes to :data:`STARTED` and :data:`FINISHED`. Tasks of a run are dealt to
    :data:`TASK_BUCKETS` buckets, each with one entry for up to :data:`BUCKET_TASKS`
    tasks and one more for each task beyond.
    """
    return (
        events.where(F.col("run_id").isNotNull())
        .select(
            F.col("run_id").cast("decimal(20,0)").alias("run_id"),
            "task",
            "event",
            F.coalesce("sequence", F.lit(0).cast("bigint")).alias("sequence"),
            "status",
            # A null task, the run itself, has a hash too.
            F.pmod(F.xxhash64("task"), F.lit(TASK_BUCKETS)).alias("bucket"),
        )
        .groupBy("run_id", "bucket")
        .transformWithState(
            statefulProcessor=_Transitions(BUCKET_TASKS), outputStructType=_Transitions.OUTPUT, outputMode="Append", timeMode="None"
        )
    )


def progress_changes(transitions: DataFrame) -> DataFrame:
    """The transitions as additions and retractions of the header's counts.

    Summed by run over any number of transitions they give the counts at that time.
    """

    def moved(holds: Callable[[str], Column]) -> Column:
        return F.coalesce(holds("after").cast("bigint"), F.lit(0)) - F.coalesce(holds("before").cast("bigint"), F.lit(0))

    return transitions.select(
        "run_id",
        moved(lambda c: F.col(c) == RUNNING).alias("running"),
        moved(lambda c: F.col(c) == "completed").alias("completed"),
        moved(lambda c: F.col(c).isin(schemas.FAILED_STATUSES)).alias("failed"),
        moved(lambda c: F.col(c) == FINISHED).alias("finished"),
    )


def header_table(spark: SparkSession, path: str, fold_every: int = 16) -> CountTable:
    """The table that follows :func:`progress_changes`; read it with :func:`progress_of`."""
    schema = "run_id DECIMAL(20,0), running BIGINT, completed BIGINT, failed BIGINT, finished BIGINT"
    return CountTable(spark, path, schema, ["run_id"], fold_every)


def progress_of(header: DataFrame) -> DataFrame:
    """Live header per run: running, completed and failed tasks, and whether it is over."""
    return header.withColumn("finished", F.col("finished") > 0)


class _Summaries(StatefulProcessor):
    """Counts the tasks of one run by status; tells the counts once the run is over."""

    OUTPUT = (
        "run_id DECIMAL(20,0), completed BIGINT, cached BIGINT, failed BIGINT, cancelled BIGINT, "
        "blocked BIGINT, abandoned BOOLEAN, version BIGINT"
    )
    STATE = (
        "completed BIGINT, cached BIGINT, failed BIGINT, cancelled BIGINT, blocked BIGINT, "
        "finished BOOLEAN, version BIGINT"
    )

    def __init__(self, places: dict[str, int], silent_ms: int | None):
        self.places, self.silent_ms = places, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", self.STATE)

    def _row(self, run_id, counts, finished, version) -> Row:
        return Row(*[part.split()[0] for part in self.OUTPUT.split(", ")])(run_id, *counts, not finished, version)

    def handleInputRows(self, key, rows, timerValues):
        *counts, finished, version = self.state.get() or (0, 0, 0, 0, 0, False, 0)
        told = (list(counts), finished)
        for row in rows:
            finished = finished or row.after == FINISHED
            for state, step in ((row.before, -1), (row.after, 1)):
                if state in self.places:
                    counts[self.places[state]] += step
        changed = (counts, finished) != told
        if finished and changed:
            version += 1
        self.state.update((*counts, finished, version))
        if self.silent_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if not finished:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        if finished and changed:
            yield self._row(key[0], counts, finished, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A run that stays silent is told as abandoned; what comes later corrects that."""
        *counts, finished, version = self.state.get()
        self.state.update((*counts, finished, version + 1))
        yield self._row(key[0], counts, finished, version + 1)

    def close(self) -> None:
        pass


def stream_run_finish(transitions: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """One row with the counts of a run when it finishes, and one more for each later correction.

    The second of two chained stateful operators: :func:`stream_transitions` has the
    states of the tasks, this has a few counts a run and reads one narrow row for each change
    of a task. The counts are those of the batch summary: a task without a finish
    counts as blocked. ``version`` counts the rows of a run from 1; see
    :func:`latest_summaries`. With ``silent_ms`` a run of which nothing new was heard
    for that time is told with ``abandoned`` set.
    """
    places = {"completed": 0, "cached": 1, "cancelled": 3, "blocked": 4, RUNNING: 4}
    places |= {status: 2 for status in schemas.FAILED_STATUSES}
    return transitions.groupBy("run_id").transformWithState(
        statefulProcessor=_Summaries(places, silent_ms),
        outputStructType=_Summaries.OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if silent_ms is not None else "None",
    )


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The newest row of every run out of what :func:`stream_run_finish` emitted."""
    newest = F.max_by(F.struct(*runs.COUNTS, "abandoned"), "version").alias("s")
    return summaries.groupBy("run_id").agg(newest).select("run_id", "s.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Read everything available into a table below ``path`` and return it.

    Jobs with a time limit keep a clock and never run out of work: start those with
    a processing-time trigger instead.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
