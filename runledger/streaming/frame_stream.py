"""Live framing of task output, whatever the order in which its chunks arrive.

The sequence of a log counts the events of a whole run, so a task's own events do
not tell whether one of them is still missing. :func:`number_steps` numbers them
where the log is written; the stream keeps what comes too early by that number and
goes on when the gap closes.
"""

from __future__ import annotations

import sys
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runledger.functions import ordered

# The state processor below travels with its query, so that workers need no
# copy of this package. It only uses what this module itself defines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Events of a task that are sorted at a time.
SORTED_ROWS = 256


def number_steps(events: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Add ``step``: the place of an event among those of its task, from 0.

    To be used on a log before it is written. Events without a task have no step.
    """
    of_task = F.col("task").isNotNull() & F.col("run_id").isNotNull()
    placed = ordered.position(
        events.where(of_task), ["run_id", "task"], ["sequence"], ordered.block_of("sequence", block_rows), "step"
    )
    return placed.unionByName(events.where(~of_task).withColumn("step", F.lit(None).cast("bigint")))


class _FrameLines(StatefulProcessor):
    """Takes the events of one task by step; keeps unfinished lines and early events."""

    OUTPUT = (
        "run_id DECIMAL(20,0), task STRING, stream STRING, segment BIGINT, line_no BIGINT, "
        "line STRING, flushed BOOLEAN"
    )
    STREAMS = ("stdout", "stderr")

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The next step, the number of the next line of either stream, and what else has an
        # entry (``held``: 1 for stdout, 2 for stderr): asking the state is a message each time.
        self.place = handle.getValueState("place", "step BIGINT, segment BIGINT, out_no BIGINT, err_no BIGINT, held BIGINT, waiting BOOLEAN")
        # What is there of the unfinished line, piece by piece: a long one is never copied.
        self.pieces = {s: handle.getListState(f"{s}_pieces", "data BINARY") for s in self.STREAMS}
        self.early = handle.getMapState("early", "step BIGINT", "stream STRING, data BINARY")
        self.row = Row(*[part.split()[0] for part in self.OUTPUT.split(", ")])

    def _load(self) -> None:
        self.step, self.segment, *numbers, held, self.waiting = self.place.get() or (0, 0, 0, 0, 0, False)
        self.numbers = dict(zip(self.STREAMS, numbers, strict=True))
        self.held = {s for k, s in enumerate(self.STREAMS) if held >> k & 1}
        self.added = {s: [] for s in self.STREAMS}
        self.found = []

    def _store(self) -> None:
        for stream, pieces in self.added.items():
            if pieces:
                self.pieces[stream].appendList([(p,) for p in pieces])
                self.held.add(stream)
        held = sum(1 << k for k, s in enumerate(self.STREAMS) if s in self.held)
        self.waiting = self.waiting and self.early.exists()
        self.place.update((self.step, self.segment, *self.numbers.values(), held, self.waiting))

    def _rest(self, stream: str) -> bytes:
        """The unfinished line, which ends here."""
        stored = []
        if stream in self.held:
            stored = [bytes(p) for (p,) in self.pieces[stream].get()]
            self.pieces[stream].clear()
            self.held.remove(stream)
        rest = b"".join(stored + self.added[stream])
        self.added[stream] = []
        return rest

    def _tell(self, stream: str, line: bytes, flushed: bool) -> None:
        self.found.append((stream, self.segment, self.numbers[stream], line, flushed))
        self.numbers[stream] += 1

    def _flush(self) -> None:
        for stream in self.STREAMS:
            rest = self._rest(stream)
            if rest:
                self._tell(stream, rest, True)
            self.numbers[stream] = 0
        self.segment += 1

    def _take(self, stream: str | None, data: bytes | None) -> None:
        """One event: a chunk, a flush (stream ``flush``), or one of no interest."""
        self.step += 1
        if stream == "flush":
            self._flush()
        elif stream is not None:
            first, *others = bytes(data).split(b"\n")
            if others:
                self._tell(stream, self._rest(stream) + first, False)
                for line in others[:-1]:
                    self._tell(stream, line, False)
                first = others[-1]
            if first:
                self.added[stream].append(first)

    def _take_early(self) -> None:
        """Early events whose turn has come."""
        while self.early.containsKey((self.step,)):
            at = self.step
            stream, data = self.early.getValue((at,))
            self.early.removeKey((at,))
            self._take(stream, data)

    def _lines(self, key):
        run_id, task = key
        for stream, segment, number, line, flushed in self.found:
            yield self.row(run_id, task, stream, segment, number, f"[{task}] {line.decode('utf-8', 'replace')}", flushed)
        self.found = []

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        rows = iter(rows)
        # Rows of a trigger come in any order: sorted by step, few of them have to wait.
        while some := list(islice(rows, SORTED_ROWS)):
            for row in sorted(some, key=lambda r: r.step):
                if row.step == self.step:
                    self._take(row.stream, row.data)
                    if self.waiting:
                        self._take_early()
                elif row.step > self.step:
                    self.early.updateValue((row.step,), (row.stream, row.data))
                    self.waiting = True
                yield from self._lines(key)
        self._store()
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A task that stays silent: what is missing is given up, and all is flushed."""
        self._load()
        for step in sorted(step for (step,) in self.early.keys()):
            self.step = step
            self._take_early()
        self._flush()
        self._store()
        yield from self._lines(key)

    def close(self) -> None:
        pass


def stream_frame_lines(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Complete lines as they arrive, per task and stream.

    ``events``: run_id, task, step, event, stream, data and attempt of all events of
    the tasks, as :func:`number_steps` numbered them; a further attempt and a finish
    flush what is unfinished. Events may come in any order, and again: one that is
    early waits in the state, under its step, until those before it are there; one
    whose step has passed is dropped. With ``idle_ms`` a task of which nothing is
    heard for that time is flushed, and goes on behind the gap it was waiting for.
    Rows without a task or step are passed over.
    """
    event = F.col("event")
    flush = (event == "task_finished") | ((event == "task_attempt_started") & (F.col("attempt") > 1))
    return (
        events.where(F.col("run_id").isNotNull() & F.col("task").isNotNull() & F.col("step").isNotNull())
        .select(
            F.col("run_id").cast("decimal(20,0)").alias("run_id"),
            "task",
            "step",
            F.when(flush, "flush").when(event == "task_output", F.col("stream")).alias("stream"),
            F.when(event == "task_output", F.col("data")).alias("data"),
        )
        .groupBy("run_id", "task")
        .transformWithState(
            statefulProcessor=_FrameLines(idle_ms),
            outputStructType=_FrameLines.OUTPUT,
            outputMode="Append",
            timeMode="ProcessingTime" if idle_ms is not None else "None",
        )
    )
