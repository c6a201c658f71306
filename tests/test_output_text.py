"""Framing, tails, caps and failure reports."""

import random

import pytest

from runledger.operators import output_text as out

CHUNK = "run_id bigint, task string, stream string, sequence bigint, data binary"
BREAK = "run_id bigint, task string, sequence bigint"


def chunks(spark, items):
    return spark.createDataFrame(
        [(1, task, stream, seq, bytearray(data)) for task, stream, seq, data in items], CHUNK
    )


def breaks(spark, items):
    return spark.createDataFrame([(1, task, seq) for task, seq in items], BREAK)


def test_partial_lines_join(spark, rows):
    framed = out.frame_lines(
        chunks(spark, [("api", "stdout", 1, b"one"), ("api", "stdout", 2, b"\ntwo\n")]),
        breaks(spark, []),
    )
    assert rows(framed, "line_no", "line", "flushed") == [
        (0, "[api] one", False), (1, "[api] two", False),
    ]


def test_interleaved_streams_and_flush(spark, rows):
    framed = out.frame_lines(
        chunks(spark, [
            ("api", "stdout", 1, b"a1"), ("web", "stdout", 2, b"w\n"), ("api", "stderr", 3, b"e\n"),
            ("api", "stdout", 4, b"a2"), ("api", "stdout", 6, b"again\n"),
        ]),
        breaks(spark, [("api", 5)]),
    )
    assert rows(framed, "task", "stream", "segment", "line", "flushed") == [
        ("api", "stderr", 0, "[api] e", False),
        ("api", "stdout", 0, "[api] a1a2", True),
        ("api", "stdout", 1, "[api] again", False),
        ("web", "stdout", 0, "[web] w", False),
    ]


def brute_lines(items, marks):
    """Reference result by walking the events in order."""
    found, state = [], {}
    timeline = sorted(
        [(seq, 1, task, stream, data) for task, stream, seq, data in items]
        + [(seq, 0, task, None, b"") for task, seq in marks],
        key=lambda e: e[:2],
    )

    def flush(task, segment):
        for stream in ("stdout", "stderr"):
            part, number = state.pop((task, stream), (b"", 0))
            if part:
                found.append((task, stream, segment, number, part, True))

    segments = {}
    for _, kind, task, stream, data in timeline:
        segment = segments.setdefault(task, 0)
        if kind == 0:
            flush(task, segment)
            segments[task] += 1
            continue
        part, number = state.get((task, stream), (b"", 0))
        *done, rest = (part + data).split(b"\n")
        for line in done:
            found.append((task, stream, segment, number, line, False))
            number += 1
        state[task, stream] = (rest, number)
    for task, segment in segments.items():
        flush(task, segment)
    return found


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_framing_equals_a_sequential_walk(spark, rows, block):
    pick = random.Random(11)
    items, marks = [], []
    for seq in range(300):
        task = "hot" if pick.random() < 0.7 else pick.choice("ab")
        if pick.random() < 0.1:
            marks.append((task, seq))
        else:
            data = bytes(pick.choice(b"xy\n") for _ in range(pick.randint(0, 6)))
            items.append((task, pick.choice(["stdout", "stderr"]), seq, data))
    framed = out.frame_lines(chunks(spark, items), breaks(spark, marks), block)
    want = [
        (t, s, g, n, f"[{t}] {line.decode()}", f) for t, s, g, n, line, f in brute_lines(items, marks)
    ]
    assert rows(framed, "task", "stream", "segment", "line_no", "line", "flushed") == sorted(
        want, key=repr
    )


@pytest.mark.parametrize("block", [1, 50])
def test_tail_keeps_the_newest_lines(spark, rows, block):
    text = b"".join(b"line %d\n" % i for i in range(1005))
    framed = out.frame_lines(
        chunks(spark, [("t", "stdout", 1, text[:4000]), ("t", "stdout", 2, text[4000:]),
                       ("t", "stderr", 3, b"oops")]),
        breaks(spark, []),
    )
    tail = out.tail_lines(framed, 1000, block).collect()
    lines = {r.line for r in tail}
    assert len(tail) == 1000
    assert "! oops" in lines and "line 1004" in lines and "line 6" in lines
    assert "line 5" not in lines


@pytest.mark.parametrize("block", [1, 1000])
def test_cap_keeps_exactly_the_limit(spark, rows, block):
    output = chunks(spark, [
        ("t", "stdout", 1, b"abc"), ("t", "stdout", 2, b"defg"), ("t", "stdout", 3, b"h"),
        ("t", "stderr", 4, b"12345"), ("u", "stdout", 5, b"12345"),
    ])
    tasks = spark.createDataFrame([(1, "t", 5), (1, "u", 5)], "run_id bigint, task string, max_output_bytes bigint")
    capped = out.cap_output(output, tasks, block)
    assert rows(capped, "task", "stream", "sequence", "data", "truncated") == [
        ("t", "stderr", 4, bytearray(b"12345"), False),
        ("t", "stdout", 1, bytearray(b"abc"), False),
        ("t", "stdout", 2, bytearray(b"de"), True),
        ("u", "stdout", 5, bytearray(b"12345"), False),
    ]
    assert rows(out.overflowed_streams(capped), "task", "exceeded_stream") == [("t", "stdout")]


def test_failure_report_order(spark):
    results = spark.createDataFrame(
        [(1, "a", 0, "completed"), (1, "b", 1, "failed"), (1, "c", 2, "timed_out")],
        "run_id bigint, task string, plan_pos bigint, status string",
    )
    output = chunks(spark, [
        ("b", "stderr", 3, b"bad"), ("b", "stdout", 1, b"x"), ("b", "stdout", 2, b"y"),
        ("a", "stdout", 4, b"fine"),
    ])
    report = out.failure_output(results, output).orderBy("run_id", "plan_pos", "part", "sequence")
    assert [r.text for r in report.collect()] == [
        "b captured output:", "stdout:", "x", "y", "stderr:", "bad",
    ]
