"""Ordered task output: framing, tails, caps and failure reports.

Text is kept as ordered rows. A stream is never concatenated whole: chunks are
cut at newlines where they are, and only the pieces of one line meet again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import schemas
from runledger.functions import ordered
from runledger.functions.rows import explode_rows
from runledger.session import settle

_TASK = ["run_id", "task"]
_STREAM = [*_TASK, "stream"]


def _line_numbers(output: DataFrame, breaks: DataFrame, block_rows: int) -> DataFrame:
    """Segment and first line number of every chunk: run_id, task, stream, sequence, newlines, segment, first_line.

    A segmented scan over what is left of a chunk without its text: its newlines, and
    whether lines are flushed before it. Both streams of a task are counted from its
    start; a flush remembers the counts so far, which are subtracted from those of the
    chunks after it. Blocks are scanned for themselves, and their sums once more.
    """
    newlines = F.length("data") - F.length(F.regexp_replace(F.decode("data", "ISO-8859-1"), "\n", ""))
    out = F.col("stream") == "stdout"
    counted = output.select(*_STREAM, "sequence", newlines.cast("bigint").alias("newlines"), F.lit(0).alias("cut"))
    rows = counted.unionByName(
        breaks.select(
            *_TASK, F.lit(None).cast("string").alias("stream"), "sequence", F.lit(0).cast("bigint").alias("newlines"),
            F.lit(1).alias("cut"),
        )
    ).withColumn("block", ordered.block_of("sequence", block_rows))
    inside = Window.partitionBy(*_TASK, "block").orderBy("sequence", F.desc("cut"))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")

    def total(value: Column, window) -> Column:
        return F.coalesce(F.sum(value).over(window), zero)

    sums = {
        "cuts": F.col("cut"),
        "outs": F.when(out, F.col("newlines")).otherwise(zero),
        "errs": F.when(out, zero).otherwise(F.col("newlines")),
    }
    local = rows.select("*", *[total(v, before).alias(k) for k, v in sums.items()])
    # Counts only grow, so the greatest at a flush is that of the last flush.
    kept = {k: F.when(F.col("cut") == 1, F.col(k)) for k in ("outs", "errs")}
    local = settle(local.select("*", *[F.max(v).over(before).alias(f"{k}_from") for k, v in kept.items()]), "line-counts")
    blocks = local.groupBy(*_TASK, "block").agg(
        *[F.sum(v).alias(f"{k}_all") for k, v in sums.items()], *[F.max(v).alias(f"{k}_from") for k, v in kept.items()]
    )
    earlier = Window.partitionBy(*_TASK).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("*", *[total(F.col(f"{k}_all"), earlier).alias(f"{k}_base") for k in sums]).select(
        *_TASK, "block", *[f"{k}_base" for k in sums],
        *[F.max(F.col(f"{k}_base") + F.col(f"{k}_from")).over(earlier).alias(f"{k}_start") for k in kept],
    )

    def first_line(k: str) -> Column:
        base = F.col(f"{k}_base")
        return base + F.col(k) - F.coalesce(base + F.col(f"{k}_from"), F.col(f"{k}_start"), zero)

    return local.where("cut = 0").join(bases, [*_TASK, "block"]).select(
        *_STREAM, "sequence", "newlines",
        (F.col("cuts_base") + F.col("cuts")).cast("bigint").alias("segment"),
        F.when(out, first_line("outs")).otherwise(first_line("errs")).alias("first_line"),
    )


def frame_lines(
    output: DataFrame, breaks: DataFrame, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Complete lines per task and stream, each prefixed with its task.

    ``output``: run_id, task, stream, sequence, data, each sequence once in a run.
    ``breaks``: run_id, task, sequence of the events that flush unfinished lines (a
    retry, a finish). Result: run_id, task, stream, segment, line_no, line,
    end_sequence, flushed. Lines of a segment are numbered from zero. Numbers are
    found without the text, which is read beside them and joined by its key.
    """
    group = [*_STREAM, "segment"]
    numbered = _line_numbers(output, breaks, block_rows).join(
        output.select(*_STREAM, "sequence", F.decode("data", "ISO-8859-1").alias("text")), [*_STREAM, "sequence"]
    )
    pieces = explode_rows(
        numbered,
        [*group, "sequence", "first_line", "newlines"],
        F.split("text", "\n", -1),
        "piece",
        "i",
    ).withColumn("ended", F.col("i") < F.col("newlines"))
    line_no = (F.col("first_line") + F.col("i")).cast("bigint")
    # A piece between two newlines of one chunk is a line by itself; only the
    # outer pieces of a chunk can have partners elsewhere.
    inner = (F.col("i") > 0) & F.col("ended")
    whole = pieces.where(inner).select(
        *group,
        line_no.alias("line_no"),
        F.col("piece").alias("text"),
        F.col("sequence").alias("end_sequence"),
        F.lit(False).alias("flushed"),
    )
    joined = (
        pieces.where(~inner)
        .groupBy(*group, line_no.alias("line_no"))
        .agg(
            F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY sequence)").alias("text"),
            F.max("sequence").alias("end_sequence"),
            (~F.bool_or("ended")).alias("flushed"),
        )
        .where(~F.col("flushed") | (F.coalesce("text", F.lit("")) != ""))
    )
    text = F.make_valid_utf8(F.encode("text", "ISO-8859-1").cast("string"))
    return whole.unionByName(joined).select(
        *group,
        "line_no",
        F.concat(F.lit("["), "task", F.lit("] "), text).alias("line"),
        "end_sequence",
        "flushed",
    )


def tail_lines(
    lines: DataFrame,
    limit: int = schemas.MAX_TAIL_LINES,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """The last ``limit`` lines of each task, error output marked with ``! ``.

    Lines are in the order they were completed; unfinished ones follow when
    their segment is flushed.
    """
    prefix_length = F.length("task") + 4
    body = F.substr("line", prefix_length)
    shown = lines.withColumn(
        "line", F.when(F.col("stream") == "stderr", F.concat(F.lit("! "), body)).otherwise(body)
    )
    # A flush comes after every complete line of its segment, stdout first.
    placed = (
        shown.withColumn("late", F.when(F.col("flushed"), 1).otherwise(0))
        .withColumn("at", F.when(F.col("flushed"), 0).otherwise(F.col("end_sequence")))
        .withColumn("stream_rank", F.when(F.col("stream") == "stdout", 0).otherwise(1))
    )
    kept = ordered.last_rows(
        placed,
        _TASK,
        ["at", "stream_rank", "line_no"],
        F.struct(F.col("segment"), F.col("late"), ordered.block_of("at", block_rows)),
        limit,
    )
    return kept.drop("late", "at", "stream_rank")


def cap_output(
    output: DataFrame, tasks: DataFrame, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Keep exactly ``max_output_bytes`` of each stream.

    Result: the kept chunks with ``truncated`` telling that this chunk met the
    limit. ``tasks``: run_id, task, max_output_bytes.
    """
    sized = ordered.running_total(
        output,
        _STREAM,
        ["sequence"],
        ordered.block_of("sequence", block_rows),
        F.length("data"),
        "before",
    )
    room = F.col("max_output_bytes") - F.col("before")
    return (
        sized.join(tasks.select(*_TASK, "max_output_bytes"), _TASK)
        .where(room >= 0)
        .withColumn("truncated", F.length("data") > room)
        .withColumn("data", F.substr("data", F.lit(1), F.least(room, F.length("data")).cast("int")))
        .drop("before", "max_output_bytes")
    )


def overflowed_streams(capped: DataFrame) -> DataFrame:
    """The stream named for each overflowing task; stdout wins if both did."""
    return (
        capped.where("truncated")
        .groupBy(*_TASK)
        .agg(F.max("stream").alias("exceeded_stream"))
    )


def failure_output(results: DataFrame, output: DataFrame) -> DataFrame:
    """Captured output of failed tasks as report lines, ready to be sorted.

    Sort by run_id, plan_pos, part, sequence to read a report. Tasks that
    failed without output are left out.
    """
    failed = results.where(F.col("status").isin(schemas.ERROR_STATUSES)).select(
        *_TASK, "plan_pos"
    )
    chunks = output.where(F.length("data") > 0).join(failed, _TASK)
    key = ["run_id", "plan_pos", "task"]
    present = chunks.groupBy(*key).agg(
        F.bool_or(F.col("stream") == "stdout").alias("has_stdout"),
        F.bool_or(F.col("stream") == "stderr").alias("has_stderr"),
    )
    headers = present.select(
        *key,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(
                        F.lit(0).alias("part"),
                        F.concat("task", F.lit(" captured output:")).alias("text"),
                    ),
                    F.when(F.col("has_stdout"), F.struct(F.lit(1).alias("part"),
                                                  F.lit("stdout:").alias("text"))),
                    F.when(F.col("has_stderr"), F.struct(F.lit(3).alias("part"),
                                                  F.lit("stderr:").alias("text"))),
                )
            )
        ).alias("h"),
    ).select(*key, "h.part", F.lit(0).cast("bigint").alias("sequence"), "h.text")
    bodies = chunks.select(
        *key,
        F.when(F.col("stream") == "stdout", 2).otherwise(4).alias("part"),
        F.col("sequence").cast("bigint").alias("sequence"),
        F.make_valid_utf8(F.col("data").cast("string")).alias("text"),
    )
    return headers.unionByName(bodies)
