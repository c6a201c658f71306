"""Runs of words that repeat with a period, found by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) and a length of at least max(6, 4 q) that no neighbouring word extends.
Every word of a run therefore stands in it four times or more. A word that is rarer
than that in the segment under view lies in no run there and splits it; the pieces
are counted anew, until nothing splits. Most of a text falls away like this.

Surviving segments are scanned lag by lag. A stretch that agrees at lag q for 3 q
places or more covers a whole [k q, (k + 2) q], so only multiples of q are looked
at: about m log m comparisons for a segment of m words. Where the multiples agree,
hashes of the q words that follow are compared, and what is left is settled word by
word, so the result is exact whatever the hashes do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import id_and_text, map_batches, texts_of

#: Least length of a run in words, and in periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Odd multiplier of the rolling hash (modulo 2^64).
_BASE = 0x9E3779B97F4A7C15

_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def segments(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, stop) in which every word stands often enough to be part of a run."""
    done, open_ = [], [(0, len(numbers))]
    while open_:
        start, stop = open_.pop()
        if stop - start < MIN_WORDS:
            continue
        own = numbers[start:stop]
        # Counting by number is cheap while numbers are dense; short pieces are renumbered first.
        if own.max() > 4 * len(own):
            own = np.unique(own, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(own)[own] < MIN_PERIODS)
        if not len(rare):
            done.append((start, stop))
            continue
        cuts = np.concatenate(([-1], rare, [stop - start]))
        for k in np.flatnonzero(np.diff(cuts) > MIN_WORDS):
            open_.append((start + int(cuts[k]) + 1, start + int(cuts[k + 1])))
    return done


def _primes(n: int) -> list[int]:
    """The prime divisors of n."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _reach(same: np.ndarray, step: int) -> int:
    """How many leading (step 1) or trailing (step -1) places of ``same`` are true."""
    broken = np.flatnonzero(~same)
    if not len(broken):
        return len(same)
    return int(broken[0]) if step > 0 else len(same) - 1 - int(broken[-1])


def _extend(own: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The places [start, stop) around ``at`` where words ``lag`` apart agree; doubling steps."""
    start = stop = at
    width = 2 * lag + 16
    while stop < len(own) - lag:
        end = min(stop + width, len(own) - lag)
        got = _reach(own[stop:end] == own[stop + lag : end + lag], 1)
        stop += got
        if stop < end:
            break
        width *= 2
    width = 2 * lag + 16
    while start > 0:
        begin = max(0, start - width)
        got = _reach(own[begin:start] == own[begin + lag : start + lag], -1)
        start -= got
        if start > begin:
            break
        width *= 2
    return start, stop


def scan(own: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment."""
    m = len(own)
    found: list[tuple[int, int, int]] = []
    hashes = powers = None
    #: For each place the run that was last found to cover it.
    owner = np.full(m, -1, np.int64)
    for lag in range(1, m // MIN_PERIODS + 1):
        at = own[::lag]
        same = at[1:] == at[:-1]
        # Agreement at three multiples in a row, the least that a run covers.
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(hits):
            continue
        if lag > 2:
            if hashes is None:
                hashes, powers = _prefix_hashes(own)
            hits = hits[_agree(hashes, powers, hits * lag, lag, 2 * lag)]
        past = 0
        for k in hits.tolist():
            place = k * lag
            if place < past:
                continue
            held = owner[place]
            if held >= 0:
                start, length, period = found[held]
                # Inside a run whose period divides the lag, agreement says nothing new.
                if lag % period == 0 and place + 2 * lag <= start + length:
                    past = max(past, start + length - 2 * lag)
                    continue
            start, stop = _extend(own, lag, place)
            past = max(stop, place + 1)
            length = stop - start + lag
            if length < max(MIN_WORDS, MIN_PERIODS * lag):
                continue
            stretch = own[start : start + length]
            if any(np.array_equal(stretch[: -(lag // p)], stretch[lag // p :]) for p in _primes(lag)):
                continue
            owner[start : start + length] = len(found)
            found.append((start, length, lag))
    return found


def _prefix_hashes(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes h with h[i + n] - h[i] = (hash of n words from i) times a power, and the powers."""
    powers = np.empty(len(own) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    mixed = (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(mixed * powers[:-1], out=hashes[1:])
    return hashes, powers


def _agree(hashes: np.ndarray, powers: np.ndarray, at: np.ndarray, lag: int, width: int) -> np.ndarray:
    """Whether the ``width`` words from each place have the hash of those ``lag`` further on."""
    near = hashes[at + width] - hashes[at]
    return near * powers[lag] == hashes[at + lag + width] - hashes[at + lag]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    numbers = word_numbers(words)
    found = [
        (start + s, length, period)
        for start, stop in segments(numbers)
        for s, length, period in scan(numbers[start:stop])
    ]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    dropped = np.cumsum(edges[:-1]) > 0
    return [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, kept``: the runs of every document, by start, then period, and its other words.

    Words are what ASCII white space separates, numbered from 0. ``kept`` is the text
    without the words that a run holds after its first period, joined by one space.
    A null, empty or blank text has no runs and keeps nothing (an empty text, not
    null). Rows are treated one by one, so repeated rows and ids, and null ids, give
    as many rows. Further columns are not read; an empty table gives no rows. One
    text at a time is held in a worker, in about 60 bytes a word.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, kept = [], []
        for text in texts_of(batch.column(1)):
            words = text.split()
            own = runs_of(words)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
            kept.append(b" ".join(collapse(words, own)))
        columns = [batch.column(0), pa.array(runs, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "kept"])

    return map_batches(id_and_text(docs), work, _SCHEMA)


def plant_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a period in every tenth text, by the crc32 of its id.

    With h the checksum and g = h div 10, a text of n > 0 words with h % 10 = 0 gets its
    word a + (i - a) % p at every place i >= a, where a = g % n and p = 1 + (n - a) div
    (3 + g % 8). Rows without an id stay as they are.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", checksum.alias("h")).select(
        "doc_id",
        "text",
        F.floor(F.col("h") / 10).alias("g"),
        F.when(F.col("h") % 10 == 0, words).alias("words"),
    )
    n, a, g = F.size("words"), F.col("a"), F.col("g")
    placed = chosen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - a) / (3 + g % 8)))
    at = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform(at, lambda i: F.get("words", source(i))), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, longest run and digests of what :func:`find_runs` returned."""
    rank = F.transform(
        "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("fine"))
    )
    lines = F.transform(
        "runs",
        lambda r: F.concat(
            r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")
        ),
    )
    return found.select("doc_id", "runs", "kept", F.array_max(rank).alias("longest")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.fine")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.fine")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
