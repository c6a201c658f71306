"""Benchmark decontamination: BM25 over an inverted index, searched by block-max WAND.

The index holds the benchmark items, cut into segments short enough to lie
inside a passage. Every passage of every document is a query. Impacts are
divided by the score that a segment gives itself, so a score of 1 means that
all words of the segment are there, and one threshold serves all segments.

Search skips by upper bounds: first whole blocks of segments, for all passages
of a text at once; then, for a passage that some block may answer, document by
document with pivots and block maxima. Every segment above the threshold is
retrieved, there is no top-k. Every passage that retrieves an item is verified word
by word: enough of the word runs that end in its question must stand in the text
near the passage, and enough of its answer where these runs say that it should be.

Benchmarks larger than :data:`PART_BYTES` are searched in parts, one pass each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import folded_words, map_batches, small_batches, texts_of
from runledger.session import settle

#: Words of a passage; passages start every half, so a run of half as many words lies inside one.
PASSAGE_WORDS = 128
#: Share of a segment's own score that retrieves it.
THRESHOLD = 0.6
#: Segments of a block.
BLOCK = 8
#: Words of a run that is compared, and the shares of runs that must be found.
RUN_WORDS = 5
QUESTION_OVERLAP = 0.5
ANSWER_OVERLAP = 0.5
#: Words by which a word of an answer may be off its place.
SLACK_WORDS = 3
#: Benchmark text that one index holds.
PART_BYTES = 32 << 20
#: Upper bounds of passages and blocks that are held at a time.
CELLS = 1 << 17

K1, B = 1.2, 0.75


def question_and_answer(text: str) -> tuple[list[bytes], int]:
    """Words of an item, and how many of them come before its answer.

    The answer is the last sentence; an item of one sentence answers with its
    last quarter.
    """
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    words = folded_words(text.encode())
    answer = len(folded_words(parts[-1].encode())) if len(parts) > 1 else 0
    return words, len(words) - (answer or -(-len(words) // 4))


class Segment:
    """Part of an item: the index's unit."""

    def __init__(self, item: int, start: int, words: list[bytes]):
        self.item, self.start, self.words = item, start, words


class BlockMaxIndex:
    """Normalised BM25 impacts of segments by word, with the greatest of each block of segments."""

    def __init__(self, items: list[tuple[int, str]], passage_words: int, df: dict[bytes, int], n_all: int, mean: float):
        self.items = {}
        self.segments: list[Segment] = []
        for number, (item_id, text) in enumerate(items):
            words, before = question_and_answer(text)
            self.items[number] = (item_id, words, before)
            longest = passage_words // 2
            parts = max(1, -(-len(words) // longest))
            for k in range(parts):
                start, end = k * len(words) // parts, (k + 1) * len(words) // parts
                if end > start:
                    self.segments.append(Segment(number, start, words[start:end]))
        self.postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for number, segment in enumerate(self.segments):
            counts = Counter(segment.words)
            norm = K1 * (1 - B + B * len(segment.words) / mean)
            impact = {
                w: math.log(1 + (n_all - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm)
                for w, c in counts.items()
            }
            own = sum(impact.values())
            for word, value in impact.items():
                self.postings[word].append((number, value / own))
        self.ids = {word: k for k, word in enumerate(self.postings)}
        self.lists = list(self.postings.values())
        self.most = [max(v for _, v in entries) for entries in self.lists]
        self.blocks = -(-len(self.segments) // BLOCK)
        #: Per word the blocks it has entries in and their maxima, one after the other.
        maxima = []
        for entries in self.lists:
            best: dict[int, float] = {}
            for number, value in entries:
                best[number // BLOCK] = max(best.get(number // BLOCK, 0.0), value)
            maxima.append(best)
        self.maxima = maxima
        self.offsets = np.concatenate([[0], np.cumsum([len(m) for m in maxima])]).astype(np.int64)
        self.block_of = np.array([b for m in maxima for b in m], np.int64)
        self.block_max = np.array([v for m in maxima for v in m.values()], np.float64)

    def bounds(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Upper bounds by passage and block: ``ids`` are the words of passages ``first``, distinct in each."""
        counts = self.offsets[ids + 1] - self.offsets[ids]
        total = int(counts.sum())
        starts = np.repeat(self.offsets[ids] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        at = starts + np.arange(total)
        passages = int(first[-1]) + 1
        cells = np.repeat(first, counts) * self.blocks + self.block_of[at]
        return np.bincount(cells, self.block_max[at], passages * self.blocks).reshape(passages, self.blocks)

    def search(
        self, ids: list[int], threshold: float, live: list[int] | None = None
    ) -> list[tuple[int, float]]:
        """All segments whose score for these distinct words reaches the threshold (block-max WAND).

        ``live``: the only blocks whose bounds for these words allow it, in order.
        """
        slack = 1e-9
        live = list(range(self.blocks)) if live is None else live
        cursors = [[self.lists[i][0][0], 0, i] for i in ids]
        self._advance(cursors, live[0] * BLOCK if live else -1)
        found = []
        while live:
            cursors = [c for c in cursors if c[0] >= 0]
            cursors.sort()
            # The pivot: the first segment that the lists up to it can lift over the threshold.
            bound, pivot = 0.0, -1
            for k, cursor in enumerate(cursors):
                bound += self.most[cursor[2]]
                if bound + slack >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            block = target // BLOCK
            ahead = bisect_left(live, block)
            if ahead == len(live):
                return found
            if live[ahead] != block:
                self._advance(cursors, live[ahead] * BLOCK)
                continue
            near = sum(self.maxima[c[2]].get(block, 0.0) for c in cursors[: pivot + 1])
            if near + slack < threshold:
                # Nothing in this block before the next list begins: skip to there.
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, target + 1)
            elif cursors[0][0] == target:
                score = sum(self.lists[c[2]][c[1]][1] for c in cursors[: pivot + 1])
                if score + slack >= threshold:
                    found.append((target, score))
                goal = target + 1
            else:
                goal = target
            self._advance(cursors[: pivot + 1], goal)
        return found

    def _advance(self, cursors: list[list[int]], goal: int) -> None:
        """Move cursors on to their first entry at or behind ``goal``; -1 where there is none."""
        for cursor in cursors:
            if cursor[0] < goal:
                entries = self.lists[cursor[2]]
                at = bisect_left(entries, (goal,), cursor[1])
                cursor[0], cursor[1] = (entries[at][0], at) if at < len(entries) else (-1, at)


def overlaps(item: list[bytes], before: int, text: list[bytes]) -> tuple[float, float]:
    """Shares of an item's question and of its answer that stand in a text.

    The question's share is that of the word runs that end in it; an item with a
    question shorter than a run has none to find. A run found in the text, at its last
    place in the item, tells where the answer should be: the answer's share is that of
    its words within :data:`SLACK_WORDS` of their places, for the run that serves it
    best, or that of the word runs that end in it, if more.
    """
    width = min(RUN_WORDS, len(item))
    runs = [tuple(item[k : k + width]) for k in range(len(item) - width + 1)]
    last = {run: k for k, run in enumerate(runs)}
    there, shifts = set(), set()
    for p in range(len(text) - width + 1):
        run = tuple(text[p : p + width])
        if run in last:
            there.add(run)
            shifts.add(p - last[run])
    hits = [run in there for run in runs]
    split = min(max(before - width + 1, 0), len(hits) - 1)
    question, answer = hits[:split], hits[split:]
    share = sum(answer) / len(answer)
    if shifts:
        share = max(share, _in_place(item, before, text, shifts) / (len(item) - before))
    return (sum(question) / len(question) if question else 1.0), share


def _in_place(item: list[bytes], before: int, text: list[bytes], shifts: set[int]) -> int:
    """Most words of an answer that one of the shifts from item to text finds near their places."""
    places: dict[bytes, list[int]] = {word: [] for word in item[before:]}
    for p, word in enumerate(text):
        if word in places:
            places[word].append(p)
    low = len(item) + SLACK_WORDS
    near = np.zeros(low + len(text) + SLACK_WORDS, np.int64)
    slack = np.arange(-SLACK_WORDS, SLACK_WORDS + 1)
    for k in range(before, len(item)):
        at = np.array(places[item[k]], np.int64) - k + low
        near[np.unique(at[:, None] + slack)] += 1
    return int(near[np.fromiter(shifts, np.int64, len(shifts)) + low].max())


class Searcher:
    """All passages of a text against one index."""

    def __init__(self, index: BlockMaxIndex, passage_words: int, threshold: float):
        self.index, self.half, self.threshold = index, passage_words // 2, threshold

    def hits(self, words: list[bytes]) -> list[tuple[int, float, float, float]]:
        """Items found and verified: id, score, shares of question and answer, of the best passage for each."""
        index, half = self.index, self.half
        ids = np.fromiter(map(index.ids.get, words, [-1] * len(words)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        ids, halves = ids[at], at // half
        # A passage is two halves; a word counts once in it. The last half needs no passage of its own.
        last = max(0, -(-len(words) // half) - 2)
        words_of = np.concatenate([ids, ids])
        passage_of = np.concatenate([halves, halves - 1])
        inside = (passage_of >= 0) & (passage_of <= last)
        width = len(index.ids)
        cells = np.unique(passage_of[inside] * width + words_of[inside])
        passage_of, words_of = cells // width, cells % width
        best: dict[int, tuple[float, float, float, float]] = {}
        step = max(1, CELLS // index.blocks)
        for first in range(0, last + 1, step):
            low, high = np.searchsorted(passage_of, [first, first + step])
            if low < high:
                self._search(words, words_of[low:high], passage_of[low:high], best)
        return [(index.items[item][0], *found[1:]) for item, found in best.items()]

    def _search(self, words: list[bytes], words_of: np.ndarray, passage_of: np.ndarray, best: dict) -> None:
        """Search and verify some passages, and keep for each item what overlaps most, then scores most."""
        index, half, first = self.index, self.half, int(passage_of[0])
        live = index.bounds(words_of, passage_of - first) + 1e-9 >= self.threshold
        for passage in (np.flatnonzero(live.any(axis=1)) + first).tolist():
            low, high = np.searchsorted(passage_of, [passage, passage + 1])
            own = np.flatnonzero(live[passage - first]).tolist()
            scores: dict[int, float] = {}
            for number, score in index.search(words_of[low:high].tolist(), self.threshold, own):
                item = index.segments[number].item
                scores[item] = max(score, scores.get(item, 0.0))
            start = passage * half
            for item, score in scores.items():
                so_far = best.get(item, (0.0, 0.0, 0.0, 0.0))
                if so_far[:2] >= (2.0, score):
                    continue  # All of it was found already.
                _, item_words, before = index.items[item]
                near = words[max(0, start - len(item_words)) : start + 2 * half + len(item_words)]
                question, answer = overlaps(item_words, before, near)
                if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
                    best[item] = max(so_far, (question + answer, score, question, answer))


@dataclass
class Part:
    """Some items of a benchmark with the whole benchmark's word statistics: what a task is sent."""

    items: list[tuple[int, str]]
    df: dict[bytes, int]
    n_all: int
    mean: float
    passage_words: int
    threshold: float
    _ready: list = field(default_factory=list)

    def searcher(self) -> Searcher:
        """Made on the first call in a worker, and kept for its later tasks."""
        if not self._ready:
            index = BlockMaxIndex(self.items, self.passage_words, self.df, self.n_all, self.mean)
            self._ready.append(Searcher(index, self.passage_words, self.threshold))
        return self._ready[0]


def _words_of_items(items: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [list(dict.fromkeys(folded_words(t))) for t in texts_of(batch.column(1))]
        lengths = [len(folded_words(t)) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.list_(pa.binary())), pa.array(lengths, pa.int64())],
            ["item_id", "words", "length"],
        )

    return map_batches(items, work, "item_id long, words array<binary>, length long")


def _parts(benchmark: DataFrame, passage_words: int, threshold: float, part_bytes: int) -> list[Part]:
    """The benchmark in parts of bounded size; none if no item has a word."""
    items = settle(
        benchmark.select(F.col("item_id").cast("long"), "text").where(F.length("text") > 0), "leak-items"
    )
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    # Word statistics are those of the whole benchmark, whatever the parts.
    described = settle(_words_of_items(items), "leak-words")
    n_all, mean = described.where("length > 0").agg(F.count("*"), F.avg("length")).first()
    frequencies = settle(
        described.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")),
        "leak-frequencies",
    )
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    out = []
    for number in range(parts if n_all else 0):
        own = items.where(part == number)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        rows = [r for r in rows if folded_words(r[1].encode())]
        used = _words_of_items(own).select(F.explode("words").alias("word")).distinct()
        df = {bytes(r["word"]): r["df"] for r in frequencies.join(used, "word").collect()}
        if rows:
            out.append(Part(rows, df, n_all, float(mean), passage_words, threshold))
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    passage_words: int = PASSAGE_WORDS,
    threshold: float = THRESHOLD,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: every verified item in a document.

    ``benchmark`` has ``item_id`` and ``text``. Null and empty items hold no
    words and are found nowhere; null and empty texts hold no items. Items of
    equal text are found together. Every row of ``docs`` is searched for itself,
    so null or repeated ids give their own rows. Further columns are not read;
    empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for part in _parts(benchmark, passage_words, threshold, part_bytes):
        sent = spark.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            for batch in small_batches(batches):
                ids = batch.column(0).to_pylist()
                out = [
                    (doc_id, *hit)
                    for doc_id, data in zip(ids, texts_of(batch.column(1)), strict=True)
                    for hit in sent.value.searcher().hits(folded_words(data))
                ]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        hits = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], schema)


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    passage_words: int = PASSAGE_WORDS,
    threshold: float = THRESHOLD,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in whose own text no benchmark item is found, with all their columns.

    Ids play no part: a row without one goes if its text holds an item, and a clean
    row stays whatever other rows share its id. Null and empty texts stay.
    """
    names, text = docs.columns, docs.columns.index("text")
    # Columns go by their place, so that they may have any name.
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    for part in _parts(benchmark, passage_words, threshold, part_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            for batch in small_batches(batches):
                texts = texts_of(batch.column(text))
                clean = [not sent.value.searcher().hits(folded_words(data)) for data in texts]
                yield batch.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.toDF(*names)
