"""Cross-entropy difference of two matched n-gram models.

The target model is counted over the documents that the labels call good, the
background model over all documents. Both are bigram models over one shared
vocabulary, smoothed in the same way: a word's probability after
another is its share there, backed by its share anywhere, backed by the uniform
share. A document's score is the mean per-token difference of their losses. What a
document itself adds to a model is taken out of the model that scores it.

Counts cover every token of every document, word by word and pair by pair. A word
is known by a hash of 64 bits, a pair by both of its words. A document's distinct
pairs are dealt to buckets by their second word, so that a bucket holds all that is
needed: how often each of its pairs and words occurs, and what follows for the
documents they came from. The number of buckets grows with the corpus. Pairs of a
word that is very frequent are spread over all buckets, and its counts are sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import WordHashes, folded_words, id_and_text, mix, small_batches, texts_of
from runledger.session import settle

#: Tokens of a bucket on average, and tokens that a task packs at a time.
BUCKET_TOKENS = 1 << 21
CHUNK_TOKENS = 1 << 20
#: A word with this share of all tokens is sent: there are at most so many.
HOT_WORDS = 1 << 14
#: Target ids that are broadcast at most; more are joined by key and the joined rows stored, with the same result.
BROADCAST_IDS = 1_000_000
#: What a scored document is.
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
#: Pseudo-count that a model lends to the next coarser one.
BACKING = 4.0

_U = np.uint64


class Corpus:
    """What is sent to the tasks: sums over the corpus, and the counts of its most frequent words."""

    def __init__(self, words: DataFrame):
        sums = words.agg(F.count("*"), F.sum("total"), F.sum("target")).first()
        self.tokens = (float(sums[2] or 0), float(sums[1] or 0))
        self.uniform = 1.0 / max(1, sums[0])
        self.buckets = max(1, -(-int(self.tokens[1]) // BUCKET_TOKENS))
        # No more than HOT_WORDS words can have this share.
        hot = words.where(F.col("total") * HOT_WORDS >= self.tokens[1]).collect()
        hot.sort(key=lambda r: r["word"])
        self.hot = np.array([r["word"] for r in hot], np.int64).view(_U)
        by_hash = np.argsort(self.hot)
        self.hot = self.hot[by_hash]
        self.counts = np.array([[r["target"] for r in hot], [r["total"] for r in hot]], float)[:, by_hash]

    def hot_at(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word whether its counts are here, and where."""
        if not len(self.hot):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return self.hot[at] == words, at


def _pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + words)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows without their text, and the word hashes of each text, about CHUNK_TOKENS at a time.

    The text is the first column; hash 0 stands for the start of a text, so no word has it.
    """
    memory, rows, texts, held = WordHashes(), [], [], 0
    for batch in small_batches(batches):
        others = [c.to_pylist() for c in batch.columns[1:]]
        for data, *row in zip(texts_of(batch.column(0)), *others, strict=True):
            hashes = memory.of(folded_words(data))
            hashes[hashes == 0] = 1
            rows.append(tuple(row))
            texts.append(hashes)
            held += len(hashes) + 1
            if held >= CHUNK_TOKENS:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def count_words(marked: DataFrame) -> DataFrame:
    """``word, total, target``: how often each word occurs, in all documents and in target ones."""

    def run(batches):
        for rows, texts in _chunks(batches):
            chosen = np.repeat([bool(r[0]) for r in rows], [len(t) for t in texts])
            words, at, total = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
            target = np.bincount(at, weights=chosen, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(total), pa.array(target)], ["word", "total", "target"]
            )

    counted = marked.select("text", "target").mapInArrow(run, "word long, total long, target long")
    return counted.groupBy("word").agg(F.sum("total").alias("total"), F.sum("target").alias("target"))


def _starts(*changing: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts in sorted columns."""
    first = np.zeros(len(changing[0]), bool)
    first[:1] = True
    for column in changing:
        first[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(first)


def _own_counts(place: np.ndarray, words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each pair of a text how often the text holds the pair's word."""
    order = np.lexsort((words, place))
    start = _starts(place[order], words[order])
    total = np.add.reduceat(times[order], start)
    out = np.empty(len(times), np.uint32)
    out[order] = np.repeat(total, np.diff(np.append(start, len(order))))
    return out


def _pack(rows: list[tuple], texts: list[np.ndarray], corpus: Corpus) -> Iterator[tuple[int, bytes]]:
    """Of each bucket the distinct pairs of these texts and the texts that hold them, as bytes.

    Six arrays: per pair the word before and the word; how many texts hold it;
    per pair and text twice the place of the text plus whether it is a target
    one, twice the number of times plus whether the text ends with it, and how
    often the text holds the word. A seventh has the length of each text that occurs.
    """
    lengths = np.array([len(t) for t in texts])
    words = np.concatenate(texts)
    if not len(words):
        return
    place = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    ends = np.cumsum(lengths)[lengths > 0]
    before = np.concatenate([np.zeros(1, _U), words[:-1]])
    before[(ends - lengths[lengths > 0])] = 0
    last = np.zeros(len(words), np.uint32)
    last[ends - 1] = 1
    keys = _pair_keys(before, words)
    spread = np.where(corpus.hot_at(words)[0], keys, mix(words))
    bucket = (spread % _U(corpus.buckets)).astype(np.int32)
    order = np.lexsort((keys, words, bucket))  # places stay in order
    bucket, words, before, place, keys, last = (c[order] for c in (bucket, words, before, place, keys, last))
    entry = _starts(keys, place, words)
    times = np.diff(np.append(entry, len(words))).astype(np.uint32)
    ending = np.maximum.reduceat(last, entry)
    chosen = np.array([bool(r[2]) for r in rows], np.uint32)
    bucket, words, before, place, keys = (c[entry] for c in (bucket, words, before, place, keys))
    code, count = place << 1 | chosen[place], times << 1 | ending
    own_word = _own_counts(place, words, times)
    pair = _starts(keys, words)
    holders = np.diff(np.append(pair, len(words))).astype(np.uint32)
    cut = _starts(bucket)
    pair_cut = np.append(np.searchsorted(pair, cut), len(pair))
    cut = np.append(cut, len(words))
    packer = zstandard.ZstdCompressor(level=1)
    for k in range(len(cut) - 1):
        own, at = slice(pair_cut[k], pair_cut[k + 1]), slice(cut[k], cut[k + 1])
        long = lengths[np.unique(place[at])].astype(np.uint32)
        parts = before[pair[own]], words[pair[own]], holders[own], code[at], count[at], own_word[at], long
        sizes = np.array([len(parts[0]), len(parts[3]), len(long)], np.int64)
        yield int(bucket[cut[k]]), packer.compress(b"".join(p.tobytes() for p in (sizes, *parts)))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    pairs, entries, texts = np.frombuffer(data, np.int64, 3).tolist()
    out, at = [], 24
    for kind, n in ((_U, pairs), (_U, pairs), *((np.uint32, n) for n in (pairs, entries, entries, entries, texts))):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _bucket_losses(blobs: list[list[np.ndarray]], bases: list[np.ndarray], corpus: Corpus):
    """Rows that hold pairs of one bucket, and what these add to the rows' summed losses.

    The loss of a token is ``log2(context + BACKING) - log2(held + BACKING * alone)``. The
    first part is added where the word before is counted: each word but a text's last
    is the word before of one token, and a text's start has a count of 0. The row's own
    counts are taken out of every count.
    """
    before, words, holders, code, count, own_times = (np.concatenate(c) for c in list(zip(*blobs, strict=True))[:6])
    long = np.concatenate([c[6][np.unique(c[3] >> 1, return_inverse=True)[1]] for c in blobs])
    row = np.concatenate([b[c[3] >> 1] for b, c in zip(bases, blobs, strict=True)])
    times, ends = (count >> 1).astype(float), count & 1
    in_model = ((code & 1).astype(float), 1.0)
    pairs, own_pair = np.unique(_pair_keys(before, words), return_inverse=True)
    vocabulary, own_word = np.unique(words, return_inverse=True)
    own_pair, own_word = np.repeat(own_pair, holders), np.repeat(own_word, holders)
    first = np.repeat(before == 0, holders)
    sent, at = corpus.hot_at(vocabulary)
    rows, own_row = np.unique(row, return_inverse=True)
    sums = []
    for model, inside in enumerate(in_model):
        weight = times * inside
        alone = np.bincount(own_word, weights=weight, minlength=len(vocabulary))
        alone[sent] = corpus.counts[model][at[sent]]
        held = np.bincount(own_pair, weights=weight, minlength=len(pairs))[own_pair]
        held[first] = 0.0
        held -= np.where(first, 0.0, weight)
        others = alone[own_word] - own_times * inside
        share = (others + BACKING * corpus.uniform) / (corpus.tokens[model] - long * inside + BACKING)
        loss = (times - ends) * np.log2(others + BACKING) + first * math.log2(BACKING)
        loss -= times * np.log2(held + BACKING * share)
        sums.append(np.bincount(own_row, weights=loss, minlength=len(rows)))
    return rows, *sums


def _score(marked: DataFrame) -> DataFrame:
    """Scores of ``doc_id, text, target``, whose rows must come in the same order whenever they are read."""
    spark = marked.sparkSession
    corpus = Corpus(settle(count_words(marked), "lm-words"))
    sent = spark.sparkContext.broadcast(corpus)

    def pack(batches):
        for rows, texts in _chunks(batches):
            ids, row_ids = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
            packed = list(_pack(rows, texts, sent.value))
            # Row ids count up within a task, so one bucket gets the rows themselves.
            packed.append((int(row_ids[0]) % sent.value.buckets, None))
            n = len(packed)
            own = pa.array([None] * (n - 1) + [ids], pa.list_(pa.int64()))
            lengths = pa.array([None] * (n - 1) + [[len(t) for t in texts]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in packed], pa.int32()),
                    pa.array([int(row_ids[0])] * n, pa.int64()),
                    pa.array([d for _, d in packed], pa.binary()),
                    own,
                    lengths,
                ],
                ["bucket", "base", "pairs", "ids", "lengths"],
            )

    def add_up(table: pa.Table) -> pa.Table:
        given = table.select(["base", "pairs", "ids", "lengths"]).to_pylist()
        blobs = [(r["base"], _unpack(r["pairs"])) for r in given if r["pairs"] is not None]
        out = [(r["base"], None, r["ids"], r["lengths"]) for r in given if r["pairs"] is None]
        if blobs:
            bases = [base + np.arange(int(blob[3].max() >> 1) + 1, dtype=np.int64) for base, blob in blobs]
            rows, target, background = _bucket_losses([blob for _, blob in blobs], bases, sent.value)
            starts = np.unique(np.array([base for base, _ in blobs], np.int64))
            cut = np.append(np.searchsorted(rows, starts), len(rows))
            for k, base in enumerate(starts.tolist()):
                own = slice(cut[k], cut[k + 1])
                sums = (rows[own] - base).tobytes() + target[own].tobytes() + background[own].tobytes()
                out.append((base, sums, None, None))
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["base", "sums", "ids", "lengths"])

    def finish(table: pa.Table) -> pa.Table:
        given = table.select(["sums", "ids", "lengths"]).to_pylist()
        head = next(r for r in given if r["sums"] is None)
        ids, lengths = head["ids"], np.array(head["lengths"], np.int64)
        losses = np.zeros((2, len(ids)))
        # Sums of floats are added in one order, so a result does not depend on arrival.
        for data in sorted(r["sums"] for r in given if r["sums"] is not None):
            at, target, background = np.frombuffer(data, np.int64).reshape(3, -1)
            losses[0, at] += target.view(np.float64)
            losses[1, at] += background.view(np.float64)
        losses /= np.maximum(lengths, 1)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(lengths), *map(pa.array, losses), pa.array(losses[0] - losses[1])],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
        )

    numbered = marked.select("text", "doc_id", F.monotonically_increasing_id().alias("row"), "target")
    packed = numbered.mapInArrow(
        pack, "bucket int, base long, pairs binary, ids array<long>, lengths array<long>"
    )
    # A row for each bucket and chunk of documents; what a chunk's documents lose is added up in one place.
    parts = packed.groupBy("bucket").applyInArrow(
        add_up, "base long, sums binary, ids array<long>, lengths array<long>"
    )
    return parts.groupBy("base").applyInArrow(finish, SCHEMA)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` of every whole text.

    ``labels`` has ``doc_id`` and ``quality``; documents with a row of quality 1
    are the target. A lower difference (target minus background, bits per token)
    is closer to the target. Null and empty texts have no tokens and losses of 0.
    A row is scored by models without its own words. Repeated rows count as often as
    they are there, so a row has its copies in the models; repeated labels make an id a
    target once; an id that is null is no target. Without any target the target
    model is uniform over the distinct words of all documents. Further columns are not
    read; an empty table gives no rows.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = settle(good.withColumn("target", F.lit(True)), "lm-target")
    if good.count() <= BROADCAST_IDS:
        # The ids have a known small size: texts are read where they are.
        return _score(id_and_text(docs).join(F.broadcast(good), "doc_id", "left"))
    # Rows are numbered by their place, which a repeated shuffle may change: they are stored.
    return _score(settle(id_and_text(docs).join(good, "doc_id", "left"), "lm-rows"))
