"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

An index holds, in the shared folder,

* ``postings``: one row per line key and document that holds it;
* ``counts``: per key the number of documents and the greatest of their ids, the
  exact truth;
* ``filters``: per shard of the key space one cuckoo filter of the keys that
  enough documents share.

A line is first asked of the filters, which know nearly all lines to be unique
from a few bytes in memory; what they let pass is decided by the exact counts.
Filters support removal, so documents can be inserted and deleted: only the
counts of the keys concerned change, and a key enters or leaves its filter when
its count crosses the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.text import SPACES, map_batches, texts_of
from runledger.session import settle

#: Code points of the shortest key that can be dropped.
MIN_CHARS = 20
#: Documents that share a key before its lines are dropped.
MIN_DOCS = 3
#: Keys per filter shard; a filter then has at most 1 MiB.
SHARD_KEYS = 1 << 18
#: Filter bytes sent to the executors at a time.
FILTER_BYTES = 16 << 20

_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = SPACES.encode()


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(_SPACES).translate(_UPPER)


def is_long(key: bytes) -> bool:
    """Whether a key has enough code points."""
    return len(key) >= MIN_CHARS and (
        key.isascii() or sum((b & 0xC0) != 0x80 for b in key) >= MIN_CHARS
    )


def key_hash(key: bytes) -> bytes:
    """128 bits that stand for a key."""
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A set of 64-bit hashes: 16-bit fingerprints in buckets of four, each at one of two places."""

    SLOTS = 4

    def __init__(self, table: np.ndarray):
        self.table = table  # one row per bucket; 0 is an empty slot
        self.mask = len(table) - 1

    @classmethod
    def for_keys(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter with these keys in, grown until all fit."""
        buckets = 1 << max(1, int(len(hashes) / (cls.SLOTS * 0.85))).bit_length()
        while True:
            made = cls(np.zeros((buckets, cls.SLOTS), np.uint16))
            if all(made.insert(int(h)) for h in hashes):
                return made
            buckets *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def _mark(h: int) -> int:
        return (h >> 48) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, h: int) -> bool:
        """Add a key; False if no room was found, and the filter must grow."""
        mark, bucket = self._mark(h), h & self.mask
        for _ in range(500):
            for at in (bucket, self._other(bucket, mark)):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    return True
            bucket = self._other(bucket, mark)
            slot = (mark ^ bucket) % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
        return False

    def remove(self, h: int) -> bool:
        """Take out a key that was added."""
        mark, bucket = self._mark(h), h & self.mask
        for at in (bucket, self._other(bucket, mark)):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether it may be in; never False for one that is."""
        marks = (hashes >> np.uint64(48)).astype(np.uint64)
        marks[marks == 0] = 1
        first = hashes & np.uint64(self.mask)
        second = (first ^ (marks * np.uint64(0x5BD1E995))) & np.uint64(self.mask)
        marks = marks.astype(np.uint16)[:, None]
        return ((self.table[first] == marks) | (self.table[second] == marks)).any(axis=1)


@dataclass
class LineIndex:
    """The stored state; every operation returns a new one and leaves the old as it is."""

    postings: DataFrame  # key binary, doc_id long
    counts: DataFrame  # key binary, docs long, last_doc long
    filters: DataFrame  # shard int, cells binary
    shards: int
    min_docs: int


def line_postings(docs: DataFrame) -> DataFrame:
    """``key, doc_id``: every long enough key of a document once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for doc_id, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            found = {key for line in data.split(b"\n") if is_long(key := line_key(line))}
            ids += [doc_id] * len(found)
            keys += map(key_hash, found)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"]
        )

    return map_batches(docs.select("doc_id", "text"), work, "key binary, doc_id long")


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _low(keys: list[bytes]) -> np.ndarray:
    """The first eight bytes of each key, which a filter holds it by."""
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if keys else np.zeros(0, np.uint64)


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(
        F.count("*").alias("docs"), F.max("doc_id").alias("last_doc")
    )


def _filters(counts: DataFrame, shards: int, min_docs: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter.for_keys(_low(table.column("key").to_pylist()))
        return table.slice(0, 1).select(["shard"]).append_column("cells", pa.array([made.to_bytes()]))

    shared = counts.where(F.col("docs") >= min_docs).select(_shard(shards).alias("shard"), "key")
    return shared.groupBy("shard").applyInArrow(build, "shard int, cells binary")


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
    """The index of a whole table. Rows without id are no documents of the index."""
    # Rows of one id may hold the same key.
    postings = line_postings(docs.where(F.col("doc_id").isNotNull())).distinct()
    postings = settle(postings, "line-postings")
    return _indexed(postings, min_docs)


def _indexed(postings: DataFrame, min_docs: int) -> LineIndex:
    # Rows of one id are one document, so an id counts once for a key.
    counts = settle(_count(postings), "line-counts")
    shared = counts.where(F.col("docs") >= min_docs).count()
    shards = max(1, -(-shared // SHARD_KEYS))
    filters = settle(_filters(counts, shards, min_docs), "line-filters")
    return LineIndex(postings, counts, filters, shards, min_docs)


def _changed(index: LineIndex, postings: DataFrame, delta: DataFrame) -> LineIndex:
    """The index after the keys of ``delta`` have new postings; other counts are taken over."""
    touched = settle(delta.select("key").distinct(), "line-touched")
    renewed = settle(_count(postings.join(touched, "key", "left_semi")), "line-renewed")
    counts = settle(
        index.counts.join(touched, "key", "left_anti").unionByName(renewed), "line-counts"
    )
    limit = index.min_docs
    before = index.counts.join(touched, "key", "left_semi").select("key", F.col("docs").alias("old"))
    moves = (
        before.join(renewed.select("key", "docs"), "key", "full")
        .select(
            "key",
            (F.coalesce("old", F.lit(0)) >= limit).alias("was"),
            (F.coalesce("docs", F.lit(0)) >= limit).alias("is"),
        )
        .where(F.col("was") != F.col("is"))
        .select(_shard(index.shards).alias("shard"), "key", F.col("is").alias("add"))
    )

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = right.column("cells").to_pylist() if right.num_rows else []
        kept = CuckooFilter.from_bytes(cells[0]) if cells else CuckooFilter.for_keys(_low([]))
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        added = left.column("add").to_pylist()
        hashes = _low(left.column("key").to_pylist()).tolist()
        full = False
        for h, add in zip(hashes, added, strict=True):
            if add:
                full |= not kept.insert(h)
            else:
                kept.remove(h)
        # A filter that overflowed is built anew from the exact counts.
        out = None if full else kept.to_bytes()
        return pa.table({"shard": pa.array([shard], pa.int32()), "cells": pa.array([out], pa.binary())})

    filters = settle(
        moves.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(
            update, "shard int, cells binary"
        ),
        "line-filters",
    )
    lost = filters.where(F.col("cells").isNull()).select("shard")
    if not lost.isEmpty():
        again = counts.withColumn("shard", _shard(index.shards)).join(lost, "shard", "left_semi")
        filters = settle(
            filters.where(F.col("cells").isNotNull()).unionByName(
                _filters(again.drop("shard"), index.shards, limit)
            ),
            "line-filters",
        )
    return LineIndex(postings, counts, filters, index.shards, limit)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with further documents; an id that it holds already gains lines."""
    fresh = line_postings(docs.where(F.col("doc_id").isNotNull())).distinct()
    fresh = settle(fresh.join(index.postings, ["key", "doc_id"], "left_anti"), "line-fresh")
    postings = settle(index.postings.unionByName(fresh), "line-postings")
    return _changed(index, postings, fresh)


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_id``; unknown ids have no effect."""
    gone = doc_ids.select("doc_id").distinct()
    removed = settle(index.postings.join(gone, "doc_id", "left_semi"), "line-removed")
    postings = settle(index.postings.join(gone, "doc_id", "left_anti"), "line-postings")
    return _changed(index, postings.select("key", "doc_id"), removed.select("key", "doc_id"))


def _suspects(index: LineIndex, postings: DataFrame) -> DataFrame:
    """Postings that the filters let pass.

    The filters go out in groups of bounded size, one pass over the narrow
    postings for each group, so memory does not grow with the corpus.
    """
    spark = postings.sparkSession
    sizes = index.filters.agg(F.max(F.length("cells")), F.count("*")).first()
    if not sizes[1]:
        return postings.limit(0)
    group = max(1, FILTER_BYTES // sizes[0])
    passed = None
    for start in range(0, index.shards, group):
        own = index.filters.where(F.col("shard").between(start, start + group - 1)).collect()
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["cells"]) for r in own})

        def ask(batches, sent=sent):
            filters = {s: CuckooFilter.from_bytes(c) for s, c in sent.value.items()}
            for batch in batches:
                hashes = _low(batch.column(0).to_pylist())
                shards = batch.column(2).to_numpy(zero_copy_only=False)
                keep = np.zeros(len(hashes), bool)
                for shard in np.unique(shards).tolist():
                    if shard in filters:
                        at = np.flatnonzero(shards == shard)
                        keep[at] = filters[shard].contains(hashes[at])
                yield batch.filter(pa.array(keep)).select(["key", "doc_id"])

        asked = (
            postings.withColumn("shard", _shard(index.shards))
            .where(F.col("shard").between(start, start + group - 1))
            .mapInArrow(ask, "key binary, doc_id long")
        )
        passed = asked if passed is None else passed.unionByName(asked)
    return passed


def dropped_keys(index: LineIndex) -> DataFrame:
    """``doc_id, keys``: the keys whose lines each document loses; documents without any are absent."""
    shared = index.counts.where(F.col("docs") >= index.min_docs).select("key", "last_doc")
    lost = (
        _suspects(index, index.postings)
        .join(shared, "key")
        .where(F.col("doc_id") < F.col("last_doc"))
        .select("doc_id", "key")
    )
    # At most the lines of one document meet here.
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row as struct ``row``, with ``kept`` (its text without dropped lines), ``n_lines``, ``n_dropped``.

    A key of :data:`MIN_CHARS` code points or more that ``min_docs`` documents
    hold loses all its lines except in the document of greatest id. Null and
    empty texts are one empty line and stay empty. Rows of one id are one
    document: each loses what the id loses. Rows without id hold no lines for
    the count and lose none. Further columns are kept in ``row``; an empty table
    gives no rows.
    """
    index = build_index(docs, min_docs)
    lost = settle(dropped_keys(index), "line-lost")
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    joined = rows.join(lost, "doc_id", "left").select("row", "text", "keys")
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("kept", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, drops = [], [], []
        for data, keys in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            n_lines = data.count(b"\n") + 1
            dropped = 0
            if keys:
                gone, kept = set(keys), []
                for line in data.split(b"\n"):
                    key = line_key(line)
                    if is_long(key) and key_hash(key) in gone:
                        dropped += 1
                    else:
                        kept.append(line)
                data = b"\n".join(kept)
            texts.append(data)
            counts.append(n_lines)
            drops.append(dropped)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(texts, pa.binary()).cast(pa.string()),
                pa.array(counts, pa.int64()),
                pa.array(drops, pa.int64()),
            ],
            ["row", "kept", "n_lines", "n_dropped"],
        )

    return map_batches(joined, work, schema)


def digests(deduped: DataFrame) -> DataFrame:
    """Counts and a digest of what :func:`dedup_lines` returned."""
    return deduped.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )
