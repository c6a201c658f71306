"""How the sources of a language differ in their words, counted through a transducer vocabulary.

The vocabulary of a language are the terms that enough of its documents hold. Kept
terms get their lexicographic ordinals and are dealt to shards by checksum; each
shard is a minimal acyclic transducer (:mod:`runledger.llm.transducer`) with the
ordinals of its terms. The texts are then read again: tasks count the terms of their
documents by source, send them to the shards in packed rows, and every shard streams
them through its transducer, which drops what is not kept and turns the rest into
counts by ordinal. Nothing but these numbers goes on, and ties are settled by them.

Shares and divergences are integers, computed exactly over blocks of consecutive
ordinals; a block holds so few terms that all sources of its language fit beside
each other. No list of terms or counts is ever in one place: not in the driver, not
in a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import ordered
from runledger.llm import transducer
from runledger.llm.text import small_batches, texts_of
from runledger.session import settle

#: Documents of a language that must hold a term for it to be kept.
MIN_DOCS = 3
#: Greatest rank that the part ``term`` reports.
TOP_TERMS = 200
#: Shares are counted in parts of this many, plus one.
SCALE_STEPS, SCALE_STEP = 3, 1000

#: Average number of terms in a shard, cells (sources times terms) in a block.
SHARD_TERMS = 1 << 14
BLOCK_CELLS = 1 << 17
#: Counted entries, and bytes of text, after which a task passes its counts on.
FLUSH_ENTRIES = 300_000
FLUSH_BYTES = 64 << 20
#: Terms that are looked up at a time.
LOOKUP_TERMS = 50_000
#: Longer keys are cut there and told apart by digest, so a path has a greatest length.
KEY_BYTES = 128

#: Bytes of a text with A-Z lower-cased and every byte that is in no term made a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _grouped(docs: DataFrame) -> DataFrame:
    """``lang, source, text`` without nulls."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*filled)


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, list[bytes], int]]:
    """Language, source, terms and size of every row."""
    for batch in small_batches(batches):
        for lang, source, text in zip(*(texts_of(batch.column(k)) for k in range(3)), strict=True):
            yield lang, source, terms_of(text), len(text)


def _strings(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary()).cast(pa.string())


def _counted(
    rows: Iterable[tuple[Hashable, Iterable[bytes], int]], packed: Callable[[dict], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Terms counted by key, passed on as ``packed`` writes them whenever enough are held."""
    counts: dict[Hashable, Counter] = defaultdict(Counter)
    entries = size = 0
    for key, terms, length in rows:
        own = counts[key]
        before = len(own)
        own.update(terms)
        entries += len(own) - before
        size += length
        if entries > FLUSH_ENTRIES or size > FLUSH_BYTES:
            yield packed(counts)
            counts.clear()
            entries = size = 0
    yield packed(counts)


def count_documents(docs: DataFrame) -> DataFrame:
    """``lang, term, n_docs`` with a row for each task and term; add them up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(counts: dict[bytes, Counter]) -> pa.RecordBatch:
            columns = [
                _strings(lang for lang, own in counts.items() for _ in own),
                _strings(term for own in counts.values() for term in own),
                pa.array([n for own in counts.values() for n in own.values()], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["lang", "term", "n_docs"])

        return _counted(((lang, set(terms), size) for lang, _, terms, size in _batched(batches)), packed)

    return _grouped(docs).mapInArrow(work, "lang string, term string, n_docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, ordinal``: terms in ``min_docs`` rows of a language or more, in order of their bytes."""
    kept = (
        count_documents(docs)
        .groupBy("lang", "term")
        .agg(F.sum("n_docs").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .select("lang", "term")
    )
    return settle(ordered.position_by_range(kept, ["lang"], ["term"], "ordinal"), "audit-terms")


def _prefix(lang: bytes) -> bytes:
    """What stands before the terms of a language; no term holds a zero byte."""
    return lang + b"\0"


def _key(key: bytes) -> bytes:
    if len(key) <= KEY_BYTES:
        return key
    return key[:KEY_BYTES] + b"\1" + hashlib.sha256(key).digest()


def build_shards(kept: DataFrame, n_shards: int) -> DataFrame:
    """``shard, vocabulary, ordinals``: a transducer for each shard, and its terms' ordinals by rank.

    Terms come in the order of their keys, so a task builds one shard after the other
    and holds only the one in hand.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, ordinals = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            order = sorted(range(len(keys)), key=keys.__getitem__)
            own = transducer.build(keys[k] for k in order).to_bytes()
            numbers = np.array(ordinals, np.int64)[order].tobytes()
            columns = [pa.array([at], pa.int64()), pa.array([own], pa.binary()), pa.array([numbers], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "vocabulary", "ordinals"])

        for batch in batches:
            langs, terms = texts_of(batch.column(1)), texts_of(batch.column(2))
            for shard, lang, term, ordinal in zip(
                batch.column(0).to_pylist(), langs, terms, batch.column(3).to_pylist(), strict=True
            ):
                if shard != at:
                    yield from flush()
                    at, keys, ordinals = shard, [], []
                keys.append(_key(_prefix(lang) + term))
                ordinals.append(ordinal)
        yield from flush()

    checksum = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.unhex(F.lit("00")), F.encode("term", "UTF-8")))
    dealt = (
        kept.select((checksum % n_shards).alias("shard"), "lang", "term", "ordinal")
        .repartition("shard")
        .sortWithinPartitions("shard")
    )
    return dealt.mapInArrow(work, "shard long, vocabulary binary, ordinals binary")


def count_terms(docs: DataFrame, n_shards: int) -> DataFrame:
    """``shard, lang, source, terms, counts``: packed counts, some rows for each task, shard and source."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(counts: dict[tuple[bytes, bytes], Counter]) -> pa.RecordBatch:
            rows = []
            for (lang, source), own in counts.items():
                start = zlib.crc32(_prefix(lang))
                dealt: dict[int, list] = defaultdict(list)
                for term in own:
                    dealt[zlib.crc32(term, start) % n_shards].append(term)
                rows += [(shard, lang, source, b" ".join(t), [own[x] for x in t]) for shard, t in dealt.items()]
            shards, langs, sources, terms, numbers = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [
                pa.array(shards, pa.int64()),
                _strings(langs),
                _strings(sources),
                pa.array(terms, pa.binary()),
                pa.array(numbers, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "source", "terms", "counts"])

        return _counted((((lang, source), terms, size) for lang, source, terms, size in _batched(batches)), packed)

    schema = "shard long, lang string, source string, terms binary, counts array<long>"
    return _grouped(docs).mapInArrow(work, schema)


def recount(docs: DataFrame, kept: DataFrame, n_shards: int) -> DataFrame:
    """``lang, source, ordinal, n``: occurrences of kept terms; add up rows of the same key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, numbers = None, None, None
        pending: list[tuple[bytes, bytes, list[bytes], np.ndarray]] = []
        found: dict[tuple[bytes, bytes], list] = defaultdict(list)
        waiting = size = 0

        def look_up() -> None:
            """Ranks of all pending terms at once."""
            nonlocal waiting, size
            if pending and words is not None:
                keys = [_key(before + t) for lang, _, own, _ in pending for before in (_prefix(lang),) for t in own]
                ranks, start = words.ranks(keys), 0
                for lang, source, own, counts in pending:
                    part = ranks[start : start + len(own)]
                    start += len(own)
                    found[lang, source].append((part[part >= 0], counts[part >= 0]))
                    size += int((part >= 0).sum())
            pending.clear()
            waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            groups = []
            for group, parts in found.items():
                own, where = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, where, np.concatenate([c for _, c in parts]))
                groups.append((*group, numbers[own], total))
            found.clear()
            size = 0
            if groups:
                columns = [
                    _strings(lang for lang, _, own, _ in groups for _ in range(len(own))),
                    _strings(source for _, source, own, _ in groups for _ in range(len(own))),
                    pa.array(np.concatenate([own for _, _, own, _ in groups])),
                    pa.array(np.concatenate([total for *_, total in groups])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "ordinal", "n"])

        for batch in small_batches(batches):
            shards, langs, sources = batch.column(0).to_pylist(), texts_of(batch.column(1)), texts_of(batch.column(2))
            for k, shard in enumerate(shards):
                if shard != at:
                    look_up()
                    yield from flush()
                    at, words = shard, None
                vocabulary = batch.column(5)[k].as_py()
                if vocabulary is not None:
                    words = transducer.Transducer.from_bytes(vocabulary)
                    numbers = np.frombuffer(batch.column(6)[k].as_py(), np.int64)
                    continue
                own = batch.column(3)[k].as_py().split(b" ")
                pending.append((langs[k], sources[k], own, batch.column(4)[k].values.to_numpy(zero_copy_only=False)))
                waiting += len(own)
                if waiting > LOOKUP_TERMS:
                    look_up()
                if size > FLUSH_ENTRIES:
                    yield from flush()
        look_up()
        yield from flush()

    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    counted = count_terms(docs, n_shards).select(
        "*", empty("vocabulary", "binary"), empty("ordinals", "binary")
    )
    shards = build_shards(kept, n_shards).select(
        "shard", empty("lang", "string"), empty("source", "string"), empty("terms", "binary"),
        empty("counts", "array<long>"), "vocabulary", "ordinals",
    )
    # A shard's vocabulary comes before its terms; both stream through one task.
    streamed = (
        shards.unionByName(counted)
        .repartition("shard")
        .sortWithinPartitions("shard", F.col("vocabulary").isNull())
    )
    return streamed.mapInArrow(work, "lang string, source string, ordinal long, n long")


def _shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)), by long division so that nothing overflows."""
    below = np.maximum(totals + terms, 1)[:, None]
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // below
        rest = rest % below
    return out + 1


def _compare(key: tuple, counted: pa.Table, sources: pa.Table) -> pa.Table:
    """What one block of terms adds to the pairs of its language, and its best terms by source."""
    names = sources["source"].to_pylist()
    terms, width = sources["n_terms"][0].as_py(), sources["width"][0].as_py()
    first = key[1].as_py() * width
    counts = np.zeros((len(names), max(0, min(width, terms - first))), np.int64)
    place = {name: k for k, name in enumerate(names)}
    rows = np.fromiter((place[s] for s in counted["source"].to_pylist()), np.int64, counted.num_rows)
    np.add.at(counts, (rows, counted["ordinal"].to_numpy() - first), counted["n"].to_numpy())
    shares = _shares(counts, sources["total"].to_numpy(), terms)
    common = _shares(counts.sum(0, keepdims=True), sources["lang_total"].to_numpy()[:1], terms)[0]
    by, items, ordinals, values = [], [], [], []
    for k, name in enumerate(names):
        gap = shares[k] - shares
        sums = (gap * gap // shares).sum(1).tolist()
        others = [j for j in range(len(names)) if j != k]
        by += [name] * len(others)
        items += [names[j] for j in others]
        ordinals += [None] * len(others)
        values += [sums[j] for j in others]
        over = np.flatnonzero((counts[k] > 0) & (shares[k] > common))
        gap = shares[k, over] - common[over]
        value = gap * gap // common[over]
        best = np.lexsort((over, -value))[:TOP_TERMS]
        by += [name] * len(best)
        items += [None] * len(best)
        ordinals += (over[best] + first).tolist()
        values += value[best].tolist()
    lang = [key[0].as_py()] * len(by)
    return pa.table(
        {
            "lang": pa.array(lang, pa.string()),
            "source": pa.array(by, pa.string()),
            "other": pa.array(items, pa.string()),
            "ordinal": pa.array(ordinals, pa.int64()),
            "value": pa.array(values, pa.int64()),
        }
    )


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs, from others and from its language.

    With the share p = 1 + floor(10^9 (count + 1) / (N + V)) of a term in a source, N being
    all its occurrences of kept terms and V their number, part ``pair`` has for each
    other source of the language (its share is q) the sum of floor((p - q)^2 / q) over
    the kept terms, and part ``term`` has that value of the :data:`TOP_TERMS` terms
    which the source holds more often than its language (with share q). Ranks start at
    1 for each source and part, greatest value first, ties by bytes of the item.

    Null texts, languages and sources are empty ones. A row is a document, so a
    repeated row counts again; ids and further columns are not read. A source without
    terms, and a language without kept ones, have their pairs all the same (with value
    0 where nothing is kept). An empty table gives no rows.
    """
    by_group = ["lang", "source"]
    kept = kept_terms(docs, min_docs)
    n_shards = max(1, -(-kept.count() // SHARD_TERMS))
    counts = settle(recount(docs, kept, n_shards), "audit-counts")

    totals = counts.groupBy(*by_group).agg(F.sum("n").alias("total"))
    groups = _grouped(docs).select(*by_group).distinct().join(totals, by_group, "left").fillna(0, ["total"])
    groups = settle(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.count("*").alias("n_sources")
    ).join(kept.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang", "left").fillna(0, ["n_terms"])
    width = F.greatest(F.lit(1).cast("long"), F.expr(f"{BLOCK_CELLS} div n_sources"))
    langs = settle(langs.withColumn("width", width), "audit-languages")

    last = F.greatest(F.lit(0).cast("long"), F.expr("(n_terms - 1) div width"))
    blocks = groups.join(langs, "lang").select(
        *by_group, "total", "lang_total", "n_terms", "width", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")
    )
    placed = counts.join(langs.select("lang", "width"), "lang").select(
        *by_group, "ordinal", "n", F.expr("ordinal div width").alias("block")
    )
    parts = settle(
        placed.groupBy("lang", "block")
        .cogroup(blocks.groupBy("lang", "block"))
        .applyInArrow(_compare, "lang string, source string, other string, ordinal long, value long"),
        "audit-parts",
    )

    ranked = lambda *order: F.row_number().over(Window.partitionBy(*by_group).orderBy(F.desc("value"), *order))
    pairs = parts.where(F.col("ordinal").isNull()).groupBy(*by_group, F.col("other").alias("item")).agg(
        F.sum("value").alias("value")
    )
    best = parts.where(F.col("ordinal").isNotNull()).withColumn("rank", ranked("ordinal")).where(F.col("rank") <= TOP_TERMS)
    named = best.join(kept.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
    return (
        pairs.select(*by_group, F.lit("pair").alias("part"), "item", "value", ranked("item").alias("rank"))
        .unionByName(named.select(*by_group, F.lit("term").alias("part"), "item", "value", "rank"))
    )
