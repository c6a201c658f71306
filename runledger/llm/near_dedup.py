"""Near-duplicate detection with DartMinHash.

A text is a weighted set: its runs of five words, weighted by how often they
occur. Element ``i`` of weight ``x`` owns the region of darts with a height of
at most ``x``; darts fall on (height, rank) evenly by hashes of the element
alone, so equal elements get equal darts in every text. Heights are cut into
slabs that double in width, and ranks are thrown only up to a bound at which a
text gets about ``t ln t + 2 t`` darts for its ``t`` coordinates. A coordinate
keeps its earliest dart. Two texts agree in a coordinate with a probability
equal to their weighted Jaccard similarity, and a sketch costs little more than
reading the set once. A text that repeats shingles has a second sketch, of the
same set with weights of 1, for the similarity without weights; both are the same
for other texts, so one key space of bands serves both.

Sketches are joined by bands. In a round each text is compared with one hub, the
foremost in the buckets it shares with other groups: the text that shares most
buckets at first, any other later. What is then still apart meets by its rarest
shingles: two linked texts have one of them among the few that either may lack. So
every pair of texts that share a bucket is linked, directly or through others, or
known to be no link, and a large group of texts that are near but no links, each with
shingles of its own, is not compared in pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.text import WordHashes, folded_words, map_batches, mix, shingle_hashes, texts_of
from runledger.session import settle

#: Words of a shingle and the similarity of a link.
WIDTH = 5
SIMILARITY = 0.8
#: At a similarity of 0.8, with or without weights, a pair shares a bucket of one of the bands
#: with probability 0.9999.
BANDS = 32
ROWS = 6
#: Seeds of further rounds with a hub for each text, before the rest meets by rare shingles.
HUBS = (1, 2)

_U = np.uint64
_TO_UNIT = 2.0**-53


def _unit(values: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((values >> _U(11)).astype(np.float64) + 1.0) * _TO_UNIT


def throw_darts(elements: np.ndarray, weights: np.ndarray, bound: float):
    """Darts of a weighted set with a rank of at most ``bound``: their ranks and 64-bit names.

    In a slab of width ``w`` ranks follow a Poisson process of rate ``w``. Each
    dart has a height in its slab and counts only if it lies in the element's
    region.
    """
    ranks, names = [], []
    low, high, level = 0.0, 1.0, 0
    while True:
        inside = weights > low
        if not inside.any():
            break
        base, weight, width = elements[inside], weights[inside], high - low
        base = mix(base + _U((0xA24BAED4963EE407 * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
        reached = np.zeros(len(base))
        columns, number = max(1, int(bound * width) + 1), 0
        while len(base):
            step = np.arange(number + 1, number + columns + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
            name = mix(base[:, None] + step[None, :])
            rank = reached[:, None] + np.cumsum(-np.log(_unit(name)), axis=1) / width
            hit = rank <= bound
            if high > 1.0 or weight.min() < high:
                height = low + width * _unit(mix(name ^ _U(0xD6E8FEB86659FD93)))
                hit &= height <= weight[:, None]
            ranks.append(rank[hit])
            names.append(name[hit])
            more = rank[:, -1] <= bound
            base, weight, reached = base[more], weight[more], rank[more, -1]
            number += columns
        low, high, level = high, high * 2, level + 1
    return np.concatenate(ranks), np.concatenate(names)


def dart_sketch(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates, each the name of its earliest dart; empty for an empty set."""
    if not len(elements):
        return np.zeros(0, _U)
    bound = (size * math.log(size) + 2 * size) / float(weights.sum())
    while True:
        ranks, names = throw_darts(elements, weights, bound)
        order = np.argsort(ranks, kind="stable")
        names = names[order]
        coordinates, first = np.unique(mix(names) % _U(size), return_index=True)
        if len(coordinates) == size:
            return names[first]
        bound *= 2


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates."""
    if not len(sketch):
        return np.zeros(0, np.int64)
    parts = sketch.reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=_U)
    for k in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, k])
    return keys.view(np.int64)


def weighted_set(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text and how often each occurs."""
    elements, counts = np.unique(shingle_hashes(hashes, width), return_counts=True)
    return elements, counts.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of the Jaccard similarities of two sets, with and without their weights."""
    common, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(a[0]) + len(b[0]) - len(common)
    least = np.minimum(a[1][at], b[1][bt]).sum()
    whole = a[1].sum() + b[1].sum() - least
    return max(len(common) / plain if plain else 0.0, float(least / whole) if whole else 0.0)


def link_keys(elements: np.ndarray, weights: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of a set with its weights, and of the same set without."""
    keys = band_keys(dart_sketch(elements, weights, bands * rows), bands, rows)
    if (weights == 1.0).all():
        return keys
    plain = dart_sketch(elements, np.ones(len(elements)), bands * rows)
    return np.unique(np.concatenate([keys, band_keys(plain, bands, rows)]))


def sketch_documents(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, copy, distinct, total, keys``.

    128 bits that stand for the words of a text, how many distinct shingles it
    has and how many at all, and its band keys.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        copies, keys, sizes = [], [], []
        for data in texts_of(batch.column(1)):
            words = folded_words(data)
            copies.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            elements, weights = weighted_set(memory.of(words), width)
            sizes.append((len(elements), int(weights.sum())))
            keys.append(link_keys(elements, weights, bands, rows))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
        distinct, total = (pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(copies, pa.binary()), distinct, total, lists],
            ["doc_id", "copy", "distinct", "total", "keys"],
        )

    memory = WordHashes()
    schema = "doc_id long, copy binary, distinct long, total long, keys array<long>"
    return map_batches(docs.select("doc_id", "text"), work, schema)


def _near_in_size(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Those ``a, b`` that may be links by their sizes: a similarity is at most the ratio of the sizes."""

    def sized(side: str) -> DataFrame:
        return sizes.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in sizes.columns])

    def near(name: str) -> Column:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.least(a, b) >= least * F.greatest(a, b)

    both = pairs.join(sized("a"), "a").join(sized("b"), "b")
    return both.where(near("distinct") | near("total")).select("a", "b").distinct()


def _with_hubs(rows: DataFrame, rank: Column) -> DataFrame:
    """``a, b``: each node with the highest-ranking hub of its buckets (key, node, root) that is of another root."""
    hubs = rows.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "node", "root")).alias("hub"))
    best = rows.join(hubs, "key").where("root <> hub.root").groupBy("node").agg(F.max("hub").alias("hub"))
    return best.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """``node, root, part, distinct, total, token, first``: the shingles of texts with node and root.

    The n-th occurrence of a shingle is a token of its own, so that texts are sets of
    tokens, ``first`` ones when weights do not count. ``part`` tells texts of a node apart.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, parts, sizes, tokens, firsts = [], [], [], [], []
        for row, data in enumerate(texts_of(batch.column(2))):
            elements, weights = weighted_set(memory.of(folded_words(data)), width)
            counts = weights.astype(np.int64)
            starts = np.repeat(np.cumsum(counts) - counts, counts)
            number = (np.arange(len(starts)) - starts).astype(_U)
            tokens.append(mix(np.repeat(elements, counts) + number * _U(0x9E3779B97F4A7C15)).view(np.int64))
            firsts.append(number == 0)
            parts.append(xxhash.xxh3_64_intdigest(data) >> 1)
            sizes.append((len(elements), len(starts)))
            at.append(np.full(len(starts), row, np.int64))
        rows = np.concatenate(at)
        ids = batch.select([0, 1]).take(pa.array(rows))
        more = [np.array(parts, np.int64), *np.array(sizes, np.int64).T]
        return pa.RecordBatch.from_arrays(
            [*ids.columns, *[pa.array(m[rows]) for m in more], pa.array(np.concatenate(tokens)), pa.array(np.concatenate(firsts))],
            ["node", "root", "part", "distinct", "total", "token", "first"],
        )

    memory = WordHashes()
    schema = "node long, root long, part long, distinct long, total long, token long, first boolean"
    return map_batches(texts.select("node", "root", "text"), work, schema)


def _rare_pairs(groups: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """``a, b`` of different roots: every link among ``groups`` (node, root), and few others.

    Tokens have one order, rarest first. Linked texts of ``n`` and ``m`` tokens share at
    least ``least / (1 + least) * (n + m)``, so the first one they share has as many at or
    behind its place in either text. Tokens of one text alone take places but meet nothing.
    """
    rows = settle(_shingle_rows(groups.join(texts, "node").distinct(), width), "near-tokens")
    seen = rows.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    text = Window.partitionBy("node", "part")
    rarest = text.orderBy("times", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("first").cast("int")
    # How many tokens of the text are at this place or behind it, without and with weights.
    behind = lambda n, whole, upto: (F.sum(n).over(whole) - F.sum(n).over(upto) + n).alias
    placed = rows.join(seen, "token").select(
        "node", "root", "distinct", "total", "token", "first",
        behind(first, text, rarest)("distinct_left"), behind(F.lit(1), text, rarest)("total_left"),
    )
    slack = 1e-6
    early = lambda n: F.col(f"{n}_left") >= least * F.col(n) - slack
    placed = settle(placed.where((F.col("first") & early("distinct")) | early("total")), "near-rarest")

    def side(name: str) -> DataFrame:
        return placed.select("token", *[F.col(c).alias(f"{c}_{name}") for c in placed.columns if c != "token"])

    def enough(n: str) -> Column:
        needed = least / (1 + least) * (F.col(f"{n}_a") + F.col(f"{n}_b")) - slack
        return F.least(f"{n}_left_a", f"{n}_left_b") >= needed

    met = side("a").join(side("b"), "token").where(
        F.expr("node_a < node_b AND root_a <> root_b")
        & ((F.col("first_a") & F.col("first_b") & enough("distinct")) | enough("total"))
    )
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _verify(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those ``a, b`` whose texts are as similar as asked."""
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, hub = [], None, None
        for text_a, text_b in zip(texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
            if text_a != last:
                last, hub = text_a, weighted_set(memory.of(folded_words(text_a)), width)
            other = weighted_set(memory.of(folded_words(text_b)), width)
            keep.append(similarity(hub, other) >= least)
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    memory = WordHashes()
    return map_batches(both.select("a", "b", "text_a", "text_b"), work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component of each node that has an edge.

    Every node takes the smallest root among its neighbours, then the root of
    its root, until nothing changes. Each round is written to the shared folder.
    """
    both = settle(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "near-edges"
    )
    roots = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("root")
        ),
        "near-roots",
    )
    while True:
        seen = roots.select(F.col("node").alias("b"), F.col("root").alias("near"))
        nearest = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = roots.join(nearest, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = settle(
            step.join(jump, "root", "left").select(
                "node", "old", F.least("root", F.coalesce("far", "root")).alias("root")
            ),
            "near-roots",
        )
        changed = not new.where("old <> root").isEmpty()
        roots = new.select("node", "root")
        if not changed:
            return roots


def near_links(docs: DataFrame, sketches: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` between documents of different texts that span every group of near duplicates.

    Documents with the same words are stood for by the one of smallest id.
    """
    nodes = sketches.where(F.col("copy").isNotNull()).groupBy("copy").agg(F.min("doc_id").alias("node"))
    chosen = nodes.where(F.col("node").isNotNull()).select("copy", F.col("node").alias("doc_id"))
    rows = (
        sketches.join(chosen, ["copy", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
        .distinct()
    )
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = settle(rows.join(shared, "key"), "near-buckets")  # key, node, n
    # An id with several texts has several sizes, and so several rows here.
    sizes = settle(
        sketches.select(F.col("doc_id").alias("node"), "distinct", "total").join(
            rows.select("node").distinct(), "node", "left_semi"
        ).distinct(),
        "near-sizes",
    )
    texts = settle(
        docs.select(F.col("doc_id").alias("node"), "text").join(
            rows.select("node").distinct(), "node", "left_semi"
        ),
        "near-texts",
    )
    met = rows.groupBy("node").agg(F.sum("n").alias("met"))
    rows = settle(rows.join(met, "node").select("key", "node", "met"), "near-buckets")
    links = tried = docs.sparkSession.createDataFrame([], "a long, b long")

    def compare(pairs: DataFrame) -> None:
        nonlocal links, tried
        pairs = _near_in_size(pairs, sizes, least).join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, "near-pairs")
        links = settle(links.union(_verify(pairs, texts, width, least)), "near-links")
        tried = tried.union(pairs)

    compare(_with_hubs(rows.withColumn("root", F.col("node")), F.col("met")))
    rows = rows.select("key", "node")
    for seed in (*HUBS, None):
        roots = components(links)
        labelled = rows.join(roots, "node", "left").select(
            "key", "node", F.coalesce("root", "node").alias("root")
        )
        # Buckets that lie in one group are done.
        spread = labelled.groupBy("key").agg(
            F.min("root").alias("r0"), F.max("root").alias("r1")
        )
        open_rows = settle(
            labelled.join(spread.where("r0 < r1").select("key"), "key"), "near-buckets"
        )
        if open_rows.isEmpty():
            break
        if seed:
            # Texts rank alike in all buckets, so that few of them are hubs.
            compare(_with_hubs(open_rows, F.xxhash64("node", F.lit(seed))))
        else:
            compare(_rare_pairs(open_rows.select("node", "root").distinct(), texts, width, least))
        rows = open_rows.select("key", "node")
    return links


def near_classes(
    docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, class_id, copy_of``: one row per id; a class is named by its smallest id.

    Documents of one class are joined by a chain of links of similarity
    ``least`` or more; ``copy_of`` is the smallest id with the same words. A text
    without words (null or empty) is similar to none, and is its own class. A
    shorter text than ``width`` words is one shingle. Rows of one id are one
    document and meet in one class; rows without id are left out, as they cannot
    be named. Further columns are not read; an empty table gives no rows.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sketches = settle(sketch_documents(known, width, bands, rows), "near-sketches")
    links = near_links(known, sketches, width, least)
    copies = sketches.groupBy("copy").agg(F.min("doc_id").alias("node"))
    member = (
        sketches.select("doc_id", "copy")
        .join(copies.where("copy IS NOT NULL"), "copy", "left")
        .select("doc_id", F.coalesce("node", "doc_id").alias("node"))
    )
    # An id with several texts ties their groups together.
    several = member.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    ties = member.join(several.where("low < high"), "doc_id").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")
    )
    roots = components(links.union(ties))
    named = member.join(roots, "node", "left").select(
        "doc_id", F.coalesce("root", "node").alias("class_id"), F.col("node").alias("copy_of")
    )
    return named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("copy_of").alias("copy_of"))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names its class, and those without id; columns as given."""
    classes = near_classes(docs)
    gone = settle(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")), "near-gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
