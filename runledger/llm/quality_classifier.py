"""Compression classifier: which of two dictionaries makes a text smaller.

Two zstandard dictionaries are built, from texts labelled good and from texts
labelled bad. A text is cut into blocks, each block is compressed alone with
either dictionary, and the normalised difference of the summed sizes says which
kind it is closer to. A logistic curve over it and the compressed share, fitted on
labelled texts that no dictionary has seen, gives a calibrated probability.

Fitting uses a bounded sample of labelled rows (:data:`SAMPLE_ROWS`
of each label), weighed by how many rows of its label a sampled row stands for;
every text is scored as a whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import id_and_text, map_batches, texts_of
from runledger.session import settle

#: Labelled rows that are drawn for fitting, at most, of each label.
SAMPLE_ROWS = 2000
#: Bytes of a dictionary, of the pieces it is trained on, and of a block that is compressed alone.
DICTIONARY_BYTES = 64 << 10
PIECE_BYTES = 512
BLOCK_BYTES = 1024
LEVEL = 3

#: Folds: rows of fold 0 are never learned from.
FOLDS = 5


def fold(doc_id: F.Column) -> F.Column:
    """The fold of an id: the CRC of its decimal text, modulo :data:`FOLDS`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def blocks_of(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]


@dataclass
class Fitted:
    """Two dictionaries and the logistic curve over what they say of a text."""

    good: bytes
    bad: bytes
    center: list[float]
    scale: list[float]
    weights: list[float]
    offset: float
    prior: float


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, fitted: Fitted):
        self.fitted = fitted
        self.packers = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(data),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for data in (fitted.good, fitted.bad)
        ]

    def features(self, data: bytes) -> list[float]:
        """The normalised difference of the sizes, and the log of the smaller kind's share of the text.

        A text that repeats itself is small with either dictionary; the share
        tells it from one that is like neither, and enters squared as well.
        """
        good, bad = (sum(len(p.compress(b)) for b in blocks_of(data)) for p in self.packers)
        share = math.log(good / len(data))
        return [(bad - good) / (bad + good), share, share * share]

    def score(self, data: bytes) -> float:
        """Probability of label 1; without any bytes, its share among the labelled."""
        if not data:
            return self.fitted.prior
        f = self.fitted
        z = f.offset
        if f.weights:
            parts = zip(self.features(data), f.center, f.scale, f.weights, strict=True)
            z += sum((x - c) / s * w for x, c, s, w in parts)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _calibrate(fitted: Fitted, x: np.ndarray, y: np.ndarray, standing: np.ndarray) -> None:
    """The logistic curve of greatest likelihood, with a weak prior (Newton).

    ``standing`` is how many labelled rows each row stands for.
    """
    center = np.average(x, axis=0, weights=standing)
    scale = np.sqrt(np.average((x - center) ** 2, axis=0, weights=standing))
    scale[scale == 0] = 1.0
    design = np.column_stack([(x - center) / scale, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (standing * p * (1 - p))[:, None]).T @ design + ridge
        beta = beta + np.linalg.solve(hessian, design.T @ (standing * (y - p)) - ridge @ beta)
    fitted.center, fitted.scale = center.tolist(), scale.tolist()
    fitted.weights, fitted.offset = beta[:-1].tolist(), float(beta[-1])


def _label_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """``doc_id, quality, role`` of the labelled rows to learn from, and how many there are of label 0 and 1.

    At most :data:`SAMPLE_ROWS` of each label are drawn; the counts are of all
    labelled ids that ``docs`` holds. Only ids are shuffled for this, not texts.
    """
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id")) != 0)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    one = settle(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "quality-labelled")
    drawn = [one.where(f"quality = {k}").orderBy(order, "doc_id").limit(SAMPLE_ROWS) for k in (0, 1)]
    counted = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}
    role = F.when(F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(2)) == 0, "words").otherwise("curve")
    sample = drawn[0].unionByName(drawn[1]).select("doc_id", "quality", role.alias("role"))
    return settle(sample, "quality-sample"), [counted.get(0, 0), counted.get(1, 0)]


def _dictionaries(rows: DataFrame) -> list[bytes]:
    """For label 0 and 1 a dictionary of all pieces of the whole texts, in an order by hash."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, marks, pieces = [], [], []
        for label, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            own = [data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
            labels += [label] * len(own)
            marks += [xxhash.xxh3_64_intdigest(p) >> 1 for p in own]
            pieces += own
        return pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array(marks, pa.int64()), pa.array(pieces, pa.binary())],
            ["quality", "mark", "piece"],
        )

    pieces = settle(
        map_batches(
            rows.select(F.col("quality").cast("int"), "text"), cut, "quality int, mark long, piece binary"
        ).distinct(),
        "quality-pieces",
    )
    out = []
    for label in (0, 1):
        # No more than the texts of SAMPLE_ROWS rows.
        own = pieces.where(F.col("quality") == label).select("mark", "piece").toArrow()
        order = own.sort_by([("mark", "ascending"), ("piece", "ascending")])
        out.append(_trained(order.column("piece").to_pylist()))
    return out


def _trained(pieces: list[bytes]) -> bytes:
    """A dictionary trained on pieces; too few to train on are used as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)[:DICTIONARY_BYTES] or b"\n" * 8


def fit(docs: DataFrame, labels: DataFrame) -> Fitted:
    """Dictionaries and curve from a bounded sample of labelled rows outside fold 0.

    One half of the sample builds the dictionaries, the other the curve, both
    from whole texts. Prior and curve hold for the labels' true counts, whatever
    the sample. Ids without a label, labels other than 0 and 1, and labels of ids
    that are not in ``docs`` are left out; an id labelled both counts as 1. With one class
    or none the score is the share of label 1, by Laplace.
    """
    # The sample has a fixed greatest number of rows, so it may be broadcast.
    sample, n = _label_sample(docs, labels)
    rows = settle(id_and_text(docs).join(F.broadcast(sample), "doc_id"), "quality-rows")
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    bad, good = _dictionaries(rows.where("role = 'words'"))
    fitted = Fitted(good, bad, [], [], [], math.log(prior / (1 - prior)), prior)
    scorer_of = _lazy_scorer(fitted)

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        found = [scorer_of().features(t) if t else None for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["quality", "features"]
        )

    curve = rows.where("role = 'curve'").select(F.col("quality").cast("int"), "text")
    measured = map_batches(curve, compare, "quality int, features array<double>")
    points = sorted(tuple(r) for r in measured.where("features IS NOT NULL").collect())
    if len({label for label, _ in points}) == 2:
        standing = np.array([n[y] / min(n[y], SAMPLE_ROWS) for y, _ in points])
        _calibrate(fitted, np.array([x for _, x in points]), np.array([float(y) for y, _ in points]), standing)
    return fitted


def _lazy_scorer(fitted: Fitted):
    """A function that makes the scorer on its first call, in the worker that runs it."""
    holder: list[Scorer] = []

    def scorer() -> Scorer:
        if not holder:
            holder.append(Scorer(fitted))
        return holder[0]

    return scorer


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score``: the probability of quality label 1 of every whole text.

    Nothing but the text enters a score. Null and empty texts get the share of
    label 1 among the labelled. Equal texts get equal scores; null ids, repeated
    rows and further columns have no effect; an empty table gives no rows.
    """
    scorer_of = _lazy_scorer(fit(docs, labels))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [scorer_of().score(data) for data in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(id_and_text(docs), work, "doc_id long, score double")


def decisions(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores with the fold's role and the decision."""
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
