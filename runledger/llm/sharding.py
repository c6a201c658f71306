"""Random shards by a two-pass external shuffle.

Pass one scatters the rows uniformly, by seeded hashes, into buckets that fit
in memory. Pass two draws a Fisher-Yates permutation of each bucket and writes
the bucket in that order. The buckets one after the other are a random order of
all rows; shards are its consecutive sixteenths, whose counts differ by one at
most (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.text import packed
from runledger.session import settle

#: Bytes of text that a bucket holds on average; a task keeps one bucket in memory.
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of ``n`` rows: from the end, swap each place with one at or before it."""
    rng = np.random.Generator(np.random.PCG64(seed & 0xFFFFFFFFFFFFFFFF))
    picks = rng.integers(0, np.arange(1, n + 1)).tolist()
    order = list(range(n))
    for last in range(n - 1, 0, -1):
        pick = picks[last]
        order[last], order[pick] = order[pick], order[last]
    return np.array(order, np.int64)


def row_bytes() -> F.Column:
    """Size of a row: the bytes of its text and one more."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def shuffle_shards(
    docs: DataFrame, shards: int = 16, seed: int = 0, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... inside the shard).

    The result has one struct column ``row`` with the columns as given, so any
    name may occur in it. Rows are scattered by hashes of the seed, the id, the
    text and the row's place in the input, so equal rows and rows of one id
    spread as well; ``docs`` must therefore be a stored table, whose places are
    the same when a task runs again. Null and empty texts have size 1 and take
    part like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(row_bytes())).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    scatter = F.xxhash64(
        F.lit(seed), F.col("row.doc_id"), F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")), "place"
    )
    scattered = (
        packed(docs)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("scatter", scatter)
        .withColumn("bucket", F.pmod("scatter", F.lit(buckets)).cast("int"))
    )

    def permute(table: pa.Table) -> pa.Table:
        table = table.sort_by([("scatter", "ascending"), ("place", "ascending")])
        bucket = table.column("bucket")[0].as_py()
        order = fisher_yates(table.num_rows, (seed << 32) ^ bucket)
        table = table.take(pa.array(order)).select(["bucket", "row"])
        return table.append_column("pos", pa.array(np.arange(table.num_rows), pa.int64()))

    schema = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            scattered.schema["row"],
            T.StructField("pos", T.LongType()),
        ]
    )
    written = settle(scattered.groupBy("bucket").applyInArrow(permute, schema), "shuffled")
    # One small row per bucket: where it begins in the whole order.
    sizes = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        sizes.select(
            "bucket",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
            F.sum("n").over(Window.partitionBy()).alias("rows"),
        ),
        "bucket-starts",
    )
    # Whole numbers throughout: place * shards stays below 2^63.
    shard = F.expr(f"CAST((start + pos) * {shards} DIV rows AS INT)")
    first = F.expr(f"(shard * rows + {shards - 1}) DIV {shards}")
    return (
        written.join(starts, "bucket")
        .withColumn("shard", shard)
        .withColumn("slot", F.col("start") + F.col("pos") - first)
        .select("row", "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows by slot; each shard may be written by many tasks."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("shard", "slot", "row.*")
        .write.mode("error")
        .partitionBy("shard")
        .parquet(path)
    )


def digests(sharded: DataFrame) -> DataFrame:
    """Sizes and checksums of what :func:`shuffle_shards` returned."""
    text = F.coalesce("row.text", F.lit(""))
    return sharded.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
