"""A table of counts that a stream keeps up to date.

Every trigger adds one small table of changes, summed by key; every few triggers
the changes are folded into a new base. Reading takes the newest base and the
changes after it, so it never goes through the history, and a trigger never
rewrites the table. A batch that is repeated after a failure replaces what it wrote
before, and a base only counts once it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import hadoop_file


class CountTable:
    """Counts by key below ``path``: ``keys`` and ``counts`` name its columns.

    ``schema`` is that of the changes; changes are folded every ``fold_every`` batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], fold_every: int = 16):
        self.spark, self.path, self.schema, self.keys, self.fold_every = spark, path, schema, keys, fold_every

    def _parts(self, kind: str) -> list[int]:
        """Batches of which there is a complete part of this kind, in ascending order."""
        root, files = hadoop_file(self.spark, self.path)
        if not files.exists(root):
            return []
        names = [status.getPath().getName() for status in files.listStatus(root)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [n for n in found if files.exists(hadoop_file(self.spark, f"{self.path}/{kind}={n}/_SUCCESS")[0])]

    def _summed(self, changes: DataFrame) -> DataFrame:
        counts = [c for c in changes.columns if c not in self.keys]
        return changes.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in counts])

    def _up_to(self, batch: int | None) -> DataFrame:
        bases = [b for b in self._parts("base") if batch is None or b < batch]
        base = bases[-1] if bases else -1
        parts = [f"{self.path}/base={base}"] if bases else []
        parts += [
            f"{self.path}/changes={b}" for b in self._parts("changes") if b > base and (batch is None or b <= batch)
        ]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self._summed(self.spark.read.schema(self.schema).parquet(*parts))

    def add(self, changes: DataFrame, batch: int) -> None:
        """Take in the changes of a batch; the ``foreachBatch`` of a stream of changes."""
        self._summed(changes).write.mode("overwrite").parquet(f"{self.path}/changes={batch}")
        if (batch + 1) % self.fold_every == 0:
            self.fold(batch)

    def fold(self, batch: int) -> None:
        """Write a base that holds everything up to ``batch``.

        What the base before the last one replaced is deleted, so that readers that
        have just listed the last parts still find them.
        """
        before = [b for b in self._parts("base") if b < batch]
        self._up_to(batch).write.mode("overwrite").parquet(f"{self.path}/base={batch}")
        if not before:
            return
        old = [f"base={b}" for b in before[:-1]] + [f"changes={b}" for b in self._parts("changes") if b <= before[-1]]
        for name in old:
            file, files = hadoop_file(self.spark, f"{self.path}/{name}")
            files.delete(file, True)

    def read(self) -> DataFrame:
        """The counts after the last complete batch."""
        return self._up_to(None)

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Take in everything that a stream of changes has available."""
        writer = changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.foreachBatch(self.add).start().awaitTermination()
