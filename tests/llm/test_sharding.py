import zlib
from collections import Counter

import numpy as np

from runledger.llm import sharding
from tests.llm.conftest import documents, prose


def test_law_and_gapless_slots(spark):
    rows = [(k, prose(k, 1 + k % 40)) for k in range(1003)]
    docs = documents(spark, rows)
    out = sharding.digests(sharding.shuffle_shards(docs, bucket_bytes=20_000)).collect()
    by_text = dict(rows)
    assert sorted(r["doc_id"] for r in out) == list(range(1003))
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
    for r in out:
        text = by_text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)


def order(spark, docs, seed):
    out = sharding.shuffle_shards(docs, seed=seed).select("row.doc_id", "shard", "slot").collect()
    return [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]


def test_seeded_and_well_mixed(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents(spark, [(k, f"text {k}") for k in range(2000)]).write.parquet(path)
    docs = spark.read.parquet(path)
    one, same, other = order(spark, docs, 1), order(spark, docs, 1), order(spark, docs, 2)
    assert one == same != other
    # Neighbours and places of a random order have no correlation with the ids.
    assert abs(np.corrcoef(np.arange(2000), one)[0, 1]) < 0.1
    assert abs(np.corrcoef(one[:-1], one[1:])[0, 1]) < 0.1


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(4, s)) for s in range(6000))
    assert len(seen) == 24 and max(seen.values()) < 330 and min(seen.values()) > 170
    assert sharding.fisher_yates(0, 1).tolist() == [] and sharding.fisher_yates(1, 1).tolist() == [0]


def test_edge_cases(spark, edge_rows):
    rows = edge_rows + [(77, "the same row")] * 500
    docs = documents(spark, rows)
    out = sharding.shuffle_shards(docs)
    assert out.select("row.*").columns == docs.columns
    got = sorted(map(repr, map(tuple, out.select("row.doc_id", "row.text").collect())))
    assert got == sorted(map(repr, rows))
    assert sharding.shuffle_shards(documents(spark, [])).count() == 0
    few = sharding.shuffle_shards(documents(spark, [(1, "a"), (2, None)])).collect()
    assert all(r["slot"] == 0 for r in few) and len({r["shard"] for r in few}) == 2


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [(k, f"text {k}") for k in range(100)], extra=False)
    sharding.write_shards(sharding.shuffle_shards(docs, shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().orderBy("shard").collect() == [(k, 25) for k in range(4)]
