import hashlib
import random
from collections import defaultdict

import numpy as np

from runledger.llm import line_dedup as ld
from tests.llm.conftest import documents

LINES = [f"a line that several texts share, number {k}" for k in range(12)] + ["short one", "", "  ", "Ä" * 20, "Ä" * 19]


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def brute(rows):
    """doc_id -> set of keys it loses, straight from the rule."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= 20:
                holders[key_of(line)].add(doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or doc_id >= gone.get(key_of(x), doc_id)]
        sha = hashlib.sha256("\n".join(stay).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(stay), sha))
    return sorted(map(repr, out))


def random_rows(seed, n, start=0):
    rng = random.Random(seed)
    out = []
    for k in range(start, start + n):
        lines = [rng.choice(LINES) for _ in range(rng.randrange(6))] + [f"only in text {k} and nowhere else"] * 2
        lines = [x.upper() + " \t" if rng.random() < 0.3 else x for x in lines]
        out.append((k, "\n".join(lines)))
    return out


def test_against_brute_force(spark, edge_rows):
    rows = random_rows(3, 60) + [(i + 1000 if i else i, t) for i, t in edge_rows]
    got = ld.digests(ld.dedup_lines(documents(spark, rows))).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows)


def test_empty_table_and_kept_columns(spark):
    assert ld.dedup_lines(documents(spark, [])).count() == 0
    docs = documents(spark, random_rows(1, 5))
    assert ld.dedup_lines(docs).select("row.*").columns == docs.columns


def lost(index):
    return sorted((r["doc_id"], bytes(k)) for r in ld.dropped_keys(index).collect() for k in r["keys"])


def test_insert_and_delete_are_reversible(spark):
    first, more = random_rows(5, 25), random_rows(6, 25, 25)
    docs = lambda rows: documents(spark, rows, extra=False)
    start = ld.build_index(docs(first))
    grown = ld.insert_documents(start, docs(more))
    assert lost(grown) == lost(ld.build_index(docs(first + more)))
    back = ld.delete_documents(grown, docs(more).select("doc_id"))
    assert lost(back) == lost(start)
    again = ld.insert_documents(grown, docs(more[:3]))  # nothing new
    assert lost(again) == lost(grown)
    none = ld.delete_documents(grown, docs(first + more).select("doc_id"))
    assert lost(none) == [] and none.counts.count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    made = ld.CuckooFilter.for_keys(keys)
    assert made.contains(keys).all()
    others = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert made.contains(others).mean() < 0.01
    assert all(made.remove(int(h)) for h in keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.02
    copy = ld.CuckooFilter.from_bytes(made.to_bytes())
    assert copy.insert(int(keys[0])) and copy.contains(keys[:1]).all()


def test_filters_in_several_groups(spark, monkeypatch):
    rows = random_rows(9, 60)
    docs = documents(spark, rows)
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)
    monkeypatch.setattr(ld, "FILTER_BYTES", 64)
    assert sorted(map(repr, map(tuple, ld.digests(ld.dedup_lines(docs)).collect()))) == brute(rows)


def test_repeated_rows_of_one_id_count_once(spark):
    line = "a line of more than twenty characters"
    rows = [(5, line), (5, line), (6, line)]
    docs = documents(spark, rows)
    index = ld.build_index(docs)
    assert [r["docs"] for r in index.counts.collect()] == [2] and index.postings.count() == 2
    assert sorted(repr(tuple(r)) for r in ld.digests(ld.dedup_lines(docs)).collect()) == brute(rows)
