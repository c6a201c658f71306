import random
from itertools import combinations

import numpy as np

from runledger.llm import near_dedup as nd
from runledger.llm.text import WordHashes, folded_words
from tests.llm.conftest import documents, prose


def classes_of(rows, least=0.8):
    """Components by comparing all pairs of texts."""
    memory = WordHashes()
    sets = {d: nd.weighted_set(memory.of(folded_words((t or "").encode())), 5) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sets, 2):
        if len(sets[a][0]) and len(sets[b][0]) and nd.similarity(sets[a], sets[b]) >= least:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


def edited(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for k in range(edits):
        words[rng.randrange(len(words))] = f"new{seed}x{k}"
    return " ".join(words)


def corpus():
    rows, doc_id = [], 0
    for group in range(12):
        base = prose(group, 150)
        rows.append((doc_id, base))
        for k in range(group):
            doc_id += 1
            rows.append((doc_id, base if k % 3 == 0 else edited(base, doc_id, 1 + k % 4)))
        doc_id += 1
    # A chain: each step is near the one before, the ends are not near each other.
    text = prose(99, 200)
    for k in range(8):
        rows.append((1000 + k, text))
        text = edited(text, 500 + k, 3)
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(documents(spark, rows)).collect()}
    assert got == classes_of(rows)


def test_edge_cases(spark, edge_rows):
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(documents(spark, edge_rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}
    assert nd.near_classes(documents(spark, [])).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(3, a), (5, a), (5, b), (9, b)]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(documents(spark, rows)).collect()}
    assert got == {3: 3, 5: 3, 9: 3}


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    a = prose(1, 80)
    docs = documents(spark, [(1, a), (2, a), (None, a), (3, prose(2, 80))])
    kept = nd.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


def test_hub_rounds_leave_nothing_out(spark, monkeypatch):
    monkeypatch.setattr(nd, "HUBS", ())
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(documents(spark, rows)).collect()}
    assert got == classes_of(rows)


def test_sketch_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**63, 400).astype(np.uint64)
    a = np.sort(names[:300]), rng.integers(1, 9, 300).astype(float)
    b = np.sort(names[60:360]), rng.integers(1, 9, 300).astype(float)
    size = 4000
    agree = (nd.dart_sketch(*a, size) == nd.dart_sketch(*b, size)).mean()
    common, x, y = np.intersect1d(a[0], b[0], return_indices=True)
    least = np.minimum(a[1][x], b[1][y]).sum()
    assert abs(agree - least / (a[1].sum() + b[1].sum() - least)) < 0.03


def test_fractional_weights():
    names = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    half, whole = np.full(199, 0.5), np.full(199, 1.0)
    agree = (nd.dart_sketch(names, half, 3000) == nd.dart_sketch(names, whole, 3000)).mean()
    assert abs(agree - 0.5) < 0.04


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in nd.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_doubled_and_single_texts_are_linked(spark):
    rows = []
    for k in range(30):
        text = prose(k, 150)
        rows += [(2 * k, text), (2 * k + 1, f"{text} {text}" if k % 2 else f"{text} " * 3)]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(documents(spark, rows)).collect()}
    assert got == classes_of(rows) == {d: d - d % 2 for d, _ in rows}


def rare_pairs(spark, rows):
    texts = spark.createDataFrame(rows, "node long, text string")
    groups = texts.selectExpr("node", "node AS root").distinct()
    return {(r.a, r.b) for r in nd._rare_pairs(groups, texts, 5, 0.8).collect()}


def test_rare_shingles_find_every_link(spark):
    rows = []
    for k in range(40):
        text = prose(k // 8, 60 + k % 8)
        rows.append((len(rows), edited(text, k, k % 7)))
        rows.append((len(rows), f"{text} {edited(text, k, k % 3)}"))
        rows.append((len(rows), " ".join(text.split()[: 20 + k]) + " same old words again here" * (1 + k % 4)))
    rows += [(len(rows), "three short words"), (len(rows), ""), (len(rows), None)]
    memory = WordHashes()
    sets = {d: nd.weighted_set(memory.of(folded_words((t or "").encode())), 5) for d, t in rows}
    links = {
        (a, b) for a, b in combinations(sets, 2)
        if len(sets[a][0]) and len(sets[b][0]) and nd.similarity(sets[a], sets[b]) >= 0.8
    }
    assert len(links) > 100 and links <= rare_pairs(spark, rows)


def test_a_large_group_below_the_threshold_makes_few_pairs(spark):
    text = prose(3, 300)
    rows = [(k, edited(text, k, 14)) for k in range(300)]
    # About 44,850 pairs share buckets or might.
    assert len(rare_pairs(spark, rows)) < 1000
