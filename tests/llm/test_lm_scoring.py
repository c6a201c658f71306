import math
from collections import Counter

import pytest

from runledger.llm import lm_scoring as lm
from runledger.llm.text import folded_words
from tests.llm.conftest import documents, prose


def close(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (r[0] or -1, r[1], r[2])) for x in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


@pytest.mark.parametrize("broadcast_ids", [lm.BROADCAST_IDS, 0])
def test_against_brute_force(spark, edge_rows, monkeypatch, broadcast_ids):
    monkeypatch.setattr(lm, "BROADCAST_IDS", broadcast_ids)
    rows = [(k, prose(k, 80, 50 if k % 2 else 500)) for k in range(60)] + [(i + 500 if i else i, t) for i, t in edge_rows]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] * 2 + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = lm.score_documents(documents(spark, rows), labels).collect()
    close(got, brute_words(rows, {k for k in range(40) if k % 2}))


def test_target_texts_score_lower(spark):
    rows = [(k, prose(k, 120, 60 if k % 2 else 3000)) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r["difference"] for r in lm.score_documents(documents(spark, rows), labels).collect()}
    assert max(got[k] for k in range(41, 80, 2)) < min(got[k] for k in range(40, 80, 2))


def test_probabilities_add_up(spark):
    """After any word the shares of all words are one: a probe for each word, told apart by its loss."""
    words = [f"w{k}" for k in range(6)]
    corpus = [(100 + k, " ".join(words[(k * j) % 6] for j in range(1, 9))) for k in range(5)]
    shares = []
    for word in words:
        probe = [(1, f"w1 {word}"), (2, "w1")]
        given = corpus + [(d, t) for d, t in probe if d == 1] + [(3, " ".join(words))]
        labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
        got = {r["doc_id"]: r["target_loss"] for r in lm.score_documents(documents(spark, given), labels).collect()}
        alone = {r["doc_id"]: r["target_loss"] for r in lm.score_documents(documents(spark, corpus + [(2, "w1"), (3, " ".join(words))]), labels).collect()}
        shares.append(2 ** -(2 * got[1] - alone[2]))
    assert sum(shares) == pytest.approx(1, abs=1e-9)


def test_a_copy_is_expected_and_a_text_of_its_own_is_not(spark):
    """A row does not vouch for itself."""
    rows = [(k, prose(k, 100, 10**6)) for k in range(40)] + [(100 + k, prose(k, 100, 10**6)) for k in range(5)]
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm.score_documents(documents(spark, rows), labels).collect()}
    twice = [got[k]["background_loss"] for k in (*range(5), *range(100, 105))]
    once = [got[k]["background_loss"] for k in range(5, 40)]
    assert max(twice) < min(once) - 3
    # Without the only target text the target model knows nothing and is uniform.
    distinct = len({w for _, text in rows for w in text.split()})
    assert got[7]["target_loss"] == pytest.approx(math.log2(distinct), abs=1e-9)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert lm.score_documents(documents(spark, []), labels).count() == 0
    got = lm.score_documents(documents(spark, [(1, "a b c")]), labels).collect()
    assert got[0]["n_tokens"] == 3 and got[0]["target_loss"] == pytest.approx(math.log2(3), abs=1e-9)


def brute_words(rows, good):
    """Counts of real words and of pairs of them, less those of the row that is scored."""
    split = [folded_words((text or "").encode()) for _, text in rows]
    inside = [[doc_id in good, True] for doc_id, _ in rows]
    counts = [Counter(), Counter()], [Counter(), Counter()]
    for models, words in zip(inside, split, strict=True):
        for model in (0, 1):
            if models[model]:
                counts[model][0].update(words)
                counts[model][1].update(zip(words, words[1:], strict=False))
    uniform, sums = 1 / max(1, len(counts[1][0])), [sum(one.values()) for one, _ in counts]
    out = []
    for (doc_id, _), models, words in zip(rows, inside, split, strict=True):
        own_words, own_pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
        losses = []
        for model, (one, pair) in enumerate(counts):
            own, total = int(models[model]), 0.0
            for i, w in enumerate(words):
                alone = one[w] - own * own_words[w] + lm.BACKING * uniform
                alone /= sums[model] - own * len(words) + lm.BACKING
                last = words[i - 1]
                context = one[last] - own * own_words[last] if i else 0
                held = pair[last, w] - own * own_pairs[last, w] if i else 0
                total -= math.log2((held + lm.BACKING * alone) / (context + lm.BACKING))
            losses.append(total / len(words) if words else 0.0)
        out.append((doc_id, len(words), *losses, losses[0] - losses[1]))
    return out


def test_exact_counts_of_real_words(spark, edge_rows, monkeypatch):
    """More distinct words than 2^17, in several chunks and buckets, some of them frequent."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 50_000)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 20_000)
    monkeypatch.setattr(lm, "HOT_WORDS", 500)
    rows = [(k, prose(k, 80, 50 if k % 2 else 500)) for k in range(60)]
    rows += [(k, prose(k, 2500, 10**7)) for k in range(100, 180)]
    rows += [(i + 500 if i else i, t) for i, t in edge_rows]
    labels = spark.createDataFrame([(k, k % 2) for k in range(140)] * 2 + [(None, 1)], "doc_id long, quality int")
    got = lm.score_documents(documents(spark, rows), labels).collect()
    close(got, brute_words(rows, {k for k in range(140) if k % 2}))
