import math
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from runledger.llm import decontaminate as dc
from runledger.llm.text import folded_words
from tests.llm.conftest import documents, prose


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def index_of(items, passage_words=dc.PASSAGE_WORDS):
    rows = [(i, t) for i, t in items if folded_words(t.encode())]
    words = {i: folded_words(t.encode()) for i, t in rows}
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    mean = sum(map(len, words.values())) / len(words)
    return dc.BlockMaxIndex(rows, passage_words, df, len(rows), mean)


def test_block_max_search_equals_scoring_everything():
    rng = random.Random(2)
    items = [(k, prose(k, rng.randrange(3, 60), 120)) for k in range(90)]
    index = index_of(items)
    for _ in range(80):
        ids = sorted(rng.sample(range(len(index.ids)), rng.randrange(1, 70)))
        for threshold in (0.15, 0.4, 0.6):
            scores = {}
            for i in ids:
                for number, value in index.lists[i]:
                    scores[number] = scores.get(number, 0.0) + value
            want = {n: s for n, s in scores.items() if s + 1e-9 >= threshold}
            assert dict(index.search(ids, threshold)) == pytest.approx(want)


def scores(items):
    """A function: the greatest share of an item's BM25 score, over its segments, that a set of words gives."""
    words = {i: folded_words(t.encode()) for i, t in items if folded_words(t.encode())}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for own in words.values() for w in set(own))

    def impact(word, segment):
        f = segment.count(word)
        rarity = math.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5))
        return rarity * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(segment) / mean))

    segments = {}
    for i, own in words.items():
        k = -(-len(own) // 64)
        cuts = [j * len(own) // k for j in range(k + 1)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            segment = own[low:high]
            worth = {w: impact(w, segment) for w in set(segment)}
            segments.setdefault(i, []).append({w: v / sum(worth.values()) for w, v in worth.items()})
    return words, lambda i, there: max(sum(v for w, v in s.items() if w in there) for s in segments[i])


def in_text(item, before, text):
    """Question and answer by comparing all places of item and text."""
    width = min(5, len(item))
    spots = {k: [p for p in range(len(text) - width + 1) if text[p : p + width] == item[k : k + width]]
             for k in range(len(item) - width + 1)}
    ends = {k: k + width > before for k in spots}
    if all(ends.values()) or not any(ends.values()):
        ends = {k: k == len(spots) - 1 or before < width for k in spots}
    question = [bool(p) for k, p in spots.items() if not ends[k]]
    answer = [bool(p) for k, p in spots.items() if ends[k]]
    best = sum(answer) / len(answer)
    for k, found in spots.items():
        if any(item[j : j + width] == item[k : k + width] for j in range(k + 1, len(spots))):
            continue
        for p in found:
            there = [item[i] in text[max(0, i + p - k - 3) : max(0, i + p - k + 4)] for i in range(before, len(item))]
            best = max(best, sum(there) / len(there))
    return (sum(question) / len(question) if question else 1.0), best


def brute(docs, items):
    """Every passage against every item, each hit verified for itself."""
    words, score = scores(items)
    out = []
    for doc_id, text in docs:
        own = folded_words((text or "").encode())
        best = {}
        for start in range(0, max(0, -(-len(own) // 64) - 2) * 64 + 1, 64):
            there = set(own[start : start + 128])
            for item_id, item in words.items():
                if (value := score(item_id, there)) < 0.6 - 1e-9:
                    continue
                before = dc.question_and_answer(dict(items)[item_id])[1]
                question, answer = in_text(item, before, own[max(0, start - len(item)) : start + 128 + len(item)])
                if question >= 0.5 and answer >= 0.5:
                    found = round(question + answer, 9), round(value, 9), round(question, 9), round(answer, 9)
                    best[item_id] = max(best.get(item_id, found), found)
        out += [(doc_id, item_id, *hit[2:]) for item_id, hit in best.items()]
    return sorted(map(repr, out))


def corpus():
    rng = random.Random(5)
    items = [(k, ". ".join(prose(100 * k + j, rng.randrange(2, 30), 300) for j in range(3)) + ".") for k in range(40)]
    items += [(90, ""), (91, None), (92, "one"), (93, "... !"), (94, items[3][1]), (95, prose(7, 300, 300))]
    docs = []
    for k in range(60):
        text = prose(1000 + k, rng.randrange(0, 400), 300).split()
        if k % 3 == 0:
            put = (items[k % 40][1] if k % 2 else items[45][1]).split()
            if k % 4 == 1:
                put[len(put) // 2] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = put if k % 9 else put[: len(put) // 3]
        docs.append((k, " ".join(text)))
    return docs, items


def found(spark, docs, items, **kw):
    got = dc.find_leaks(documents(spark, docs), items_of(spark, items), **kw).collect()
    return sorted(repr((r["doc_id"], r["item_id"], round(r["question_overlap"], 9), round(r["answer_overlap"], 9))) for r in got)


def test_against_brute_force(spark, edge_rows):
    docs, items = corpus()
    docs = docs + [(i + 500 if i else i, t) for i, t in edge_rows]
    want = brute(docs, [(i, t) for i, t in items if t])
    assert len(want) > 10 and found(spark, docs, items) == want


def test_parts_of_a_benchmark_give_the_same(spark):
    docs, items = corpus()
    assert found(spark, docs, items, part_bytes=1500) == found(spark, docs, items)


def test_empty_tables(spark):
    docs, items = corpus()
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, docs, [(1, None)]) == []


def names(n, tag):
    return [f"{tag}{k}" for k in range(n)]


def test_a_decoy_does_not_hide_a_copy(spark):
    """An edited copy is found behind other passages that score more."""
    rng = random.Random(11)
    item = names(40, "q") + names(12, "a")
    short = " ".join(item[:40]) + ". " + " ".join(item[40:]) + "."
    long = ". ".join(" ".join(names(30, f"s{j}x")) for j in range(10)) + "."
    items = [(1, short), (2, long)] + [(k, prose(k, 50, 900)) for k in range(10, 20)]
    mixed = item[:]
    rng.shuffle(mixed)
    edited = item[:]
    edited[7], edited[44] = "changed", "altered"
    words = folded_words(long.encode())
    segment = [w.decode() for w in words[:60]]
    copy = [w.decode() if k % 9 else f"new{k}" for k, w in enumerate(words)]
    gap = prose(3, 400, 900).split()
    docs = [
        (1, " ".join(edited)),
        (2, " ".join(mixed + gap + edited)),
        (3, " ".join(segment + gap + copy)),
        (4, " ".join(mixed + gap)),
        (5, " ".join(segment + gap)),
    ]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    # A tenth of the words changed breaks almost half of the runs, and a segment alone is no item.
    assert {eval(r)[:2] for r in want} >= {(1, 1), (2, 1)} and not {eval(r)[0] for r in want} & {4, 5}
    lightly = [w.decode() if k % 20 else f"new{k}" for k, w in enumerate(words)]
    assert [eval(r)[:2] for r in found(spark, [(6, " ".join(segment + gap + lightly))], items)] == [(6, 2)]


def test_short_answers_are_found_in_their_place(spark):
    question = " ".join(names(20, "q"))
    items = [(1, f"{question}? Paris."), (2, prose(1, 40, 900)), (3, prose(2, 40, 900))]
    near, other = question.replace("q19", "changed"), question.replace("q18 q19", "more of q19")
    docs = [
        (1, f"{near} Paris"), (2, f"{other} Paris"), (3, f"{question} Rome"),
        (4, f"Paris {question} then nothing more of that kind here"), (5, f"{question}? It is Paris"),
    ]
    assert found(spark, docs, items) == brute(docs, items)
    assert [eval(r)[0] for r in found(spark, docs, items)] == [1, 2, 5]


def test_long_texts_in_slices(spark, monkeypatch):
    docs, items = corpus()
    joined = [(1, " ".join(t for _, t in docs)), (2, " ".join(["one"] * 3000 + ["two"] * 500))]
    items += [(99, " ".join(["two"] * 300))]
    want = brute(joined, [(i, t) for i, t in items if t])
    searcher = dc.Searcher(index_of([(i, t) for i, t in items if t]), dc.PASSAGE_WORDS, dc.THRESHOLD)
    for cells in (1, 100, dc.CELLS):
        monkeypatch.setattr(dc, "CELLS", cells)
        got = [(i, h[0], round(h[2], 9), round(h[3], 9)) for i, t in joined for h in searcher.hits(folded_words(t.encode()))]
        assert sorted(map(repr, got)) == want


def test_rows_go_by_their_own_text(spark):
    docs, items = corpus()
    leaked = {eval(r)[0] for r in found(spark, docs, items)}
    text, clean = items[0][1], prose(77, 90, 300)
    rows = docs + [(None, text), (None, clean), (600, text), (600, clean), (600, clean), (601, None)]
    table = documents(spark, rows).withColumn("a.b", F.lit(1))
    for size in (dc.PART_BYTES, 1500):
        kept = dc.without_leaks(table, items_of(spark, items), part_bytes=size)
        assert kept.columns == table.columns
        want = [(d, t) for d, t in docs if d not in leaked] + [(None, clean), (600, clean), (600, clean), (601, None)]
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in want)
    same = dc.without_leaks(table, items_of(spark, [(1, None)]))
    assert same.count() == len(rows)
