import hashlib
import random
import zlib

import numpy as np
import pytest

from runledger.llm import periodic_runs as pr
from tests.llm.conftest import documents, prose


def brute(words):
    """All runs by their definition: every lag, every stretch, smallest periods by trying all."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                held = words[i : i + length]
                if not any(held[d:] == held[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words):
    gone = {i for s, n, q in brute(words) for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_their_definition(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = [b"%d" % rng.randrange(1 + rng.randrange(4)) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            block = [b"%d" % rng.randrange(3) for _ in range(1 + rng.randrange(9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = block * rng.randrange(1, 7) + block[: rng.randrange(len(block))]
        assert pr.runs_of(words) == brute(words)
        assert pr.collapse(words, pr.runs_of(words)) == brute_kept(words)


def test_hash_collisions_change_nothing(monkeypatch):
    monkeypatch.setattr(pr, "_agree", lambda h, p, at, lag, width: np.ones(len(at), bool))
    test_runs_equal_their_definition(17)


def test_long_texts_of_one_word_and_nested_periods():
    assert pr.runs_of([b"a"] * 400_000) == [(0, 400_000, 1)]
    inner = [b"a", b"b"] * 4 + [b"c"]
    assert pr.runs_of(inner * 5_000) == sorted(
        [(k * 9, 8, 2) for k in range(5_000)] + [(0, 45_000, 9)], key=lambda r: (r[0], r[2])
    )
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 3_000:
        fib = fib[1], fib[1] + fib[0]
    assert pr.runs_of(fib[1][:3_000]) == brute(fib[1][:3_000])


def test_rare_words_split_until_nothing_does():
    numbers = pr.word_numbers(b"x a b a b a b a b y a b a b a b a b z a b".split())
    assert sorted(pr.segments(numbers)) == [(1, 9), (10, 18)]
    assert pr.segments(pr.word_numbers(b"a b c d e f g h".split())) == []


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *longest, digest(told), digest(b" ".join(brute_kept(words)).decode()))


def test_query_on_edge_rows(spark, rows):
    texts = [
        None, "", " \n\t ", "one", "go " * 6, "go " * 5, "a b " * 4, "x " + "ä \U0001f600 c\n" * 9 + "y",
        prose(2, 700, 40), "\x0b".join("ab" * 20), "no break " * 7, prose(3, 1500),
    ]
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:8] + [1, 1, 2, 3]
    cases = [(i, t) for i in ids for t in texts]
    table = documents(spark, [*cases, (None, "go " * 6)])
    got = pr.digests(pr.find_runs(pr.plant_periods(table)))
    none = (None, 1, 0, 6, 1, 6000, digest("0,6,1\n"), digest("go"))
    assert rows(got) == sorted([*[expected(*c) for c in cases], none], key=repr)
    empty = pr.digests(pr.find_runs(pr.plant_periods(documents(spark, []))))
    assert empty.count() == 0


def test_very_long_texts(spark):
    long = " ".join(["w%d" % (k % 7) for k in range(300_000)])
    table = documents(spark, [(1, long), (2, prose(4, 200_000, 300)), (3, "x" * 2_000_000)])
    got = {r.doc_id: r for r in pr.find_runs(table).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 7)] and got[1].kept == "w0 w1 w2 w3 w4 w5 w6"
    assert got[3].runs == [] and len(got[3].kept) == 2_000_000
