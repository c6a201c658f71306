import random

from runledger.llm import licenses
from runledger.llm.text import folded_words
from tests.llm.conftest import documents

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    words = []
    current = ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            words += [current] if current else []
            current = ""
        else:
            current += c
    found = [
        (k, label)
        for phrase, label in PHRASES.items()
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    places = [k for k, _ in found]
    return (
        len(words), len(found), min(places, default=None), max(places, default=None),
        ",".join(sorted({label for _, label in found})),
    )


def test_matching_statistics_against_brute_force():
    scanner, rng = licenses.scanner(), random.Random(4)
    sequences = scanner.automaton.sequences
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    vocabulary = sorted(scanner.vocabulary)
    for _ in range(60):
        words = []
        while len(words) < 40:
            s = rng.choice(sequences)
            k = rng.randrange(len(s))
            words += s[k : k + rng.randrange(1, 9)] if rng.random() < 0.7 else [rng.choice(vocabulary)]
        for place, size, state in scanner.automaton.walk(words, 0, len(words)):
            longest = max((n for n in range(1, place + 2) if tuple(words[place - n + 1 : place + 1]) in runs), default=0)
            assert size == longest
            ends = {
                (number, stop) for number, s in enumerate(sequences) for stop in range(size - 1, len(s))
                if size and s[stop - size + 1 : stop + 1] == words[place - size + 1 : place + 1]
            }
            assert scanner.automaton.ends[state] == ends


def test_base_against_brute_force(spark, edge_rows):
    rng = random.Random(8)
    parts = ["GNU General-Public", "License", "the Apache License,", "CC", "BY", "MIT", "license", "é", " ", "x9", "\n", "gnu"]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(30))) for k in range(200)] + edge_rows
    got = licenses.scan_licences(documents(spark, rows))
    kept = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(repr((d, *base(t))) for d, t in rows)
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_templates_are_found_through_edits(spark):
    label, text = next(t for t in licenses.TEMPLATES if t[0] == "mit-grant")
    words = text.split()
    words[8] = "changed"
    rows = [(1, "code " * 20 + " ".join(words) + " code" * 20), (2, "free of charge to any"), (3, f"{text} {text}")]
    got = {r["doc_id"]: r for r in licenses.scan_licences(documents(spark, rows)).collect()}
    span = max(got[1]["spans"], key=lambda s: s["coverage"])
    n = len(folded_words(text.encode()))
    assert (span["label"], span["first"], span["last"]) == (label, 20, 20 + n - 1)
    assert span["coverage"] == (n - 1) / n and label in got[1]["labels"]
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.5
    assert sum(s["label"] == label and s["coverage"] == 1 for s in got[3]["spans"]) == 2
    assert licenses.scan_licences(documents(spark, [])).count() == 0
