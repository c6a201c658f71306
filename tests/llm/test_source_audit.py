import random
import re
from collections import Counter, defaultdict

import pytest

from runledger.llm import source_audit as audit
from runledger.llm import transducer
from tests.llm.conftest import CLASHING


def expected(docs):
    """All rows by plain loops over whole lists and exact integers."""
    texts = [(lang or "", source or "", text or "") for text, lang, source in docs]
    split = lambda t: [
        re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
    ]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in texts:
        held[lang].update(set(split(text)))
        counts[lang, source].update(split(text))
    out = []
    for lang in {x[0] for x in texts}:
        kept = [t for t, n in held[lang].items() if n >= 3]
        sources = sorted({s for x, s, _ in texts if x == lang})

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        shares = {s: share(counts[lang, s]) for s in sources}
        common = share(sum((counts[lang, s] for s in sources), Counter()))
        value = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = {r: sum(value(shares[s][t], shares[r][t]) for t in kept) for r in sources if r != s}
            terms = {t: value(shares[s][t], common[t]) for t in kept if counts[lang, s][t] and shares[s][t] > common[t]}
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                order = sorted(found, key=lambda x, f=found: (-f[x], x.encode()))[:most]
                out += [(lang, s, part, x, found[x], k + 1) for k, x in enumerate(order)]
    return sorted(out, key=repr)


def table(spark, docs):
    names = [c for c in [*CLASHING, "ordinal", "other", "total", "a.b"] if c != "source"]
    schema = "doc_id long, text string, lang string, source string" + "".join(f", `{c}` string" for c in names)
    return spark.createDataFrame([(1, t, lang, s, *["x"] * len(names)) for t, lang, s in docs], schema)


def some_docs(seed, n, vocabulary=60, sources=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcÄéß", k=1 + rng.randrange(4))) for _ in range(vocabulary)]
    words += ["long" * 60, "long" * 60 + "er", "x" * 128, "x" * 129, "z" * 400]
    docs = []
    for _ in range(n):
        source = rng.choice([None, "", "hot", "hot", "hot", *[f"s{k}" for k in range(sources)]])
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        docs.append((rng.choice([None, "", " 12\n-", text, text.upper()]), rng.choice(["en", "en", "de", None]), source))
    return docs


EDGE = [
    *[("only Here Ünï_x9y", "fr", "a")] * 3, ("other words", "fr", "b"), (None, "fr", None), ("", "it", "a"),
    ("never kept", "it", "b"), ("solo solo", "es", "one"), ("solo", "es", "one"), ("solo", "es", "one"), ("v" * 100_000, "fr", "c"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, rows, seed, monkeypatch):
    # Small blocks, shards and buffers, so that every one of them ends somewhere.
    monkeypatch.setattr(audit, "BLOCK_CELLS", 16)
    monkeypatch.setattr(audit, "SHARD_TERMS", 7)
    docs = some_docs(seed, 150) + EDGE
    assert rows(audit.audit_sources(table(spark, docs).repartition(5))) == expected(docs)


def test_audit_of_one_block_and_of_nothing(spark, rows):
    docs = some_docs(3, 300, 400, 2)
    assert rows(audit.audit_sources(table(spark, docs))) == expected(docs)
    assert audit.audit_sources(table(spark, [])).count() == 0
    assert rows(audit.audit_sources(table(spark, [("a b", "en", "x"), (None, None, None)]))) == []


def test_counts_are_passed_on_in_parts(monkeypatch):
    monkeypatch.setattr(audit, "FLUSH_ENTRIES", 3)
    parts = list(audit._counted([("k", [b"a", b"b"], 1), ("l", [b"a", b"c"], 1), ("k", [b"d"], 1)], dict))
    assert [sum(map(len, p.values())) for p in parts] == [4, 1]


def test_shares_do_not_overflow():
    import numpy as np

    count, total, terms = 10**14, 10**15, 10**8
    got = audit._shares(np.array([[count, 0]]), np.array([total]), terms)[0].tolist()
    assert got == [1 + 10**9 * (c + 1) // (total + terms) for c in (count, 0)]


def test_transducer_ranks_and_is_minimal():
    rng = random.Random(7)
    for _ in range(60):
        keys = sorted({bytes(rng.choices(b"ab\xff", k=rng.randrange(7))) for _ in range(rng.randrange(80))})
        built = transducer.Transducer.from_bytes(transducer.build(keys).to_bytes())
        asked = keys + [bytes(rng.choices(b"ab\xffc", k=rng.randrange(8))) for _ in range(50)]
        assert built.ranks(asked).tolist() == [keys.index(k) if k in keys else -1 for k in asked]
        # As many states as there are different sets of endings.
        starts = {k[:i] for k in keys for i in range(len(k) + 1)} | {b""}
        endings = {frozenset(k[len(s):] for k in keys if k.startswith(s)) for s in starts}
        assert len(built.final) == len(endings)
