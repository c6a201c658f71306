import hashlib
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.llm import secrets
from tests.llm.conftest import documents

KEYS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYS) + ")"
ASSIGN += r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = []
    for number, kind in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(kind.pattern, text):
            s = m[0]
            if any(re.search(a, s) for a in secrets.ALLOWED) or not all(re.search(n, s) for n in kind.needs):
                continue
            w = secrets.WINDOW
            good = []
            for k in range(len(s) - w + 1):
                counts = Counter(s[k : k + w]).values()
                surprise = sum(round(c * math.log2(c) * 1e6) for c in counts)
                if surprise <= round(w * (math.log2(w) - kind.bits) * 1e6):
                    good.append(k)
            if good:
                more.append((m.start() + good[0], number, m.start() + good[-1] + w, kind.kind))
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    n = Counter(x[3] for x in base)
    sha = hashlib.sha256(join(base).encode()).hexdigest()
    return n["assign"], n["access"], n["hex"], sha, join(base + more)


RANDOM = "q7Xv2LmZ9kRt4WbN8sYc3HdJ6pFg"
CASES = [
    'Token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "secret=token: abcdefgh1234", "PASSWORD:abc",
    "api_key='abcdefgh' apikey: \"x.y/z=12345\" aPi_KeY=12345678", "AKIAABCDEFGHIJKL AKIASHORT AKIA" + "A" * 40,
    "\U0001f600é password= hunter2hunter2 \U0001f600 " + "0f" * 20, "paſſword=abcdefgh toKen=abcdefgh",
    RANDOM, f"id {RANDOM}{RANDOM} and EXAMPLE{RANDOM}", "a" * 19 + RANDOM + "a" * 60 + RANDOM,
    "internationalizationverylongwordwithoutdigits", "0123456789" * 5, "deadbeef" * 5, "9f8e7d6c5b4a39281706f5e4d3c2b1a0 9F8E7D6C5B4A39281706F",
    "token=" * 50, "\n".join(f"secret: value{k:08d}" for k in range(300)),
]


def rows_of(spark, rows):
    got = secrets.digests(secrets.scan_secrets(documents(spark, rows))).collect()
    return sorted(map(repr, map(tuple, got)))


def test_against_brute_force(spark, edge_rows):
    rows = list(enumerate(CASES, 100)) + edge_rows
    assert rows_of(spark, rows) == sorted(repr((d, *brute(t))) for d, t in rows)
    assert any("entropy_mixed" in brute(t)[4] for t in CASES) and any("entropy_hex" in brute(t)[4] for t in CASES)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["token", "=", ":", " ", '"', "AKIA", RANDOM, "0a1b2c3d", "x", "é", "KEY", "api_key"]), max_size=12).map("".join), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    assert rows_of(spark, rows) == sorted(repr((d, *brute(t))) for d, t in rows)


def test_allow_list_and_empty_table(spark):
    assert brute("EXAMPLE" + RANDOM)[4] == ""
    assert secrets.scan_secrets(documents(spark, [])).count() == 0
