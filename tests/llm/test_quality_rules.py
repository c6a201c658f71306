import random
import re
from collections import Counter, defaultdict

from runledger.llm import quality_rules as qr
from tests.llm.conftest import documents, prose


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if counts[w] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(repeated), len(lines),
    )


def brute(rows):
    tested, hosts = [], defaultdict(lambda: [0, 0])
    for doc_id, text, host in rows:
        n, chars, symbols, dup, repeat, lines = measured(text)
        base = n < 10 or 100 * repeat > 20 * n
        sign = 100 * symbols > 10 * n or 100 * dup > 30 * lines or chars > 15 * n
        hosts[host][0] += 1
        hosts[host][1] += base or sign
        tested.append((doc_id, host, n, chars, symbols, dup, repeat, base, sign))
    total, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    mean = failed / total
    spread = sum(n * (f / n - mean) ** 2 for n, f in hosts.values())
    rho = (spread / (mean * (1 - mean)) - len(hosts)) / (total - len(hosts))
    weight = 1 / min(0.5, max(1 / 1001, rho)) - 1
    bad = {h: (f + mean * weight) / (n + weight) >= 0.5 for h, (n, f) in hosts.items()}
    return sorted(
        repr((d, n, c, s, u, r, b, g, bad[h], not b and not (bad[h] and g))) for d, h, n, c, s, u, r, b, g in tested
    )


def rows_of(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        host = rng.choice(["good", "good", "bad", None, f"own{k}"])
        kind = rng.random() < (0.75 if host == "bad" else 0.1)
        text = prose(k, rng.randrange(0, 80), 40)
        if kind:
            text = rng.choice([text + " ### $$$" * 9, (text[:60] + "\n") * 9, " ".join(f"{'x' * 20}{j}" for j in range(30)), "a b c d e f " * 6])
        rows.append((k, text, host))
    return rows


def test_against_brute_force(spark, edge_rows):
    rows = rows_of(1) + [(i + 500 if i else i, t, "good") for i, t in edge_rows]
    got = qr.digests(qr.judge(documents(spark, rows))).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows)
    bad = [r for r in got if r["bad_host"]]
    assert bad and any(r["kept"] for r in bad) and any(not r["kept"] and not r["base_failed"] for r in bad)


def test_windows_that_overlap_themselves(spark):
    texts = ["a a a a a a", "a a a a a", "1 2 3 4 5 1 2 3 4 5", "x 1 2 3 4 5 y 1 2 3 4 5 z 1 2 3 4", "a b " * 20, ""]
    got = {r["row"]["text"]: r["n_repeat_words"] for r in qr.measure(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {t: measured(t)[4] for t in texts}


def test_kept_columns_and_missing_source(spark):
    docs = documents(spark, rows_of(2, 30))
    assert qr.keep_good(docs).columns == docs.columns
    assert qr.judge(documents(spark, [])).count() == 0
    bare = docs.drop("source")
    assert qr.judge(bare).count() == 30 and qr.judge(bare).select("host").distinct().count() == 1
