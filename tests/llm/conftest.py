import random

import pytest

#: Names that operators use inside; a table may have them as further columns.
CLASHING = [
    "row", "key", "keys", "node", "bucket", "place", "scatter", "pos", "shard", "slot", "host", "c", "d",
    "kept", "n_lines", "n_words", "score", "class_id", "copy", "target", "cell", "spans", "word", "item_id",
]


def documents(spark, rows, extra=True):
    """A table of documents from (doc_id, text[, source]) with columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        full = [(*r, *["x"] * len(CLASHING)) for r in full]
        schema += "".join(f", `{name}` string" for name in CLASHING)
    return spark.createDataFrame(full, schema)


def prose(seed, words, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture
def edge_rows():
    """Nulls, empty, blank and very long texts, repeated rows, and ties."""
    long = prose(1, 60_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "no id at all but some words here"), (4, long), (5, long),
        (6, "short"), (6, "short"), (7, "ünï \U0001f600 " * 30), (8, "\n" * 2000), (None, None), (9, "a" * 50_000),
    ]
