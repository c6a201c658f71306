import hashlib
import random

from pyspark.sql import functions as F

from runledger.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    """Turns with further columns whose names the operator uses itself."""
    clashing = ["n", "stop", "head", "reply", "whole", "t", "turns", "targets", "a.b"]
    schema = SCHEMA + "".join(f", `{c}` string" for c in clashing)
    return spark.createDataFrame([(*r, *["x"] * len(clashing)) for r in rows], schema)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """conv_id, n_turns, turns, loss chars and text, examples, by plain loops."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        n = sum(r == "assistant" for *_, r, _ in turns) + (turns[-1][2] != "assistant")
        told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        out.append((conv, len(turns), sha(told), len(loss), sha(loss), n))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples"]

EDGE = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (2, 0, "system", "only a system turn"), (3, 0, "user", None), (3, 1, "assistant", None), (3, 2, "user", "after"),
    (4, 1, "assistant", "same turn"), (4, 1, "assistant", "same turn"), (4, 1, "assistant", "another"), (4, 1, None, ""),
    (None, 0, "user", "no id"), (None, None, "assistant", "no turn either"), (5, 7, "assistant", "ä \U0001f600 " * 9),
    (6, 0, "[/INST]<s>", "<<s>s> <\\\\/s> [\\INST] [INST[/INST]] </s"), (6, 1, "assistant", "<\\s>\n[[INST]\\"),
]


def test_each_reply_is_an_example_of_its_own(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (1, 3, "assistant", "no")]
    got = chat.expand_examples(table(spark, rows)).orderBy("example_no").collect()
    first = "<s>[INST]user[/INST]hi</s><s>[INST]assistant[/INST]yes</s>"
    second = first + "<s>[INST]user[/INST]so</s><s>[INST]assistant[/INST]no</s>"
    assert [r.text for r in got] == [first, second]
    assert [r.text[r.target_start:r.target_start + r.target_length] for r in got] == ["yes", "no"]
    assert [(r.n_turns, r.complete) for r in got] == [(2, False), (4, True)]


def test_output_is_read_back(spark, rows):
    got = chat.digests(chat.expand_examples(table(spark, EDGE)))
    assert rows(got, *COLUMNS) == expected(EDGE)
    assert chat.digests(chat.expand_examples(table(spark, []))).count() == 0


def test_long_conversations(spark, rows):
    rng = random.Random(3)
    turns = [(9, k, rng.choice(["user", "assistant"]), "word </s> " * rng.randrange(9)) for k in range(600)]
    turns += [(8, 0, "user", "long [INST] " * 200_000), (8, 1, "assistant", "[" * 300_000)]
    rng.shuffle(turns)
    got = chat.digests(chat.expand_examples(table(spark, turns)))
    assert rows(got, *COLUMNS) == expected(turns)


def test_escaping_is_reversible(spark):
    rng = random.Random(5)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "x", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    escaped = df.select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("b"))
    for r in escaped.collect():
        assert r.b == r.t
        assert not any(mark in r.e for mark in (chat.OPEN, chat.HEAD, chat.TAIL, chat.CLOSE))
    assert len({r.e for r in escaped.collect()}) == len(set(texts))
