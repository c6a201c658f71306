import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runledger.llm import bpe
from tests.llm.conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
CODER = bpe.FragmentCoder(PATH)

PIECES = ["'s", "'re", "'ll", "' s", "!!'s", " ", "  ", "\n", "\r\n", "\t", " ", " ", "\x85", "\x1c",
          "qz", "Qj", "zx", "hello", "WORLD", "é", "ß", "à", "\xa0 \xa0 \xa0 \xa0", "don't", ",", "—", "\"", "x9.", "A", "日本", "\U0001f600", "12", "3.4", "<|endoftext|>", "<|", "|>", "_", "\x00"]


def whole(text):
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    return ids, WHOLE.decode(ids, skip_special_tokens=False)


def coded(texts):
    ids, decoded = CODER.code([t.encode() for t in texts])
    return [(list(memoryview(i).cast("i")), d.decode()) for i, d in zip(ids, decoded, strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_fragments_equal_whole_texts(text):
    assert coded([text]) == [whole(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert coded([text]) == [whole(text)]


def test_cuts_are_certain():
    inside = bpe.inner_pairs(WHOLE)
    assert inside[ord("t"), ord("h")] and not inside[ord("a"), ord(" ")]
    assert len(CODER.fragments(b"one two  three\nfour")) == 4
    assert CODER._pieces([b"the", b" BHat", b"<|endoftext|>"]) == [[b"the"], [b" B", b"Hat"], [b"<|endoftext|>"]]


def test_edge_cases(spark, edge_rows):
    got = bpe.digests(bpe.encode_decode(documents(spark, edge_rows), PATH)).collect()
    want = []
    for doc_id, text in edge_rows:
        ids, decoded = whole(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(decoded)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert bpe.encode_decode(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("remembered", [1, 3])
def test_forgetting_changes_nothing(monkeypatch, remembered):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    texts = ["a b c d", "c d e f a", "a b"]
    assert coded(texts) == [whole(t) for t in texts]
