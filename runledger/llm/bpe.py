"""Byte-pair encoding and decoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be covered
by one token, so every encoding has a token boundary there. A text is cut at
such pairs into fragments, each fragment is encoded alone, and the results are
concatenated. Fragments repeat, so each distinct one is encoded once per task.

A cut must also leave the splitting into words as it was, which looks at the
characters around a boundary. Only these certain pairs are used:

* a character that is no white space, then ASCII white space: no word goes on
  over such a place and none looks back over it;
* an ASCII letter or digit, then an ASCII sign: the run of letters or digits ends
  there, and what follows is read as it would be after it;
* an ASCII letter, then an ASCII letter: both lie in one run of letters, whose
  rest is a run of letters again.

Every other place stays uncut; a text without any cut is one fragment.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runledger.llm.text import id_and_text, small_batches, texts_of

#: Distinct fragments remembered by a task before it starts anew.
REMEMBERED = 200_000

SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def byte_of_symbol() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def inner_pairs(tokenizer: Tokenizer) -> np.ndarray:
    """A 256 x 256 table: True where the pair of bytes occurs inside a token."""
    symbols, inside = byte_of_symbol(), np.zeros((256, 256), bool)
    for token in tokenizer.get_vocab(with_added_tokens=False):
        data = [symbols[c] for c in token if c in symbols]
        inside[data[:-1], data[1:]] = True
    return inside


_SPACES = b" \t\n\x0b\x0c\r"
_WORD = bytes(b for b in range(128) if chr(b).isalnum())
_SIGNS = bytes(b for b in range(128) if b not in _WORD and b not in _SPACES)


def _one_of(data: bytes) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in data) + "]"


def cut_pattern(inside: np.ndarray) -> re.Pattern:
    """What matches one fragment between the cuts at white space and before signs.

    After some bytes white space is no certain cut, as a token holds the pair;
    a fragment goes on over such a place. Signs cut only if no token has a letter
    or digit before a sign.
    """
    space = _one_of(_SPACES)
    solid = _one_of(bytes(b for b in range(256) if b not in _SPACES))
    fragment = f"{solid}+"
    if not inside[np.ix_(list(_WORD), list(_SIGNS))].any():
        word, rest = _one_of(_WORD), _one_of(bytes(b for b in range(128, 256)))
        loose = _one_of(_SIGNS + bytes(range(128, 256)))
        # No letter or digit is followed by a sign in here.
        run = f"{word}+(?:{rest}{loose}*)?"
        fragment = f"(?:{loose}+(?:{run})*|(?:{run})+)"
    unsure = bytes(a for a in range(256) if a not in _SPACES and inside[a, list(_SPACES)].any())
    more = f"(?:(?<={_one_of(unsure)}){space}+{solid}*)*" if unsure else ""
    return re.compile(f"{space}*{fragment}{more}|{space}+".encode())


def letter_cuts(inside: np.ndarray) -> np.ndarray:
    """True for two ASCII letters whose pair occurs in no token."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    return ~inside & letter[:, None] & letter[None, :]


class FragmentCoder:
    """Encodes and decodes by fragments, with a memory of those seen."""

    def __init__(self, path: str):
        # Spark decides how many texts are worked on at once.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        inside = inner_pairs(self.tokenizer)
        self.find = cut_pattern(inside).findall
        self.letter_cuts = letter_cuts(inside)
        #: Added tokens are matched before all splitting; each is a fragment.
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        self.split_added = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")").split
        symbols = byte_of_symbol()
        self.bytes_of = {
            i: bytes(symbols[c] for c in token if c in symbols)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
        } | {i: t.content.encode() for i, t in added.items()}
        self.ids_of: dict[bytes, bytes] = {}
        self.text_of: dict[bytes, bytes] = {}

    def fragments(self, text: bytes) -> list[bytes]:
        """A text cut between white space, signs and added tokens."""
        if not any(a in text for a in self.added):
            return self.find(text)
        parts = self.split_added(text)
        return [f for k, part in enumerate(parts) for f in ([part] if k % 2 else self.find(part))]

    def forget(self) -> None:
        self.ids_of.clear()
        self.text_of.clear()

    def _pieces(self, fragments: list[bytes]) -> list[list[bytes]]:
        """Each fragment cut between letters."""
        data = np.frombuffer(b"".join(fragments), np.uint8)
        cuts = (np.flatnonzero(self.letter_cuts[data[:-1], data[1:]]) + 1).tolist()
        out, start, at = [], 0, 0
        for fragment in fragments:
            end, own = start + len(fragment), [0]
            while at < len(cuts) and cuts[at] < end:
                if cuts[at] > start:
                    own.append(cuts[at] - start)
                at += 1
            if len(own) > 1 and fragment not in self.added:
                out.append([fragment[i:j] for i, j in zip(own, [*own[1:], len(fragment)], strict=True)])
            else:
                out.append([fragment])
            start = end
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode and decode fragments not seen yet, in one call."""
        pieces = self._pieces(new)
        coded = iter(
            self.tokenizer.encode_batch_fast(
                [p.decode() for own in pieces for p in own], add_special_tokens=False
            )
        )
        for fragment, own in zip(new, pieces, strict=True):
            ids = [i for _ in own for i in next(coded).ids]
            self.ids_of[fragment] = struct.pack(f"<{len(ids)}i", *ids)
            self.text_of[fragment] = b"".join([self.bytes_of[i] for i in ids])

    def code(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids and decoded UTF-8 of each text."""
        if len(self.ids_of) > REMEMBERED:
            self.forget()
        split = [self.fragments(text) for text in texts]
        new = set().union(*split).difference(self.ids_of)
        if new:
            self._learn(list(new))
        ids, decoded = self.ids_of.__getitem__, self.text_of.__getitem__
        return [b"".join(map(ids, f)) for f in split], [b"".join(map(decoded, f)) for f in split]


@lru_cache(1)
def _coder(path: str) -> FragmentCoder:
    return FragmentCoder(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the ``decoded`` text of every document.

    Equal to encoding each whole text with the tokenizer, without special tokens
    added, and decoding its ids with special tokens kept. Null and empty texts
    have no ids and an empty decoded text. Rows are independent: null ids,
    repeated rows and further columns have no effect, an empty table gives no
    rows. ``tokenizer_path`` is read on the executors: it must be installed there.
    """

    def run(batches):
        coder = _coder(tokenizer_path)
        for batch in small_batches(batches):
            texts = texts_of(batch.column(1))
            # Small groups keep the ids of a batch of long texts from piling up.
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= 4_000_000):
                    size += len(texts[end])
                    end += 1
                ids, decoded = coder.code(texts[start:end])
                counts = [len(i) // 4 for i in ids]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                        pa.array(decoded, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
                start = end
        # The worker may go on to other work and keeps no fragments meanwhile.
        coder.forget()

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`encode_decode` returned."""
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
