"""A minimal acyclic transducer from sorted keys to their ranks.

States that accept the same suffixes are one state, so a vocabulary takes little
space. Every edge carries the number of keys that come before those behind it; the
sum along a key's path is its lexicographic rank. The form is a few flat arrays:
many keys are looked up together, one byte of all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Edges sorted by state and byte, with target and rank; states are numbered children first."""

    def __init__(self, codes: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray):
        self.codes, self.targets, self.skips, self.final = codes, targets, skips, final

    def ranks(self, keys: list[bytes]) -> np.ndarray:
        """The rank of every key, or -1 for one that is not held."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.final):
            return out
        text = np.frombuffer(b"".join(keys), np.uint8)
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        at = np.cumsum(lengths) - lengths
        ends = at + lengths
        alive = np.arange(len(keys))
        state = np.full(len(keys), len(self.final) - 1, np.int64)
        rank = np.zeros(len(keys), np.int64)
        while len(alive):
            ended = at == ends
            if ended.any():
                good = ended & self.final[state]
                out[alive[good]] = rank[good]
                more = ~ended
                alive, state, rank, at, ends = alive[more], state[more], rank[more], at[more], ends[more]
            code = state * 256 + text[at]
            edge = np.searchsorted(self.codes, code)
            edge[edge == len(self.codes)] = 0
            on = self.codes[edge] == code if len(self.codes) else np.zeros(len(code), bool)
            edge = edge[on]
            alive, rank, at, ends = alive[on], rank[on] + self.skips[edge], at[on] + 1, ends[on]
            state = self.targets[edge]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.codes), len(self.final)], np.int64)
        return b"".join(
            a.tobytes()
            for a in (head, self.codes, self.targets.astype(np.int32), self.skips.astype(np.int32), self.final)
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        edges, states = np.frombuffer(data, np.int64, 2)
        at, parts = 16, []
        for kind, size in ((np.int64, edges), (np.int32, edges), (np.int32, edges), (np.bool_, states)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        codes, targets, skips, final = parts
        return cls(codes, targets.astype(np.int64), skips.astype(np.int64), final)


def build(keys: Iterable[bytes]) -> Transducer:
    """The minimal transducer of distinct keys in ascending order.

    Only the path of the newest key is open; states that it leaves are finished and
    replaced by an equal state if there is one.
    """
    known: dict[tuple, int] = {}
    held: list[int] = []  # keys behind each finished state

    def finish(state: list) -> int:
        own = (state[0], *state[1])
        number = known.get(own)
        if number is None:
            number = known[own] = len(held)
            held.append(state[0] + sum(held[child] for _, child in state[1]))
        return number

    def close(path: list[list], last: bytes, depth: int) -> None:
        while len(path) > depth + 1:
            child = finish(path.pop())
            path[-1][1].append((last[len(path) - 1], child))

    path: list[list] = [[False, []]]
    last = b""
    for key in keys:
        shared, most = 0, min(len(key), len(last))
        while shared < most and key[shared] == last[shared]:
            shared += 1
        close(path, last, shared)
        path.extend([False, []] for _ in range(len(key) - shared))
        path[-1][0] = True
        last = key
    close(path, last, 0)
    # The root is the last state: nothing else leads to as many keys, unless there are none.
    finish(path[0])

    codes, targets, skips, final = [], [], [], []
    for number, own in enumerate(known):
        before = int(own[0])
        final.append(own[0])
        for byte, child in own[1:]:
            codes.append(number * 256 + byte)
            targets.append(child)
            skips.append(before)
            before += held[child]
    return Transducer(
        np.array(codes, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array(final, bool)
    )
