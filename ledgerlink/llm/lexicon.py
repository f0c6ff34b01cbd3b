"""A minimal acyclic transducer: sorted byte strings to token ids, suffixes shared, stored as flat arrays.

States are merged while the sorted words are added (Daciuk et al. 2000).  Each edge carries how many words come
before it in its state, so a walk adds up to the word's rank, and the rank points at the word's ids.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np


def build(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The automaton's file.  ``words`` are sorted, distinct and not empty."""
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    path: list[list] = [[False, []]]  # of the word added last: final, [(byte, state), ...]; the open edge is path's next

    def close(depth: int, word: bytes) -> None:
        while len(path) - 1 > depth:
            final, out = path.pop()
            key = (final, tuple(out))
            state = register.get(key)
            if state is None:
                state = register[key] = len(finals)
                finals.append(final)
                edges.append(key[1])
            path[-1][1].append((word[len(path) - 1], state))

    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same, last)
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0] = True
        last = w
    close(0, last)
    root = len(finals)
    finals.append(path[0][0])
    edges.append(tuple(path[0][1]))

    count = [0] * len(finals)  # words reached from a state; targets are always numbered before their sources
    key, target, before = [], [], []
    for s, out in enumerate(edges):
        n = int(finals[s])
        for byte, t in out:
            key.append(s * 256 + byte)
            target.append(t)
            before.append(n)
            n += count[t]
        count[s] = n
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    out = io.BytesIO()
    arrays = {
        "root": np.array([root], np.int64),
        "final": np.array(finals, np.int64),
        "key": np.array(key, np.int64),
        "target": np.array(target, np.int64),
        "before": np.array(before, np.int64),
        "start": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.int64),
    }
    head = np.array([len(a) for a in arrays.values()], np.int64)
    out.write(head.tobytes())
    for a in arrays.values():
        out.write(a.tobytes())
    return out.getvalue()


class Lexicon:
    """A built file, mapped into memory: all workers of a machine share its pages."""

    FIELDS = ("root", "final", "key", "target", "before", "start", "ids")

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        at = len(self.FIELDS)
        for name, n in zip(self.FIELDS, data[:at].tolist()):
            setattr(self, name, data[at : at + n])
            at += n

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """Rank of each word in the lexicon, -1 if absent.  All words walk one byte a step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        out = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return out
        at = np.flatnonzero(sizes > 0)
        state, rank, depth = np.full(len(at), self.root[0]), np.zeros(len(at), np.int64), 0
        while len(at):
            key = state * 256 + text[start[at] + depth]
            edge = np.searchsorted(self.key, key)
            edge[edge == len(self.key)] = 0
            there = self.key[edge] == key
            at, edge = at[there], edge[there]
            state, rank = self.target[edge], rank[there] + self.before[edge]
            depth += 1
            ends = sizes[at] == depth
            done = ends & (self.final[state] == 1)
            out[at[done]] = rank[done]
            at, state, rank = at[~ends], state[~ends], rank[~ends]
        return out

    def outputs(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ranks in a row, number of ids of each)."""
        n = self.start[rank + 1] - self.start[rank]
        return self.ids[spans(self.start[rank], n)], n


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then start[1], ..."""
    total = int(n.sum())
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)
