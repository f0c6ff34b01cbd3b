"""Periodic runs of words, found by recompression.

A run is a stretch of consecutive words with smallest period q and length of at least ``max(LEAST, TIMES * q)`` that no
neighbouring word extends with period q.

1. Candidates on a harmonic grid.  In a run of period q the words i and i + q are equal on a stretch of at least
   (TIMES - 1) * q places, so one of the places 0, s, 2s, ... with s = (TIMES - 1) * q lies on it.  All grids of a text of n
   words have about n ln(n) / (TIMES - 1) places.
2. Recompression.  Words are numbered and the sequence is shrunk in turns: *blocks* of equal symbols become one symbol of
   (symbol, count), then *pairs* whose first symbol lies in one half of the alphabet and whose second in the other become one
   symbol each.  Equal passages shrink alike up to a few symbols at their ends.  The levels are a run-length grammar
   of depth O(log n), without a suffix array.
3. Extensions.  How far the text agrees from i and i + q on, and before them, is answered on the grammar: both places climb
   while equal symbols carry them, then descend to the first pair of different words; equal blocks are jumped by their counts.
   All candidates of a batch of texts move at once.  A stretch found with several periods keeps the smallest.

Texts are laid end to end with separators that equal nothing, so a batch has one grammar; a text is never split.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to the empty text.  Rows are judged each
for itself, so repeated rows and repeated or null ids repeat their result.  Columns other than the two named are ignored
and may have any name.  A very long text makes a batch of its own.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import chunks, small_batches, utf8

LEAST, TIMES = 6, 4
BATCH = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class Level:
    """A sequence of symbols: where each begins in the text, and how many equal ones follow and precede it."""

    def __init__(self, symbol: np.ndarray, start: np.ndarray, end: int):
        self.symbol, self.start = symbol, np.append(start, end)
        self.place = None
        n = len(symbol)
        head = np.ones(n, bool)
        head[1:] = symbol[1:] != symbol[:-1]
        self.first = np.flatnonzero(head)
        self.count = np.diff(np.append(self.first, n))
        self.block = np.cumsum(head) - 1

    def at(self, place: np.ndarray) -> np.ndarray:
        """Index of the symbol that begins at each place of the text, -1 where none does."""
        if self.place is None:
            self.place = np.full(int(self.start[-1]) + 1, -1, np.int32)
            self.place[self.start] = np.arange(len(self.start))
        return self.place[place]

    def ahead(self, i: np.ndarray) -> np.ndarray:
        b = self.block[i]
        return self.first[b] + self.count[b] - i

    def behind(self, i: np.ndarray) -> np.ndarray:
        return i - self.first[self.block[i]] + 1


def blocks(level: Level, used: int) -> tuple[Level, int]:
    """Each stretch of equal symbols as one symbol; ``used`` symbols are taken so far."""
    symbol = level.symbol[level.first].copy()
    many = np.flatnonzero(level.count > 1)
    _, name = np.unique(np.stack([symbol[many], level.count[many]]), axis=1, return_inverse=True)
    symbol[many] = used + name.reshape(-1)
    return Level(symbol, level.start[level.first], int(level.start[-1])), used + (int(name.max()) + 1 if len(many) else 0)


def pairs(level: Level, used: int, turn: int, separators: int) -> tuple[Level, int]:
    """Each pair of a left and a right symbol as one symbol; symbols below ``separators`` stay alone."""
    symbol = level.symbol
    half = mix(symbol.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)
    real = symbol >= separators
    head = np.flatnonzero((half[:-1] == 0) & (half[1:] == 1) & real[:-1] & real[1:])
    _, name = np.unique(symbol[head] * np.int64(used) + symbol[head + 1], return_inverse=True)
    out = symbol.copy()
    out[head] = used + name
    keep = np.ones(len(symbol), bool)
    keep[head + 1] = False
    return Level(out[keep], level.start[:-1][keep], int(level.start[-1])), used + (int(name.max()) + 1 if len(head) else 0)


def grammar(words: np.ndarray, separators: int) -> list[Level]:
    """All levels from the words up.  Words are numbers; those below ``separators`` occur once each and stand between texts."""
    level = Level(words, np.arange(len(words)), len(words))
    levels, used, turn = [level], int(words.max(initial=0)) + 1, 0
    while len(level.symbol) > 2 * separators + 1:
        for shrink in (blocks, lambda lv, u: pairs(lv, u, turn, separators)):  # noqa: B023
            smaller, used = shrink(level, used)
            if len(smaller.symbol) < len(level.symbol):
                level = smaller
                levels.append(level)
        turn += 1
    return levels


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from the places i and j on (forward), or before them."""
    size = int(levels[0].start[-1])
    a, b = i.copy(), j.copy()
    height = np.zeros(len(i), np.int64)
    climbing = np.ones(len(i), bool)
    top = len(levels) - 1
    done = np.zeros(len(i), bool)
    while not done.all():
        for h in np.unique(height[~done]):
            q = np.flatnonzero((height == h) & ~done)
            level = levels[h]
            if h < top:  # both places are borders one level up: go there
                up = q[climbing[q] & (levels[h + 1].at(a[q]) >= 0) & (levels[h + 1].at(b[q]) >= 0)]
                height[up] += 1
                q = np.setdiff1d(q, up, assume_unique=True)
            x, y = level.at(a[q]), level.at(b[q])
            inside = (a[q] < size) & (b[q] < size) if forward else (a[q] > 0) & (b[q] > 0)
            if not forward:
                x, y = x - 1, y - 1
            same = inside.copy()
            same[inside] = level.symbol[x[inside]] == level.symbol[y[inside]]
            go, x, y = q[same], x[same], y[same]
            if forward:
                n = np.minimum(level.ahead(x), level.ahead(y))
                a[go], b[go] = level.start[x + n], level.start[y + n]
            else:
                n = np.minimum(level.behind(x), level.behind(y))
                a[go], b[go] = level.start[x - n + 1], level.start[y - n + 1]
            stop = q[~same]
            climbing[stop] = False
            done[stop[height[stop] == 0]] = True
            height[stop] -= 1
    return np.abs(a - i)


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Rows (start, length, period) of each text, by start, then period.  A text is an array of word numbers >= 0."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))  # long texts first: those with period q are a prefix
    size = np.array([len(texts[k]) for k in order], np.int64)
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    n = int((size >= least).sum())
    if not n:
        return out
    size, begin = size[:n], np.cumsum(size[:n] + 1) - size[:n] - 1
    words = np.empty(int(size.sum()) + n, np.int64)
    for k in range(n):
        words[begin[k] : begin[k] + size[k]] = texts[order[k]] + n
        words[begin[k] + size[k]] = k
    found = []
    for q in range(1, int(size[0]) // times + 1):
        end = int((begin + size)[np.searchsorted(-size, -max(least, times * q), "right") - 1])
        at = np.flatnonzero(words[: end - q : (times - 1) * q] == words[q : end : (times - 1) * q]) * (times - 1) * q
        if len(at):
            found.append(np.stack([at, np.full(len(at), q)]))
    if not found:
        return out
    i, q = np.concatenate(found, axis=1)
    levels = grammar(words, n)
    ahead = agreement(levels, i, i + q, True)
    back = np.zeros(len(i), np.int64)
    live = np.flatnonzero(ahead > 0)
    back[live] = agreement(levels, i[live], (i + q)[live], False)
    length = back + ahead + q
    hit = np.flatnonzero(length >= np.maximum(least, times * q))
    start, length, q = (i - back)[hit], length[hit], q[hit]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    one = np.ones(len(start), bool)  # a stretch is one run, with its smallest period
    one[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[one], length[one], q[one]
    by = np.lexsort((q, start))
    rows = np.stack([start, length, q], axis=1)[by]
    text = np.searchsorted(begin, rows[:, 0], "right") - 1
    rows[:, 0] -= begin[text]
    cut = np.searchsorted(text, np.arange(n + 1))
    for k in np.unique(text):
        out[order[k]] = rows[cut[k] : cut[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, joined: of each run only its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, s in zip(words, stay) if s)


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), collapsed (the text without repeats) of each row.

    ``prepare(doc_id, words)`` may rewrite a text's words before they are searched.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            for first, texts in chunks(utf8(b.column(1)), BATCH):
                ids = b.column(0).slice(first, len(texts))
                words = [t.split() for t in texts]
                if prepare is not None:
                    words = [prepare(i, w) for i, w in zip(ids.to_pylist(), words)]
                number: dict[bytes, int] = {}
                for w in words:
                    for x in w:
                        number.setdefault(x, len(number))
                runs = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words], least, times)
                kept = [collapsed(w, r) if len(r) else b" ".join(w) for w, r in zip(words, runs)]
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(item)),
                )
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    schema = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema)
