"""Fuzzy text ratios over lists of texts: the numpy body of the Arrow functions in fuzzy.py.

A batch is scored at once: the LCS recurrence of Hyyrö (2004) keeps one 64-bit word per pair, so a step
is a handful of numpy operations over the whole batch.  Patterns over 63 characters take the same recurrence
on Python integers.
"""

from __future__ import annotations

import numpy as np

_CHUNK = 2048


# ---------------------------------------------------------------- plain LCS on arbitrary length


def lcs_len(a: str, b: str) -> int:
    """Longest common subsequence length, any lengths."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


# ---------------------------------------------------------------- batch LCS


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, dtype=np.uint32)
    for r, t in enumerate(texts):
        if t:
            out[r, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    return out


def _hit_masks(pattern: list[str], text: list[str]) -> np.ndarray:
    """One word per (pair, text position): bit i set where pattern[i] equals that character."""
    m, n = max(map(len, pattern)), max(map(len, text))
    p, t = _codes(pattern, m, 0xFFFFFFFF), _codes(text, n, 0xFFFFFFFE)
    hits = np.zeros((len(pattern), n), dtype=np.uint64)
    for i in range(m):
        hits |= (p[:, i : i + 1] == t).astype(np.uint64) << np.uint64(i)
    return hits


def _step(state: np.ndarray, hit: np.ndarray) -> np.ndarray:
    u = state & hit
    return (state + u) | (state - u)


def _score_chunk(pattern: list[str], text: list[str], windows: bool) -> np.ndarray:
    """Whole-text LCS, or with windows=True the best 2*LCS/(len+window) over all alignment windows."""
    plen = np.array([len(x) for x in pattern])
    tlen = np.array([len(x) for x in text])
    full = (np.uint64(1) << plen.astype(np.uint64)) - np.uint64(1)
    hits = _hit_masks(pattern, text)
    n = hits.shape[1]
    if not windows:
        state = full.copy()
        for j in range(n):
            state = _step(state, hits[:, j])
        return plen - np.bitwise_count(state & full)
    m = int(plen.max())
    # Windows start at -(plen-1) .. tlen-1 in text positions, each plen wide, clipped to the text.
    padded = np.zeros((len(pattern), n + 2 * m), dtype=np.uint64)
    padded[:, m : m + n] = hits
    starts = n + m
    state = np.repeat(full[:, None], starts, axis=1)
    for k in range(m):
        live = k < plen
        nxt = _step(state, padded[:, k : k + starts])
        state = np.where(live[:, None], nxt, state) if not live.all() else nxt
    lcs = plen[:, None] - np.bitwise_count(state & full[:, None]).astype(np.int64)
    first = np.arange(starts)[None, :] - m
    size = np.minimum(first + plen[:, None], tlen[:, None]) - np.maximum(first, 0)
    ok = size > 0
    total = plen[:, None] + np.maximum(size, 1)
    ratio = np.where(ok, 1.0 - (total - 2.0 * lcs) / total, 0.0)
    # An over-long start (pattern shorter than the widest in the chunk) gives size <= 0 and is ignored.
    return ratio.max(axis=1)


def _batched(a: list[str], b: list[str], windows: bool) -> np.ndarray:
    """Apply _score_chunk to pairs whose pattern side (a) fits a word; order-preserving."""
    out = np.zeros(len(a))
    by_len = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    for s in range(0, len(by_len), _CHUNK):
        idx = by_len[s : s + _CHUNK]
        out[idx] = _score_chunk([a[i] for i in idx], [b[i] for i in idx], windows)
    return out


def _slow_partial(short: str, long: str) -> float:
    m, best = len(short), 0.0
    for start in range(1 - m, len(long)):
        w = long[max(start, 0) : start + m]
        if w:
            best = max(best, 2.0 * lcs_len(short, w) / (m + len(w)))
    return best


# ---------------------------------------------------------------- ratios on lists


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    fast = []
    for i, (x, y) in enumerate(zip(a, b)):
        if min(len(x), len(y)) <= 63:
            if x and y:
                fast.append(i)
        else:
            out[i] = lcs_len(x, y)
    if fast:
        p = [a[i] if len(a[i]) <= len(b[i]) else b[i] for i in fast]
        t = [b[i] if len(a[i]) <= len(b[i]) else a[i] for i in fast]
        out[fast] = _batched(p, t, False)
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """200*LCS/(len a + len b); two empty texts are equal."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=float)
    lcs = lcs_many(a, b)
    return np.where(total == 0, 100.0, (1.0 - (total - 2.0 * lcs) / np.maximum(total, 1.0)) * 100.0)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter text against every window of the longer one, overhanging ends included.

    For equal lengths both texts take the pattern role.
    """
    out = np.zeros(len(a))
    fast, short, long = [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            out[i] = 100.0
        elif x and y:
            roles = [(x, y), (y, x)] if len(x) == len(y) else [(x, y) if len(x) < len(y) else (y, x)]
            for s, l in roles:
                if s in l:
                    out[i] = 100.0
                elif len(s) <= 63:
                    fast.append(i)
                    short.append(s)
                    long.append(l)
                else:
                    out[i] = max(out[i], 100.0 * _slow_partial(s, l))
    if fast:
        np.maximum.at(out, fast, 100.0 * _batched(short, long, True))
    return out


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    ordered = {x: " ".join(sorted(x.split())) for x in {*a, *b}}
    return indel_ratios([ordered[x] for x in a], [ordered[x] for x in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """100 when the token sets share something and one contains the other; 0 when either is empty."""
    out = np.zeros(len(a))
    words = {x: frozenset(x.split()) for x in {*a, *b}}
    todo, left, right, base, total = [], [], [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        wa, wb = words[x], words[y]
        if not wa or not wb:
            continue
        common = wa & wb
        only_a, only_b = wa - common, wb - common
        if common and not (only_a and only_b):
            out[i] = 100.0
            continue
        ja, jb = " ".join(sorted(only_a)), " ".join(sorted(only_b))
        sect = sum(map(len, common)) + max(len(common) - 1, 0)
        glue = 1 if sect else 0
        la, lb = sect + glue + len(ja), sect + glue + len(jb)
        if sect:
            out[i] = max(100.0 - 100.0 * (glue + len(ja)) / (sect + la), 100.0 - 100.0 * (glue + len(jb)) / (sect + lb))
        todo.append(i)
        left.append(ja)
        right.append(jb)
        base.append(len(ja) + len(jb))
        total.append(la + lb)
    if todo:
        base_n = np.array(base, dtype=float)
        # Recover the indel distance of the two remainders from their ratio's LCS.
        lcs = lcs_many(left, right)
        np.maximum.at(out, todo, 100.0 - 100.0 * (base_n - 2.0 * lcs) / np.array(total))
    return out
