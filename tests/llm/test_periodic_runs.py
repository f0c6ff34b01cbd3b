"""Periodic runs against brute force, on words and through the registered query."""

import hashlib
import random
import re
import zlib

import numpy as np

from ledgerlink.llm import periodic_runs as pr
from ledgerlink.llm import registry

SF = "/root/testdata/sf0.001"


def brute(x):
    """(start, length, period) of all runs, from the definition."""
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                y = x[i : i + length]
                if all(any(y[t] != y[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 50])
    x = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    return x


def test_find_runs_equals_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        texts = [planted(rng) for _ in range(rng.randint(1, 7))]
        got = pr.find_runs([np.array(x, np.int64) for x in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(x) for x in texts]


def test_levels_shrink_to_one_symbol_a_text():
    words = np.concatenate([np.arange(2, 3002) % 7 + 2, [0], np.full(4000, 3), [1]])
    levels = pr.grammar(words.astype(np.int64), 2)
    assert len(levels[-1].symbol) <= 5 and len(levels) < 80


def row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    rows += [(10**6 + i, " ".join(map(str, planted(random.Random(i))))) for i in range(300)]
    rows += [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "x " * 5000), (-4, "x " * 5000), (-5, "a b a b " * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["op11_recompression"](spark, str(tmp_path)).collect()))
    want = [row(*r) if len(r[1] or "") < 5000 else None for r in rows]
    long = (-4, 1, 0, 5000, 1, 5000000, hashlib.sha256(b"0,5000,1\n").hexdigest(), hashlib.sha256(b"x").hexdigest())
    assert zlib.crc32(b"-4") % 10 and got == sorted(w or long for w in want)
    assert sum(r[1] > 0 for r in got) > 60


def test_defined_cases(spark):
    rows = [(None, "a b " * 9, 1, 2), (None, None, 3, 4), (7, "c " * 6, None, None), (7, "c " * 5, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, collapsed long")
    got = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in pr.periodic_runs(docs).collect()}
    assert got == {(None, "a b", ((0, 18, 2),)), (None, "", ()), (7, "c", ((0, 6, 1),)), (7, "c c c c c", ())}
    assert pr.periodic_runs(docs.limit(0)).count() == 0
