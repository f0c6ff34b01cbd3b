"""SimHash components against brute force."""

import random
import re

import numpy as np
import xxhash

from ledgerlink.llm import simhash_dedup as sd
from ledgerlink.session import Workspace


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    head = list(range(len(fps)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for i in g}


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.randint(5, 150))] for _ in range(12)]
    out = [None, "", " \t\n", "one", "One two", "a b c d e"]
    for b in base:
        for _ in range(5):
            c = list(b)
            if rng.random() < 0.8:
                c[rng.randrange(len(c))] = word().upper()
            out.append(rng.choice([" ", "\n", "\x0b"]).join(c))
        out.append(" ".join(b))
    return out


def test_components_equal_brute_force(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())] + [(3, "one", "x", 0), (None, "one", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], fps)
    got = sorted(map(tuple, sd.near_groups(docs, tree_max=4).collect()), key=repr)
    assert got == sorted(((rows[i][0], f"{fps[i]:016x}", want[i]) for i in range(len(rows))), key=repr)


def test_trees_find_every_link():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    tile = np.sort(rng.integers(0, 3, len(fp)))
    parent, edge = sd.build_trees(tile, fp)
    roots = np.flatnonzero(parent < 0)
    q = np.arange(len(fp))
    found = {(int(a), int(b)) for x, y in sd.search_trees(fp, parent, edge, q, roots[tile], fp, 4) for a, b in zip(x, y)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if tile[i] == tile[j] and int(fp[i] ^ fp[j]).bit_count() <= 4}


def test_components_of_random_fingerprints(spark):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    ws = Workspace(spark)
    heads = dict(map(tuple, sd.component_heads(ws, sd.links(ws, spark.createDataFrame([(f,) for f in signed], "fp long"), tree_max=8)).collect()))
    want = brute_components(signed, fps)
    assert {f: heads.get(f, f) for f in signed} == {signed[i]: w for i, w in want.items()}


def test_long_text_in_segments():
    text = (" ".join(texts()[-1:]) + " ").encode() * 50
    whole = np.concatenate(list(sd.shingle_hashes(text, 4)))
    assert np.array_equal(whole, np.concatenate(list(sd.shingle_hashes(text, 4, segment=97))))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.near_groups(docs).count() == 0
