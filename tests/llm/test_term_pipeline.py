"""Pipelined lexical search against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerlink.llm import term_pipeline as tp


def plain_terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain(docs, items, k):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, size = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * total // size
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block,owners,k", [(8192, tp.OWNERS, 20), (7, (40, 3), 3), (1, (), 1)])
def test_search_equals_plain_scoring(spark, monkeypatch, block, owners, k):
    monkeypatch.setattr(tp, "BLOCK_DOCS", block)
    monkeypatch.setattr(tp, "BUNDLE_ITEMS", 3)
    rng = random.Random(k)
    word = lambda: rng.choice(["Alpha", "béta", "x-1", "Ünï", "été", "日本", "0a", "THE", "the"] + [f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(9)])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (7, "the " * 3000), (None, docs[3][1]), (600, None), (601, ""), (602, "., !")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(8)] + [(90, None), (91, ""), (92, "nowhere"), (93, docs[3][1])]
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, score long, term string").repartition(3)
    q = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in tp.search(d, q, k, owners=owners).collect()), key=lambda r: r[:2])
    assert got == plain(docs, items, k)


def test_repeated_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "doc_id int, text string")
    items = spark.createDataFrame([("i", "a"), ("i", "a"), (None, "b")], "item_id string, text string")
    got = sorted((tuple(r)[:3] for r in tp.search(docs, items).collect()), key=repr)
    assert got == [("i", 1, 1), ("i", 1, 1), (None, 1, 2), (None, 2, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.filter("item_id = 'zz'"))):
        assert tp.search(d, i).collect() == []


def test_term_map_only_filters(spark, monkeypatch):
    monkeypatch.setattr(tp, "MAP_BITS", 32)
    docs = spark.createDataFrame([(i, f"a{i} b{i} c") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a3 b3 zz"), (2, "b9")], "item_id long, text string")
    assert [tuple(r)[:3] for r in tp.search(docs, items).orderBy("item_id").collect()] == [(1, 1, 3), (2, 1, 9)]
