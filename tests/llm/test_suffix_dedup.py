"""Repeated passages against a table of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import registry
from ledgerlink.llm import suffix_dedup as sd


def brute(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + depth]) for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[hash(d[i : i + depth])] > 1:
                gone[i : i + depth] = b"\1" * depth
        n_spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), n_spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def texts(depth):
    rng = random.Random(depth)
    word = lambda: "".join(rng.choice("abcdeé🎉") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(depth // 3) for _ in range(4)] + ["x" * (2 * depth), "ab" * depth]
    out = [None, "", "short", "y" * (depth - 1), "y" * depth]
    for _ in range(60):
        out.append("".join(rng.choice([prose(rng.randint(1, 40)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 30) :]]) for _ in range(rng.randint(1, 5))))
    for t in out[5:20]:
        c = list(t)
        for _ in range(2):
            c[rng.randrange(len(c))] = "#"
        out += ["".join(c), t]
    return out


@pytest.mark.parametrize(("depth", "gram", "run_bytes"), [(40, 10, 1 << 20), (64, 16, 150)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, depth, gram, run_bytes):
    monkeypatch.setattr(sd, "RUN_BYTES", run_bytes)
    rows = [(i, t, "k", 1) for i, t in enumerate(texts(depth))] + [(None, "q" * depth + "zz", None, None), (6, texts(depth)[6], "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed string, t1 int").repartition(5)
    got = [
        (r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
        for r in sd.dedup(docs, depth=depth, gram=gram).collect()
    ]
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], depth))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(0 < w[2] < w[1] for w in want)


def test_registered_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(r.doc_id, *b) for r, b in zip(docs, brute([r.text for r in docs], 400))]
    assert sorted(map(tuple, registry.QUERIES["op2_suffix_radix"](spark, sf).collect())) == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup(docs).filter(F.col("n_bytes") > 0).count() == 0
