"""Toxicity and language identification: held-out accuracy and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from ledgerlink.llm import language_id, registry, toxicity

SF = "/root/testdata/sf0.1"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_non_negative_risk_separates_positives_from_unlabelled():
    rng = random.Random(1)
    toxic = [rng.random() < 0.2 for _ in range(2000)]
    found = [sorted({rng.randrange(5) if t else rng.randrange(5, 40), rng.randrange(5, 40)}) for t in toxic]
    positive = np.array([t and rng.random() < 0.3 for t in toxic])
    w, b = toxicity.train(found, positive, np.ones(2000, bool), 40, 0.2)
    guess = [w[f].sum() + b > 0 for f in found]
    assert np.mean(np.array(guess) == np.array(toxic)) > 0.97
    assert min(w) >= 0


def test_toxicity_held_out(spark):
    got = registry.QUERIES["op8_toxicity_pu"](spark, SF).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    hit, true = both.predicted == 1, both.toxic == 1
    assert (hit & true).sum() / hit.sum() > 0.85 and (hit & true).sum() / true.sum() > 0.75


def test_toxicity_edges(spark):
    rows = [(i, "nice words here " + ("vile" if i % 3 == 0 else "kind") + str(i % 7), "x") for i in range(300)] + [(900, None, None), (901, "", ""), (None, "vile1 vile", "z"), (0, "nice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.3
    assert all(r.held_out for r in got if r.doc_id is None)
    toxic = {r.doc_id for r in got if r.predicted and r.doc_id is not None}
    assert toxic >= {i for i in range(300) if i % 3 == 0} - {0} and not any(i % 3 for i in toxic)
    kept = toxicity.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if not r.predicted)
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} < {float(1 / (1 + math.exp(50))), 0.0} | {1 / (1 + np.exp(50.0))}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_language_held_out(spark):
    got = registry.QUERIES["op10_language_ecoc"](spark, SF).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: crc(i) % 5 == 0)).all() and got.score.between(0, 1).all()
    both = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(got[got.held_out], on="doc_id")
    assert (both.lang == both.lang_pred).mean() > 0.98


@pytest.mark.parametrize("n", [1, 2, 4, 5, 12])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n
    if n > 2:
        least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert least >= (2 ** (n - 2) if n <= 5 else code.shape[1] // 4)


def test_language_edges(spark):
    rng = random.Random(4)
    say = {"a": "abcde", "b": "fghij", "c": "klmno"}
    rows = [(i, " ".join("".join(rng.choice(say[c]) for _ in range(5)) for _ in range(12)), c, 0) for i in range(120) for c in [rng.choice("abc")]]
    rows += [(500, None, "a", 0), (501, "", "a", 0), (502, "12 -- 3", "b", 0), (503, "…é…", None, 0), (None, "abc", "c", 0), (7, "abcab", None, 0), (504, "fghij " * 400_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).filter("doc_id is not null").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert got[503].lang_pred in say and got[504].lang_pred == "b"
    right = [got[i].lang_pred == c for i, _, c, _ in rows[:120] if i in got and i != 7]
    assert np.mean(right) > 0.97
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}
    one = language_id.fit(docs.filter("lang = 'a'"))
    assert {r.lang_pred for r in language_id.predict(docs.filter("doc_id < 5"), one).collect()} == {"a"}
    assert language_id.predict(docs.limit(0), one).count() == 0
