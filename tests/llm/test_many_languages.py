"""Language identification with more languages than codes are tried for in full."""

import random

import numpy as np

from ledgerlink.llm import language_id as li


def test_rare_languages_are_learned_beside_many(spark):
    rng = random.Random(3)
    names = [f"l{i:02d}" for i in range(70)]
    letters = [rng.sample("abcdefghijklmnopqrstuvwxyz", 5) for _ in names]
    rows = []
    for i, (name, own) in enumerate(zip(names, letters)):
        for _ in range(12 if i < 64 else 8):
            rows.append((len(rows), " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(80)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.languages == names
    found = {r.doc_id: r.lang_pred for r in li.predict(docs, model).collect()}
    rare = [r for r in rows if r[2] in names[64:]]
    assert sum(found[i] == lang for i, _, lang in rare) > 0.9 * len(rare)


def test_each_language_has_a_row_however_few_fit(spark, monkeypatch):
    monkeypatch.setattr(li, "FIT_ROWS", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i % 20}") for i in range(400)], "doc_id long, text string, lang string")
    assert len(li.fit(docs).languages) == 20


def test_loss_equals_the_sum_over_bits():
    rng = np.random.default_rng(1)
    code = li.codewords(9)
    model = li.Model([str(i) for i in range(9)], code, rng.random(code.shape), np.zeros(4), np.ones(4), rng.normal(size=(4, code.shape[1])), np.zeros(code.shape[1]))
    x = rng.normal(size=(30, 4))
    loss = (np.logaddexp(0, -(x @ model.coef)[:, None, :] * code[None]) * model.weigh[None]).sum(axis=2)
    assert (li.decide(model, x)[0] == loss.argmin(axis=1)).all()
