"""Removal of repeated passages against the definition."""

import random

import pytest

from ledgerlink.llm import phrase_automata as pa


def plain(rows, width):
    """(doc_id, n_words, n_removed, kept) from the definition; a null id is larger than all others."""
    rank = lambda i: pa.LAST if i is None else i
    words = [(t or "").encode().split() for _, t in rows]
    low = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - width + 1):
            x = tuple(w[a : a + width])
            low[x] = min(low.get(x, pa.LAST), rank(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for a in range(len(w) - width + 1) if low[tuple(w[a : a + width])] < rank(i) for j in range(a, a + width)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed):
    """Passages shared whole, in part and overlapping; copies, near copies, repeats in a text, repeated and null ids."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "日本", "x", "y"]) if rng.random() < 0.2 else f"w{rng.randrange(40)}"
    passages = [[word() for _ in range(rng.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 15))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randint(1, 60)]
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(rows[0][0], rows[1][1]), (rows[2][0], rows[2][1]), (5, " ".join(["la"] * 400)), (6, " ".join(["la"] * 300))]
    rows += [(None, rows[3][1]), (None, rows[4][1] + " end"), (None, rows[4][1] + " end"), (3000, None), (3001, ""), (3002, " \t\n"), (3003, "one two"), (3004, "one  two")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width,gram,chunk,shard,automaton", [(1, 13, 4, 1 << 20, 1 << 20, 1 << 16), (2, 13, 4, 700, 500, 40), (3, 5, 2, 3000, 100, 7)])
def test_dedup_equals_the_definition(spark, monkeypatch, seed, width, gram, chunk, shard, automaton):
    monkeypatch.setattr(pa, "CHUNK", chunk)
    monkeypatch.setattr(pa, "SHARD_WORDS", shard)
    monkeypatch.setattr(pa, "AUTOMATON", automaton)
    monkeypatch.setattr(pa, "STRETCH", 3 if seed == 2 else 32)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id int, text string, rank int, t1 string").repartition(3)
    got = [(r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), r.kept) for r in pa.dedup(docs, width=width, gram=gram).collect()]
    assert sorted(got, key=repr) == plain(rows, width)


def test_equal_hashes_remove_nothing(spark, monkeypatch):
    """With a hash that is equal for all windows, the automata still compare the words."""
    monkeypatch.setattr(pa, "rolled", lambda codes, n: codes[: max(len(codes) - n + 1, 0)] * 0)
    rows = [r for r in corpus(4) if r[0] is not None]
    rows = [(i, t) for i, t in dict(rows).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: gone for i, _, gone, _ in plain(rows, 13)}
    got = {r.doc_id: sum(x.stop - x.start for x in r.removed) for r in pa.dedup(docs).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in want) and 0 < sum(got.values()) <= sum(want.values())


def test_automaton_numbers_many_words():
    a = pa.Automaton()
    words = [b"%d" % i for i in range(pa.DIGITS**2)]
    a.add(words, list(range(len(words) - 1)), 2, 7)
    assert a.full(1)
    a.compile()
    assert a.ends(words, 8).tolist() == list(range(1, len(words))) and not len(a.ends(words, 7))
    assert a.ends([b"x", b"59998", b"59999", b"x"], 9).tolist() == [2]


def test_empty_table(spark):
    assert pa.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
