"""Near copies by shingle similarity against brute force."""

import random

from ledgerlink.llm import shingle_dedup as sh


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def close(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def texts():
    """Planted copies with words changed in a few places, around the bound and far from it, and chains of copies."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    out = [None, "", " \t", "one", "One", "two words"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        out.append(" ".join(base))
        for n in (1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(n):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            if n == 3:
                base = copy
    return out


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if close(sets[i], sets[j]):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [rows[find(i)][0] for i in range(len(rows))]


def test_survivors_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    head = brute(rows)
    got = sorted(r.doc_id for r in sh.survivors(docs).collect())
    assert got == sorted(set(head))
    assert len(got) < len(rows) / 2


def test_pipeline_stage_drops_copies_at_the_bound(spark):
    """A copy at similarity 0.8 to 0.9 goes; one below 0.8 stays."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    for i in (30, 90, 150):
        near[i] = "x"
    for i in range(10, 190, 20):
        far[i] = "y"
    a, b, c = (shingles(" ".join(w)) for w in (words, near, far))
    assert 0.8 <= len(a & b) / len(a | b) < 0.9 and not close(a, c) and not close(b, c)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def family(n, seed, words=240, edits=24):
    """Texts with one base of which each has changed words of its own: about 0.45 to 0.6 similar to each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for i in rng.sample(range(words), edits):
            t[i] = f"e{rng.randrange(10**9)}"
        out.append(t)
    return out


def counted(spark, monkeypatch, rows):
    """survivors, and how many pairs were compared."""
    asked = []
    real = sh.confirmed
    monkeypatch.setattr(sh, "confirmed", lambda pairs, sets: asked.append(pairs.count()) or real(pairs, sets))
    got = {r.doc_id for r in sh.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(sh, "confirmed", real)
    return got, sum(asked)


def test_comparisons_grow_with_a_family_not_with_its_square(spark, monkeypatch):
    """Texts that share buckets but are no near copies: twice the texts, about twice the comparisons; all stay."""
    pairs = []
    for n in (200, 400, 800):
        rows = [(i, " ".join(t)) for i, t in enumerate(family(n, 7, edits=6))]
        got, asked = counted(spark, monkeypatch, rows)
        pairs.append(asked)
        sets = [shingles(t) for _, t in rows[:60]]
        assert not any(close(a, b) for i, a in enumerate(sets) for b in sets[:i]) and len(got) > 0.99 * n
    assert pairs[1] < 2.6 * pairs[0] and pairs[2] < 2.6 * pairs[1], pairs


def test_nodes_without_pairs_are_not_joined(spark, monkeypatch):
    """Of a family that stays apart most nodes hold one member; only the others meet their members again."""
    sizes = {}
    real = sh.Workspace.save

    def save(self, df, name):
        out = real(self, df, name)
        sizes[name] = out.count() if name in ("nodes", "placed") else None
        return out

    monkeypatch.setattr(sh.Workspace, "save", save)
    rows = [(i, " ".join(t)) for i, t in enumerate(family(200, 7, edits=6))]
    sh.survivors(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 0 < sizes["placed"] < 0.7 * sizes["nodes"], sizes


def test_bk_trees_link_forms_without_a_shared_bucket(spark):
    """Fingerprints alone bring near copies together; sets below the bound stay apart, whatever their fingerprints."""
    words = [f"w{i}" for i in range(400)]
    copies = [words, words[:-1] + ["x"], ["y"] + words[1:], [f"z{i}" for i in range(400)]]
    sets = {sh.form_of(s): s for s in (sh.shingle_set(" ".join(w).encode()) for w in copies)}
    prints = [sh.majority_bits([s]) for s in sets.values()]
    assert max((prints[0] ^ p).bit_count() for p in prints[:3]) <= 4
    a, b, c, far = sets
    prints[3] = prints[0] ^ 1
    forms = spark.createDataFrame([(f, p, []) for f, p in zip(sets, prints)], "form long, fp long, buckets array<long>")
    members = spark.createDataFrame([(f, s.tobytes()) for f, s in sets.items()], "form long, members binary")
    got = {(r.u, r.v) for r in sh.links(sh.Workspace(spark), forms, lambda wanted: members.join(wanted, "form", "left_semi")).collect()}
    assert {x for pair in got for x in pair} == {a, b, c} and far not in {x for pair in got for x in pair}


def test_recall_of_planted_pairs_at_the_bound(spark):
    """Pairs at similarity 0.8 to 0.85, alone and inside a large family that shares their buckets."""
    rng = random.Random(3)

    def partner(t):
        out = list(t)
        while True:
            trial = list(out)
            trial[rng.randrange(len(t))] = f"p{rng.randrange(10**9)}"
            a, b = shingles(" ".join(t)), shingles(" ".join(trial))
            if not close(a, b):
                return out
            out = trial

    alone = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(300)]
    crowd = family(600, 8, edits=6)
    rows, pairs = [], []
    for t in alone + crowd[:300]:
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(partner(t)))]
    rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(crowd[300:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = {r.key: r.component for r in sh.near_groups(docs).collect()}
    found = [heads[a] == heads[b] for a, b in pairs]
    print("recall alone", sum(found[:300]) / 300, "in a family", sum(found[300:]) / 300)
    assert sum(found[:300]) >= 297 and sum(found[300:]) >= 270


def test_empty_table(spark):
    assert sh.survivors(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted_forms(spark, words, prints):
    """Forms without buckets, with the given fingerprints, and their sets."""
    sets = {sh.form_of(s): s for s in (sh.shingle_set(" ".join(w).encode()) for w in words)}
    forms = spark.createDataFrame([(f, p, []) for f, p in zip(sets, prints)], "form long, fp long, buckets array<long>")
    members = spark.createDataFrame([(f, s.tobytes()) for f, s in sets.items()], "form long, members binary")
    return list(sets), forms, lambda wanted: members.join(wanted, "form", "left_semi")


def test_every_pair_within_the_radius_is_compared(spark):
    """Near copies are linked though each lies within the radius of a third text, too, which is no copy of either."""
    base = [f"w{i}" for i in range(200)]
    copies = [base, [*base[:-1], "x"], [*base[:-2], "y", "z"]]
    others = [[f"{c}{i}" for i in range(200)] for c in "abcdef"]
    for prints in ([7] * 9, [1 << k for k in range(9)]):
        forms, table, sets_of = planted_forms(spark, others[:3] + copies + others[3:], prints)
        heads = {r.u: r.v for r in sh.component_heads(sh.Workspace(spark), sh.links(sh.Workspace(spark), table, sets_of)).collect()}
        assert {x for x in forms if x in heads or x in heads.values()} == set(forms[3:6]), prints


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """Spark reckons a table after an explode as large as before; such a one must not go through the driver."""
    plans = {}
    real = sh.Workspace.save

    def save(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(sh.Workspace, "save", save)
    rows = [(i, " ".join(t)) for i, t in enumerate(family(20, 7, edits=6))]
    sh.survivors(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert "strategy=merge" in plans["members"] and "strategy=merge" in plans["links"], plans["links"]
