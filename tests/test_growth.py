"""Steps that must grow with the rows, not with the pairs of rows."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from builders import inv, invs_df, txn, txns_df
from ledgerlink.operators import candidates as cand, scoring
from ledgerlink.params import DEFAULT
from ledgerlink.sources import driver_tables as dt

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_driver_tables_send_nothing_through_the_driver(spark):
    """Customers and parts grow with the orders; small enough ones were broadcast."""
    assert "Broadcast" not in plan(dt.invoices(spark, SMALL)).split("Physical Plan")[1]


def mixed(seed=4, n=70):
    """Rows with every signal, near and equal days, ties, and amounts that are not positive."""
    r = random.Random(seed)
    base = date(2026, 1, 1)
    names = ["Acme Traders", "Acme Steel", "Bolt Industries", "Red Bolt Pvt Ltd", "Ox", ""]
    refs = ["UTR000111222", "UTR000", "UTR000111", "UTR9", "ZZ0000001", None, None]
    amounts = [100, 101.5, 250, 250, 400, 97.64, 90]
    when = lambda: base + timedelta(days=r.randint(0, 130))
    i = [inv(f"INV-{k}", when(), r.choice(names), a, total=r.choice([a, a + 10, 400]), tds=r.choice([0, 10]), ref=r.choice(refs), status=r.choice(["open", "open", "settled"]), merchant=r.choice("MMMN")) for k in range(n) for a in [r.choice(amounts + [0, -5])]]
    words = ["ACME TRADERS", "ACME", "BOLT", "RED BOLT PVT LTD", "OX", "CASH", "INV-1", "INV-12", "INV-33", "STEEL"]
    t = [txn(f"T{k}", when(), r.choice(amounts + [0, -3]), "NEFT-" + " ".join(r.sample(words, 2)), channel=r.choice(["UPI", "NEFT"]), ref=r.choice(refs), merchant=r.choice("MMMN"), direction=r.choice(["credit", "debit"])) for k in range(n)]
    return t, i


def views(spark, t, i):
    return cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i))


def test_window_totals_equal_the_pairs_and_make_none(spark, monkeypatch):
    t, i = views(spark, *mixed())
    want = cand.candidate_pairs(t, i).groupBy("txn_id").agg(F.count("*"), F.min("gap"), F.sum("gap")).collect()
    got = cand.window_totals(t, i).groupBy("txn_id").agg(F.sum("n"), F.min("nearest"), F.sum("gap_days")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 40
    monkeypatch.setattr(cand, "candidate_pairs", None)  # plain rows need no pairs
    t, i = t.where("amount_p > 0"), i.where("net_p > 0")
    assert cand.window_totals(t, i).count() > 40


def test_best_by_rules_equals_the_best_of_all_pairs(spark):
    from ledgerlink.operators import rule_search

    cols = ["merchant_id", "txn_id", "invoice_id", "p1", "resolved", "gap", "s_ref", "s_name", "s_amount", "s_formula"]
    seen = set()
    for seed in (4, 5):
        t, i = views(spark, *mixed(seed, 120))
        want = scoring.top_by_rules(scoring.rule_points(cand.candidate_pairs(t, i))).select(*cols).collect()
        got = rule_search.best_by_rules(t, i).select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 80
        seen |= {(c, r[c]) for r in want for c in ("s_ref", "s_name", "s_amount", "s_formula")}
    assert {("s_ref", 20.0), ("s_ref", 35.0), ("s_ref", 40.0), ("s_name", 15.0), ("s_name", 35.0), ("s_amount", 35.0), ("s_formula", 22.0)} <= seen


def test_pairs_by_txn_are_the_pairs_and_ranking_shuffles_none(spark):
    t, i = views(spark, *mixed(6, 90))
    cols = ["merchant_id", "txn_id", "invoice_id", "gap", "p1"]
    pairs = scoring.rule_points(cand.pairs_by_txn(t, i, tile_rows=7))
    want = scoring.rule_points(cand.candidate_pairs(t, i)).select(*cols).collect()
    assert sorted(map(tuple, pairs.select(*cols).collect())) == sorted(map(tuple, want)) and len(want) > 200
    none = F.lit(None).cast("double")
    ranked = scoring.rank_pairs(pairs.withColumn("p2", F.col("p1")).withColumn("p2_amount", F.col("p1_amount")).withColumn("sim", none).withColumn("s_vec", none))
    shuffles = lambda df: plan(df).split("Physical Plan")[1].count("Exchange hashpartitioning")
    assert "Window" in plan(ranked) and shuffles(ranked) == shuffles(pairs) > 0


def test_similarity_of_rows_with_vectors_equals_that_of_pairs(spark):
    t, i = views(spark, *mixed(7, 40))
    v = lambda df, key: df.select("batch_id", key).dropDuplicates().where(F.crc32(key) % 4 > 0).withColumn("vector", F.array(*[(F.crc32(key) % n).cast("double") for n in (3, 5, 7)]))
    tv, iv = v(t, "txn_id"), v(i, "invoice_id")
    cols = ["merchant_id", "txn_id", "invoice_id", "sim"]
    want = scoring.with_similarity(cand.candidate_pairs(t, i), tv, iv).select(*cols).collect()
    pairs = cand.pairs_by_txn(scoring.with_vectors(t, tv, "txn_id", "t"), scoring.with_vectors(i, iv, "invoice_id", "i"))
    got = scoring.similarity(pairs).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.sim is None for r in want} == {True, False}


def test_available_totals_equal_the_available_pairs_and_make_none(spark, monkeypatch):
    from ledgerlink.plans import reconcile as full

    t, i = views(spark, *mixed(8, 90))
    who = ["batch_id", "merchant_id"]
    near = t.where("direction = 'credit'").select(*who, F.regexp_extract("txn_id", r"(\d+)", 1).cast("int").alias("k"), (-F.col("amount_p")).alias("neg"), F.col("txn_date").alias("day"), F.col("txn_id").alias("id")).where("k % 2 = 0")
    own = i.select(*who, "invoice_id", F.substring("invoice_id", 5, 9).cast("int").alias("k"))
    ci = near.join(own, [*who, "k"]).select(*who, F.lit("i").alias("kind"), F.col("invoice_id").alias("item"), "neg", "day", "id")
    ct = near.select(*who, F.lit("t").alias("kind"), F.concat(F.lit("T"), F.col("k") + 3).alias("item"), "neg", "day", "id")
    claims = ci.unionByName(ct)
    want = full.available(cand.candidate_pairs(t, i), claims).groupBy("merchant_id").agg(F.count("*"), F.countDistinct("invoice_id")).collect()
    every = cand.candidate_pairs(t, i).count()
    got = full.available_totals(t, i, claims, DEFAULT).select("merchant_id", "pairs", "invoices")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and 0 < sum(r[1] for r in want) < every
    monkeypatch.setattr(cand, "candidate_pairs", None)  # plain rows need no pairs
    assert full.available_totals(t.where("amount_p > 0"), i.where("net_p > 0"), claims, DEFAULT).count() == 2
    monkeypatch.undo()
    t, i = t.where("amount_p > 0"), i.where("net_p > 0")
    held = i.withColumnRenamed("invoice_id", "item").join(ci.select(*who, "item", F.struct("neg", "day", "id").alias("_ci")), [*who, "item"]).withColumnRenamed("item", "invoice_id")
    assert full.held_pairs(t, held, DEFAULT, 5).agg(F.sum("pairs")).first() == full.held_pairs(t, held, DEFAULT).agg(F.sum("pairs")).first()


def test_agreement_counts_equal_the_pairs_and_make_none(spark, monkeypatch):
    from ledgerlink.operators import linkage

    t, i = mixed(9, 100)
    # Narrations that differ in digits, some so that the order of their words would change; a merchant with digits in a name.
    t += [txn(f"D{k}", date(2026, 1, 5 + k), 77, n, merchant=m) for k, n in enumerate(["ACME INV-12 INV-34", "ACME INV-15 INV-34", "ACME INV-34 INV-12", "BOLT 9 IN", "BOLT 8 IN", "RED 7 BOLT"]) for m in "MN"]
    i += [inv("INV-900", date(2026, 1, 6), "Acme Inv-12 Ltd", 77, merchant="N"), inv("INV-901", date(2026, 1, 6), "Red 7 Bolt", 70, merchant="N")]
    t, i = views(spark, t, [{**x, "cgst_amount": x["total_amount"] * (k % 2)} for k, x in enumerate(i)])
    event = lambda df, key: df.withColumn("event", F.regexp_extract(key, r"(\d+)", 1))
    signals = linkage.signals(cand.candidate_pairs(event(t, "txn_id").withColumnRenamed("event", "te"), event(i, "invoice_id").withColumnRenamed("event", "ie")))
    want = signals.agg(*linkage._side_counts()).collect()
    assert linkage.agreement_counts(t, i).collect() == want and min(want[0]) > 0
    labelled = linkage.estimate(signals.withColumn("is_match", F.col("te") == F.col("ie"))).collect()
    assert linkage.estimate_from_rows(event(t, "txn_id"), event(i, "invoice_id"), ["event"]).collect() == labelled
    monkeypatch.setattr(cand, "candidate_pairs", None)  # plain rows need no pairs
    plain = linkage.agreement_counts(t.where("amount_p > 0"), i.where("net_p > 0")).first()
    assert 0 < plain["a_name_weak"] < plain["c_name_weak"]


def test_texts_with_other_digits_share_their_scores(spark):
    from ledgerlink.operators import text_scores

    texts = ["A 12 B", "A 34 B", "A 12 34", "A 34 12", "A 1 1", "A 1 2"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(text_scores.shape(F.col("x"))).collect()]
    assert got == ["A 00 B", "A 00 B", "A 12 34", "A 34 12", "A 0 0", "A 1 2"]


def test_name_counts_do_not_depend_on_chunks_and_blocks(spark):
    from ledgerlink.operators import text_scores

    t, i = views(spark, *mixed(10, 80))
    t, i = t.where("amount_p > 0"), i.where("net_p > 0")
    want = text_scores.name_counts(t, i).collect()
    assert text_scores.name_counts(t, i, classes=3, names=2, texts=2).collect() == want and want[0].weak > want[0].strong > 0


def test_scored_pairs_equal_the_ratios_of_pairs_without_python_on_pairs(spark):
    from ledgerlink.functions import fuzzy, scalars as fx
    from ledgerlink.operators import linkage, text_scores

    t, i = views(spark, *mixed(11, 60))
    cols = ["merchant_id", "txn_id", "invoice_id"]
    names = [F.col(f"g_{f}") for f in ("name_strong", "name_weak")]
    want = linkage.signals(cand.candidate_pairs(t, i)).select(*cols, *names, "cp", "narr").withColumn("f", fuzzy.name_ratio_scores()("cp", fx.strip_channel(F.col("narr")))["points"]).drop("cp", "narr").collect()
    for sizes in ({}, {"names": 2, "texts": 3}):
        pairs = text_scores.scored_pairs(t, i, **sizes)
        assert "Python" not in plan(linkage.signals(pairs)) and "InPandas" not in plan(pairs)
        got = linkage.signals(pairs).select(*cols, *names)
        assert sorted(map(tuple, got.collect())) == sorted(r[:-1] for r in map(tuple, want)) and len(want) > 100
    points = text_scores.scored_pairs(t, i, text_scores.points, fx.strip_channel).select(*cols, F.col("name_score") / 100)
    assert sorted(map(tuple, points.collect())) == sorted(r[:3] + r[-1:] for r in map(tuple, want)) and any(r[-1] > 0 for r in want)


def test_amount_and_formula_pairs_equal_those_of_all_pairs(spark):
    t, i = views(spark, *mixed(12, 110))
    cols = ["merchant_id", "txn_id", "invoice_id", "gap", "k_amount", "s_amount", "k_formula", "s_formula"]
    every = [tuple(r) for r in scoring.with_amount_points(cand.candidate_pairs(t, i)).select(*cols).collect()]
    kinds = set()
    for make, points in ((scoring.amount_pairs, 5), (scoring.formula_pairs, 7)):
        want = [r for r in every if r[points] > 0]
        got = make(t, i)
        assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
        assert "_key" in plan(got).split("Physical Plan")[1].split("SortMergeJoin")[1].split("Inner")[0]
        kinds |= {r[points - 1] for r in want}
    assert kinds == {"exact", "gross", "tds", "gateway"}


def test_reference_pairs_equal_those_of_all_pairs(spark):
    from ledgerlink.operators import rule_search

    t, i = views(spark, *mixed(13, 130))
    cols = ["merchant_id", "txn_id", "invoice_id", "gap", "s_ref"]
    want = scoring.rule_points(cand.candidate_pairs(t, i)).where("s_ref > 0").select(*cols).collect()
    made = rule_search.reference_pairs(t, i).select(*cols)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want)) and {r.s_ref for r in want} == {20.0, 35.0, 40.0}
    every = [part.split("Inner")[0] for part in plan(made).split("Physical Plan")[1].split("SortMergeJoin")[1:] if "_bucket" in part.split("Inner")[0]]
    assert every and all("_key" in part or "_gl" in part for part in every)


def test_derived_tables_are_written_when_asked_for(spark, tmp_path):
    for name in ("customer", "part", "orders"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    got = dt.inputs(spark, str(tmp_path))
    assert got["transactions"].count() > 0 and set(got) == {"invoices", "transactions"}
    assert got["labels"].count() == got["invoices"].count() and dt.inputs(spark, str(tmp_path)) is got


def test_window_totals_neither_explode_nor_join_days(spark):
    """A window has some hundred days; rows that are written out a day each were sized as before and broadcast."""
    t, i = cand.txn_view(txns_df(spark, [txn("T1", "2026-08-02", 1000, "A")])), cand.invoice_view(invs_df(spark, [inv("I1", "2026-08-01", "A", 1000)]))
    plan = cand.window_totals(t, i)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("strategy=merge") == 1 == plan.count("Join Inner"), plan


def test_window_totals_at_the_ends_of_the_window(spark):
    near, far = DEFAULT.window_back_days, DEFAULT.window_forward_days
    day = date(2026, 8, 1)
    days = [-near - 1, -near, -3, -3, 0, 2, far, far + 1]
    i = cand.invoice_view(invs_df(spark, [inv(f"I{k}", str(day + timedelta(d)), "A", 1000) for k, d in enumerate(days)]))
    t = cand.txn_view(txns_df(spark, [txn("T1", str(day), 1000, "A"), txn("T2", str(day + timedelta(1)), 1000, "A")]))
    got = {r.txn_id: (r.n, r.nearest, r.gap_days) for r in cand.window_totals(t, i).collect()}
    gaps = {x: [abs(d - s) for d in days if -near <= d - s <= far] for x, s in (("T1", 0), ("T2", 1))}
    assert got == {x: (len(g), min(g), sum(g)) for x, g in gaps.items()}


def test_rare_references_bound_the_keys(spark, monkeypatch):
    """A payment whose reference finds its invoice looks up few keys; one that many invoices share is still found by its keys."""
    from ledgerlink.operators import rule_search

    i = [inv(f"INV-{k}", f"2026-08-{1 + k % 20:02d}", f"Sharma{k % 3} Trading{k % 2} House", 1000 + k % 4, ref=f"UTR{k:06d}" if k % 5 else "SHARED01") for k in range(40)]
    t = [txn(f"T{k}", f"2026-08-{3 + k % 20:02d}", 1000 + k % 4, f"NEFT SHARMA{k % 3} TRADING{k % 2} HOUSE", ref=f"UTR{k:06d}" if k % 5 else "SHARED01") for k in range(40)]
    t, i = cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i))
    assert i.where("i_ref = 'SHARED01'").count() > rule_search.RARE
    asks, real = {}, rule_search.Workspace.save

    def save(self, df, name):
        out = real(self, df, name)
        asks.update({r.txn_id: r["count"] for r in out.groupBy("txn_id").count().collect()} if name == "asks" else {})
        return out

    monkeypatch.setattr(rule_search.Workspace, "save", save)
    cols = ["txn_id", "invoice_id", "p1", "resolved", "gap", "s_ref"]
    got = rule_search.best_by_rules(t, i).select(*cols).collect()
    want = scoring.top_by_rules(scoring.rule_points(cand.candidate_pairs(t, i))).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 40
    assert 0 < asks["T1"] < asks["T0"] / 2, asks
