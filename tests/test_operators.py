import itertools
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import plain_text as plain
from run_checker import Checker, Pair, best_assignment_weight, best_subset, consistent
from builders import inv, invs_df, txn, txns_df
from ledgerlink.plans import reconcile as rc
from ledgerlink.operators import assignment as asn, candidates as cand, decide, duplicates as dup, groups, linkage, scoring, tax
from ledgerlink.params import DEFAULT
from ledgerlink.session import Workspace


def crowd(seed=1, n=60):
    r = random.Random(seed)
    base = date(2026, 1, 1)
    i = [inv(f"INV-{k}", base + timedelta(days=r.randint(0, 200)), "Acme Traders", 100 + k, status=r.choice(["open", "open", "settled"]), merchant=r.choice("MMMN")) for k in range(n)]
    t = [txn(f"T{k}", base + timedelta(days=r.randint(0, 200)), 100 + k, "ACME", merchant=r.choice("MMMN")) for k in range(n)]
    return t, i


@pytest.mark.parametrize("tile_rows", [2, 7, 20_000])
def test_candidate_join_equals_brute_force_for_any_tile_size(spark, tile_rows):
    t, i = crowd()
    want = sorted(
        (a["txn_id"], b["invoice_id"]) for a in t for b in i
        if a["merchant_id"] == b["merchant_id"] and b["status"] == "open" and -7 <= (a["txn_date"] - b["invoice_date"]).days <= 60
    )
    got = cand.candidate_pairs(cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i)), tile_rows=tile_rows)
    assert sorted((r.txn_id, r.invoice_id) for r in got.select("txn_id", "invoice_id").collect()) == want


def test_window_edges(spark):
    i = [inv("I", "2026-03-01", "Acme", 10000)]
    t = [txn(f"T{d}", date(2026, 3, 1) + timedelta(days=d), 10000, "x") for d in (-8, -7, 0, 45, 60, 61, 65)]
    got = cand.candidate_pairs(cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i)))
    assert sorted(r.txn_id for r in got.collect()) == ["T-7", "T0", "T45", "T60"]


@pytest.mark.parametrize("tile_rows", [3, 20_000])
def test_duplicates_equal_brute_force(spark, tile_rows):
    r = random.Random(4)
    words = ["UPI-SHARMA-PAY", "UPI SHARMA PAY", "NEFT VERMA 01", "NEFT VERMA 02", "PART VERMA", "RENT"]
    t = [txn(f"T{k:03d}", date(2026, 1, 1) + timedelta(days=r.randint(0, 12)), r.choice([100, 200]), r.choice(words), r.choice(["credit", "credit", "debit"])) for k in range(90)]
    want = {}
    for a in t:
        earlier = sorted((b for b in t if (b["txn_date"], b["txn_id"]) < (a["txn_date"], a["txn_id"])), key=lambda b: (b["txn_date"], b["txn_id"]))
        first = next((b["txn_id"] for b in earlier if Checker([b, a], [], {}).copy_of_earlier(a)), None)
        if first:
            want[a["txn_id"]] = first
    got = dup.find_duplicates(cand.txn_view(txns_df(spark, t)), tile_rows=tile_rows)
    assert {r.txn_id: r.original_id for r in got.collect()} == want and want


def test_exclusion_order(spark):
    t = [
        txn("A", "2026-08-01", 5, "Refund", "debit"), txn("B", "2026-08-01", 10, "Bank interest"), txn("C", "2026-08-01", 50, "INTEREST"),
        txn("D", "2026-08-01", 50000, "Vendor payout"), txn("E", "2026-08-02", 50000, "Vendor payout"), txn("F", "2026-08-01", 150, "INTEREST"),
    ]
    v = cand.txn_view(txns_df(spark, t))
    got = {r.txn_id: r.excluded_as for r in cand.prepass(v, dup.find_duplicates(v)).collect()}
    assert got == {"A": "debit_transaction", "B": "noise_below_floor", "C": "noise_below_floor", "D": None, "E": "duplicate_detected", "F": None}


def test_rule_points_equal_the_plain_rules(spark):
    r = random.Random(8)
    names = ["Sharma Trading", "Kapoor Logistics", "Acme Pvt Ltd"]
    i = [inv(f"INV-{k}", date(2026, 1, 1) + timedelta(days=r.randint(0, 60)), r.choice(names), r.choice([1000, 1002, 1500]), r.choice([1000, 1100, 1500]), r.choice([0, 100]), ref=r.choice([None, "UTR123456", "UTR123"])) for k in range(15)]
    t = [txn(f"T{k}", date(2026, 1, 20) + timedelta(days=r.randint(0, 40)), r.choice([998, 1000, 976.4, 1500]), r.choice(["UPI/SHARMA TRADING", "KAPO", "pay INV-3", "ACME PVT"]), channel=r.choice(["UPI", "NEFT"]), ref=r.choice([None, "UTR123456", "utr12345678", "UTR123"])) for k in range(25)]
    by_t, by_i = {x["txn_id"]: x for x in t}, {x["invoice_id"]: x for x in i}
    got = scoring.fuzzy_points(scoring.rule_points(cand.candidate_pairs(cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i)))))
    n = 0
    for x in got.collect():
        pair = Pair(by_t[x.txn_id], by_i[x.invoice_id])
        assert (x.p1, x.p1_amount) == (pair.by_rules, pair.money_agrees)
        assert (x.f_name, x.f_amount, x.f_date) == pair.fuzzy_points
        n += 1
    assert n > 50


def test_relevant_names_equal_brute_force(spark):
    r = random.Random(2)
    names = ["Sharma Trading", "LTD", "Verma, Singh and Sons", "Old Bolt Co", "AB", "Mehta Suppliers Pvt Ltd", "The Group"]
    texts = ["UPI/SHARMA", "NEFT-SHARMA TRADING SETTLED", "LTD", "PVT LTD MEHTA", "SINGH", "OLD BLT CO", "CO OLD", "THE GROUPS", "SHRMA TRADNG", "AB CD", "XX", "VERMA SONS AND", "pay INV-3"]
    i = [inv(f"INV-{k}", "2026-01-01", n, 100, merchant=m) for k, (n, m) in enumerate(itertools.product(names, "MN"))]
    t = [txn(f"T{k}", "2026-01-01", 100, x, merchant=r.choice("MN")) for k, x in enumerate(texts * 3)]
    want = {(m, n.upper(), x.upper()) for n in names for m, x in {(y["merchant_id"], y["narration"]) for y in t} if "INV-" not in x and consistent(x, n)}
    for size in (2, 4000):
        got = groups.relevant_names(cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i)), tile_rows=size).collect()
        assert {(g.merchant_id, g.cp, g.narr) for g in got} == want and len(got) == len(want)


def test_best_subset_equals_brute_force():
    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 9)
        am, gp, ok = [r.choice([100, 200, 300, 500]) * 100 for _ in range(n)], [r.randint(0, 5) for _ in range(n)], [r.random() < 0.7 for _ in range(n)]
        target = r.choice([300, 500, 800, 1000]) * 100
        want = best_subset([a / 100 for a in am], target / 100, gp, ok)
        sols, valid, picks = groups.best_subset(am, gp, ok, target, 200)
        assert (want is None and picks is None) or (list(want.members) == picks and want.preferred == valid <= sols)


def test_pool_of_sixteen_is_searched():
    sols, valid, picks = groups.best_subset([500000] * 16, [0] * 16, [True] * 16, 8 * 500000, 200)
    assert sols == valid == 12870 and picks == list(range(8))


def test_partial_pick(spark):
    df = spark.createDataFrame(
        [(1000000, [("a", 600000, True), ("b", 600000, True), ("c", 900000, False), ("d", 1000000, True)])],
        "target_p bigint, members array<struct<id:string,amount_p:bigint,name_ok:boolean>>",
    )
    assert df.select(groups.partial_pick().alias("x")).first().x.id == "a"


def test_leading_pairs_equal_the_full_ranking(spark):
    """Few names and amounts, so that many pairs are close to the bar and some transactions are settled by rules."""
    r = random.Random(9)
    names = ["Sharma Trading", "Sharma Traders", "Kapoor Logistics", "Verma", "LTD"]
    i = [inv(f"INV-{k}", date(2026, 1, 1) + timedelta(days=r.randint(0, 50)), r.choice(names), r.choice([1000, 1010, 1500]), ref=r.choice([None, "UTR1", "UTR2"])) for k in range(40)]
    t = [txn(f"T{k}", date(2026, 1, 10) + timedelta(days=r.randint(0, 50)), r.choice([1000, 1010, 990, 1500]), "NEFT " + r.choice([*names, "", "SHRMA TRDING"]).upper(), ref=r.choice([None, "UTR1"])) for k in range(60)]
    p = scoring.rule_points(cand.candidate_pairs(cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i))))
    none = F.lit(None).cast("double")
    want = scoring.rank_pairs(scoring.fuzzy_points(p).withColumn("sim", none).withColumn("s_vec", none), DEFAULT.with_(enable_embedding=False))
    cols = ["txn_id", "invoice_id", "rank", "score", "resolved", "f_name"]
    for k in (1, 2, 5):
        got = sorted(map(tuple, scoring.leading_pairs(p, k).select(*cols).collect()))
        assert got == sorted(map(tuple, want.where(F.col("rank") <= k).select(*cols).collect()))


def test_name_index_loses_no_pair(spark):
    """Names and texts close to the bound, of many lengths, against all pairs; and what the index looks at instead."""
    r = random.Random(12)
    words = ["SHARMA", "TRADING", "TRADNG", "LTD", "CO", "KAPOOR", "KAPUR", "LOGISTICS", "A", "AB", "PAYMENT", "NEFT", "É", "GROUP", "GRP", "VERMA", "SONS", "&", "SHARMATRADING"]
    pick = lambda n: " ".join(r.choice(words) for _ in range(n))
    blur = lambda s: "".join(c for c in s if r.random() > 0.12)
    names = sorted({pick(r.randint(1, 4)) for _ in range(60)})
    texts = sorted({t for n in names for t in (n, blur(n), pick(1) + " " + blur(n), pick(r.randint(1, 6)))} | {"X", "AB", ""})
    t = [txn(f"T{k}", "2026-01-05", 10, x, merchant="M") for k, x in enumerate(texts)]
    i = [inv(f"I{k}", "2026-01-05", n, 10, merchant="M") for k, n in enumerate(names)]
    tv, iv = cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i))
    got = {(x.cp, x.narr) for x in groups.relevant_names(tv, iv, tile_rows=25).collect()}
    seen = {(x["cp"], x["narr"]) for x in iv.select("cp").crossJoin(tv.where("trim(narr) <> '' and size(ids) = 0").select("narr")).collect()}
    assert got == {(n, x) for n, x in seen if consistent(x, n)}
    asked = groups.relevance_candidates(tv, iv).where("via = 'words'").select("cp", "narr").distinct().count()
    assert 0 < asked < len(seen) / 2


def random_claims(r, n, cells=2):
    """Credits with priorities, some claimed by others."""
    return [(f"M{r.randrange(cells)}", f"T{k}", -r.choice([100, 100, 250, 400, r.randrange(1000)]), date(2026, 1, r.randint(1, 9))) for k in range(n)]


def test_claims_are_counted_as_of_a_priority(spark):
    r = random.Random(6)
    asking, claims = random_claims(r, 80), random_claims(r, 70)
    claims += asking[:10]  # equal priorities do not count
    schema = "key string, id string, neg bigint, day date"
    got = rc.counted_before(spark.createDataFrame(asking + asking[:5], schema), spark.createDataFrame(claims, schema), ["key"], "n").collect()
    want = {(k, i): sum(c[0] == k and (c[2], c[3], c[1]) < (neg, day, i) for c in claims) for k, i, neg, day in asking}
    assert {(x.key, x.id): x.n for x in got} == want and len(got) == len(want)


def test_last_free_holds_every_small_pool(spark):
    """As of any priority, a pool of at most ``cap`` free credits lies within the offered rows."""
    r = random.Random(8)
    rows = [(k, i, None if r.random() < 0.1 else (neg, day, "c" + i)) for k, i, neg, day in random_claims(r, 90)]
    df = spark.createDataFrame(rows, "key string, txn_id string, _ct struct<neg:bigint,day:date,id:string>")
    offered = {(x.key, x.txn_id) for x in rc.last_free(df, ["key"], 12).collect()}
    small = 0
    for me in random_claims(r, 60):
        pool = {(k, i) for k, i, c in rows if k == me[0] and (c is None or c >= (me[2], me[3], me[1]))}
        if len(pool) <= 12:
            small += 1
            assert pool <= offered
    assert small > 10 and all(sum(k == c for c, _ in offered) <= 12 for k in ("M0", "M1"))


def test_split_pools_grow_with_the_input(spark):
    """One merchant, one name, nearly all credits claimed: twice the credits, twice the rows, not four times."""
    sizes = []
    for n in (1_000, 2_000):
        t = [txn(f"T{k:05d}", "2026-01-05", 100 + k % 37, "NEFT ACME BOLTS", merchant="M") for k in range(n)]
        tv, iv = cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, [inv("INV-1", "2026-01-04", "Acme Bolts", 500, merchant="M")]))
        ws = Workspace(spark)
        pools = rc.build_pools(ws, tv, iv, DEFAULT)
        sized = rc.with_pool_size(iv, pools).select("n_pool", "n_credits", "invoice_date", "row_idx", "net_p", "cp", F.col("invoice_id"), F.col("invoice_id").alias("inv_u"), "merchant_id", "batch_id")
        base = tv.select("batch_id", "merchant_id", "txn_id", "amount_p", "txn_date").join(sized, ["batch_id", "merchant_id"]).withColumn("gap", F.lit(1)).withColumn("rel", F.lit(True))
        # All but ten credits are claimed, each by itself.
        ct = tv.where(F.col("txn_id") >= "T00010").select("batch_id", "merchant_id", "txn_id", F.struct((-F.col("amount_p")).alias("neg"), F.col("txn_date").alias("day"), F.col("txn_id").alias("id")).alias("_ct"))
        left = ws.save(rc.pool_modes(base, pools, ct, 16), "left")
        members = ws.save(rc.pool_members(left, pools, ct, 16), "members")
        assert left.count() == n and left.where("mode = 'own'").count() >= 6
        assert members.groupBy("txn_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] <= 16
        sizes.append(rc.last_free(pools.credits.join(ct, ["batch_id", "merchant_id", "txn_id"], "left"), ["batch_id", "merchant_id"], 16).count() + members.count())
    assert sizes[1] <= 2 * sizes[0] + 32, sizes


def edges_df(spark, rows):
    return spark.createDataFrame([("B", "M", t, i, float(s), k) for t, i, s, k in rows], "batch_id string, merchant_id string, txn_id string, invoice_id string, score double, keep boolean")


def weight(edges):
    e = {(t, i): s for t, i, s, _ in edges}
    return best_assignment_weight(e, {t for t, _ in e}, {i for _, i in e})


@pytest.mark.parametrize("limit,safe", [(50_000, 3), (50_000, 0), (0, 0)])
def test_assignment_is_optimal_in_every_mode(spark, limit, safe):
    """Whole components, safe pairs first, and (with limit 0) auction rounds alone."""
    r = random.Random(limit + safe)
    rows = [(f"t{a}", f"i{b}", r.choice([30, 29.9, 45.5, 92, 80, 82, round(r.uniform(30, 100), 2)]), False) for a in range(7 if limit else 4) for b in range(6 if limit else 3) if r.random() < 0.55]
    got = asn.assign(Workspace(spark), edges_df(spark, rows), solve_limit=limit, safe_rounds=safe).collect()
    s = {(t, i): w for t, i, w, _ in rows}
    assert len({g.txn_id for g in got}) == len({g.invoice_id for g in got}) == len(got)
    assert sum(round(s[g.txn_id, g.invoice_id] * 100) for g in got) == weight(rows)


def test_ties_fall_alike_on_every_path(spark):
    """Tied input: whole components, with safe pairs taken first or not, choose the same pairs, and prove them."""
    r = random.Random(2)
    rows = [(f"t{a}", f"i{b}", r.choice([50, 50, 60]), r.random() < 0.1) for a in range(9) for b in range(7) if r.random() < 0.6]
    rows += [(f"u{a}", f"v{b}", 50, False) for a in range(3) for b in range(2)]
    chosen = []
    for limit, safe in ((50_000, 2), (50_000, 0)):
        s = asn.solve(Workspace(spark), edges_df(spark, rows), solve_limit=limit, safe_rounds=safe)
        proof = asn.certificate(s).first()
        assert (proof.repeated, proof.violated, proof.negative, proof.gap) == (0, 0, 0, 0) and proof.edges == len(rows)
        chosen.append(sorted((p.txn_id, p.invoice_id) for p in s.pairs.collect()))
    assert all(c == chosen[0] for c in chosen), chosen


def test_certificate_rejects_a_worse_assignment(spark):
    rows = [("t1", "i1", 92.0, True), ("t1", "i2", 91.0, False), ("t2", "i1", 82.0, True), ("t2", "i2", 70.0, False)]
    s = asn.solve(Workspace(spark), edges_df(spark, rows), safe_rounds=0)
    worse = s.edges.where("txn_id = 't1' and invoice_id = 'i1' or txn_id = 't2' and invoice_id = 'i2'")
    assert asn.certificate(asn.Solution(s.edges, worse, s.duals, s.scale)).first().gap > 0
    assert asn.certificate(asn.Solution(s.edges, s.pairs, s.duals.limit(0), s.scale)).first().violated == 4
    twice = s.edges.where("txn_id = 't1'")
    assert asn.certificate(asn.Solution(s.edges, twice, s.duals, s.scale)).first().repeated == 1


def test_large_component_with_few_scores_ends(spark):
    """A component above the limit with three scores only, by auction rounds; with 3,000 payments it has 60,000 edges and ends too."""
    r = random.Random(4)
    n = 120
    rows = list({(f"t{a}", f"i{r.randrange(n)}"): 0 for a in range(n) for _ in range(12)})
    edges = edges_df(spark, [(t, i, r.choice([40, 60, 60, 80]), False) for t, i in rows])
    s = asn.solve(Workspace(spark), edges, solve_limit=1_000, safe_rounds=0)
    proof = asn.certificate(s).first()
    assert (proof.repeated, proof.violated, proof.negative, proof.gap) == (0, 0, 0, 0) and proof.pairs > 0.97 * n


def test_auction_ends_when_equal_payments_want_equal_invoices(spark):
    rows = [(f"t{a}", f"i{b}", 50.0, False) for a in range(3) for b in range(2)]
    got = asn.assign(Workspace(spark), edges_df(spark, rows), solve_limit=0, safe_rounds=0).collect()
    assert len(got) == 2 == len({g.txn_id for g in got}) == len({g.invoice_id for g in got})
    whole = asn.assign(Workspace(spark), edges_df(spark, rows)).collect()
    assert {(g.txn_id, g.invoice_id) for g in got} == {(g.txn_id, g.invoice_id) for g in whole}  # ties fall alike on both paths


def test_assignment_beats_greedy_and_keeps_ties(spark):
    greedy = [("t1", "i1", 92, True), ("t1", "i2", 91, False), ("t2", "i1", 82, True), ("t2", "i2", 70, False)]
    got = {(g.txn_id, g.invoice_id) for g in asn.assign(Workspace(spark), edges_df(spark, greedy)).collect()}
    assert got == {("t1", "i2"), ("t2", "i1")}
    tie = [("t1", "i1", 50, False), ("t1", "i2", 50, True), ("t2", "i1", 50, True), ("t2", "i2", 50, False)]
    got = {(g.txn_id, g.invoice_id) for g in asn.assign(Workspace(spark), edges_df(spark, tie)).collect()}
    assert got == {("t1", "i2"), ("t2", "i1")}


def test_components(spark):
    rows = [("a", "1", 50, False), ("b", "1", 50, False), ("b", "2", 50, False), ("c", "3", 50, False)] + [(f"p{k}", f"q{j}", 40, False) for k in range(12) for j in (k, k + 1)]
    e = edges_df(spark, rows).withColumn("w", F.lit(1).cast("bigint"))
    got = asn.with_component(Workspace(spark), e).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert sorted(g.n for g in got) == [1, 3, 24]


def linkage_row(spark, **kw):
    base = dict(amount_p=9000000, net_p=9000000, total_p=9000000, tds_p=0, gst_p=0, t_ref=None, i_ref=None, cp="ACME", narr="ACME", gap=2)
    base.update(kw)
    schema = "amount_p bigint, net_p bigint, total_p bigint, tds_p bigint, gst_p bigint, t_ref string, i_ref string, cp string, narr string, gap int"
    return linkage.signals(spark.createDataFrame([tuple(base.values())], schema)).withColumn("fs", linkage.linkage_score()).first().fs


def test_linkage_scores(spark):
    assert linkage_row(spark) == 98.72
    assert linkage_row(spark, tds_p=100) == 99.81
    assert linkage_row(spark, t_ref="A", i_ref="A", tds_p=1, gst_p=1) == 99.99
    assert linkage_row(spark, t_ref="A", i_ref="B", tds_p=1, gst_p=1, amount_p=1, cp="ZZZZ", narr="QQ", gap=90) == 0.08
    with pytest.raises(ValueError):
        linkage.Weights((("x", 0.2, 0.5),))


def test_weight_estimation_keeps_prior_when_unclear(spark):
    rows = [(True, True, True)] * 8 + [(True, False, None)] * 2 + [(False, False, True)] * 9 + [(False, True, True)]
    df = spark.createDataFrame(rows, "is_match boolean, g_reference_number boolean, g_amount_exact boolean")
    for f in linkage.FIELDS:
        if f"g_{f}" not in df.columns:
            df = df.withColumn(f"g_{f}", F.lit(None).cast("boolean"))
    got = {r.field: r for r in linkage.estimate(df).collect()}
    assert (got["reference_number"].m_prob, got["reference_number"].u_prob) == (9 / 12, 2 / 12)
    # Agreement among matches is no more likely than among the others, so the prior stays.
    assert not got["amount_exact"].updated and got["amount_exact"].m_prob == 0.88
    assert linkage.Weights.from_table(linkage.estimate(df)).rows[0][0] == "reference_number"


def test_gates_and_blend(spark):
    df = spark.createDataFrame([(92.0, False, False), (92.0, True, True), (92.0, False, True), (29.9, True, True), (60.0, True, True)], "s double, r boolean, f boolean")
    got = df.select(decide.gate(F.col("s"), F.col("r"), F.col("f")).alias("g")).withColumn("x", F.lit(1)).collect()
    assert [g.g for g in got] == [None, "human_review", "flagged", "hard_floor", None]
    one = spark.range(1).select(decide.final_score(F.lit(100.0), F.lit(85.31), None).alias("a"), decide.final_score(F.lit(70.0), None, F.lit(999.0)).alias("b")).first()
    assert round(one.a, 2) == 94.12 and one.b == 90.0


def test_embedding_pass_ranks_and_resolves(spark):
    """Seven unresolved pairs: points from similarity, the five most similar may resolve."""
    rows = [("B", "M", "T", f"I{k}", k, 60.0, True, 60.0, True, 1.0 - k * 0.05, k) for k in range(7)]
    df = spark.createDataFrame(rows, "batch_id string, merchant_id string, txn_id string, invoice_id string, row_idx int, p1 double, p1_amount boolean, p2 double, p2_amount boolean, sim double, gap int").withColumn("p1_amount", F.lit(False))
    got = scoring.rank_pairs(scoring.embedding_points(df)).orderBy("rank").collect()
    assert [g.score for g in got][:3] == [80.0, 78.0, 76.0]
    assert [g.resolved for g in got] == ["pass3_embedding"] * 5 + [None, None]


def test_tax_arithmetic(spark):
    df = spark.createDataFrame([(Decimal("999.99"), 18, True, "194J"), (Decimal("999.99"), 18, False, "194Q"), (Decimal("10.05"), 5, True, None)], "base_amount decimal(18,2), gst_rate int, intrastate boolean, tds_section string")
    a, b, c = tax.derive(df).collect()
    assert (a.cgst_amount, a.igst_amount, a.tds_amount) == (Decimal("90.00"), Decimal("0.00"), Decimal("100.00"))
    assert (b.igst_amount, b.tds_amount, b.expected_net_amount) == (Decimal("180.00"), Decimal("1.00"), Decimal("1178.99"))
    assert (c.cgst_amount, c.tds_amount) == (Decimal("0.25"), Decimal("0.00"))


def test_params_are_used_for_the_window(spark):
    i, t = [inv("I", "2026-03-01", "Acme", 100)], [txn("T", "2026-03-20", 100, "x")]
    p = DEFAULT.with_(window_back_days=10)
    assert cand.candidate_pairs(cand.txn_view(txns_df(spark, t)), cand.invoice_view(invs_df(spark, i), p), p).count() == 0
