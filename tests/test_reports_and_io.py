import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from builders import inv, invs_df, txn, txns_df
from ledgerlink import schemas
from ledgerlink.operators import adjudicate, calibrate, evaluate, forensics, report, review
from ledgerlink.params import DEFAULT
from ledgerlink.plans import reconcile as rc
from ledgerlink.plans.rules_run import rules_run
from ledgerlink.sources import csv_ingest as csvs, store
from ledgerlink.streaming import live


def match(mid, band, txns, invs, score=90.0, pending=False, amount="100.00", category=None):
    items = [(t, i, Decimal(amount)) for t in txns for i in invs] or [(t, None, Decimal(amount)) for t in txns]
    return (mid, "B", "R", "one_to_one", score, band, "text", "rules_engine", items, category, pending, None, None, None, None)


MATCH = ("match_id string, batch_id string, run_id string, match_type string, confidence_score double, confidence_band string, explanation_text string, explanation_source string,"
         "line_items array<struct<txn_id:string,invoice_id:string,allocated_amount:decimal(18,2)>>, exception_reason_category string, pending_llm_enrichment boolean, pending_llm_reason string,"
         "reviewed_by string, reviewed_at timestamp, review_action string")


def matches_df(spark, rows):
    return spark.createDataFrame(rows, MATCH)


def labels_df(spark, rows):
    return spark.createDataFrame([(i, t, ok, c, "B", k) for k, (i, t, ok, c) in enumerate(rows)], schemas.LABEL)


def test_csv_round(spark, tmp_path):
    p = tmp_path / "bank.csv"
    p.write_text('txn_id,date,amount,direction,narration,channel,reference_number\nT1,15-08-2026,"₹1,00,000",Credit,"A, B",UPI, \nT2,bad,10,,x,,\nT1,16-08-2026,5,credit,again,,\n,2026-08-15,7,debit,y,NEFT,R1\nT4,15-08-2026,-3,credit,z,,\nT5,15-08-2026,,credit,z,,\n', encoding="utf-8")
    parsed = csvs.parse_transactions(csvs.scan(spark, str(p), csvs.TXN_COLUMNS), "M", "B")
    good = csvs.good_rows(parsed, "txn_id").orderBy("row_idx").collect()
    assert [(g.txn_id[:4], g.amount, g.direction) for g in good] == [("T1", Decimal("100000.00"), "credit"), ("TXN-", Decimal("7.00"), "debit")]
    assert good[0].narration == "A, B" and good[0].reference_number is None and good[1].reference_number == "R1"
    bad = csvs.error_rows(parsed, "bank_csv").orderBy("row_idx").collect()
    assert [b.errors for b in bad] == [["Invalid date: 'bad'", "Invalid direction: ''"], ["Invalid amount: '-3'"], ["Invalid amount: ''"]]
    assert json.loads(bad[0].row)["txn_id"] == "T2"
    s = csvs.upload_summary(csvs.good_rows(parsed, "txn_id"), spark.range(3), csvs.error_rows(parsed, "bank_csv")).first()
    assert (s.txns_loaded, s.invoices_loaded, s.errors) == (2, 3, 3)


def test_invoice_and_label_csv(spark, tmp_path):
    p = tmp_path / "inv.csv"
    p.write_text("invoice_id,invoice_date,counterparty_name,base_amount,total_amount,expected_net_amount,tds_rate\nI1,01-08-2026,Acme,100,118,0,0\nI2,01-08-2026,Acme,100,118,108,10\nI3,01-08-2026,Acme,,118,,\n")
    parsed = csvs.parse_invoices(csvs.scan(spark, str(p), csvs.INVOICE_COLUMNS), "M", "B")
    a, b = csvs.good_rows(parsed, "invoice_id").orderBy("invoice_id").collect()
    assert (a.expected_net_amount, a.status, a.cgst_amount, a.tds_rate) == (Decimal("118.00"), "open", Decimal("0.00"), None)
    assert b.expected_net_amount == Decimal("108.00") and b.tds_rate == Decimal("10")
    assert csvs.error_rows(parsed, "invoice_csv").count() == 1
    q = tmp_path / "gt.csv"
    q.write_text('invoice_id,txn_ids,is_true_match\nI1,"T1, T2,",Yes\nI2,,no\n')
    x, y = csvs.parse_labels(csvs.scan(spark, str(q), csvs.LABEL_COLUMNS), "B").orderBy("invoice_id").collect()
    assert (x.txn_ids, x.is_true_match, x.case_category) == (["T1", "T2"], True, "clean") and (y.txn_ids, y.is_true_match) == ([], False)


def test_store_is_idempotent_and_falls_back(spark, tmp_path):
    path = str(tmp_path / "m")
    m = matches_df(spark, [match("a", "review", ["T"], ["I"])])
    store.write_run(m, path)
    store.write_run(matches_df(spark, [match("b", "review", ["T"], ["I"])]).withColumn("run_id", F.lit("R2")), path)
    store.write_run(m, path)
    all_rows = spark.read.schema(m.schema).parquet(path)
    assert all_rows.count() == 2
    assert {r.match_id for r in store.run_or_batch(all_rows, "B", "R2").collect()} == {"b"}
    assert {r.match_id for r in store.run_or_batch(all_rows, "B", "none").collect()} == {"a", "b"}
    assert store.read_keys(spark, path, batch_id="B", run_id="R").count() == 1


def test_event_outcomes(spark):
    labels = labels_df(spark, [("I1", ["T1"], True, "1"), ("I2", ["T2", "T3"], True, "4"), ("I3", ["T4"], True, "5"), ("I4", ["T4"], True, "5"), ("I5", ["T5"], True, "1"), ("I6", ["T6"], True, "8"), ("I7", [], False, "13")])
    m = matches_df(spark, [
        match("a", "auto_accept", ["T1"], ["I1"]), match("b", "auto_accept", ["T3", "T2"], ["I2"]), match("c", "auto_accept", ["T4"], ["I3", "I4"]),
        match("d", "auto_accept", ["T5"], ["I7"], amount="68000.00"), match("e", "review", ["T6"], ["I6"]), match("f", "auto_accept", ["T1"], ["I1"], amount="7.00"),
    ])
    out = evaluate.outcomes(m, labels)
    o = evaluate.overall(out).first()
    assert (o.tp, o.fp, o.fn, o.review_tp, o.fp_rupee_cost) == (3, 2, 1, 1, Decimal("68007.00"))
    assert (o.precision, o.recall) == (0.6, 0.75) and o.f1 == round(2 * 0.6 * 0.75 / 1.35, 4)
    cat = {r.category: (r.tp, r.fp, r.fn, r.review_tp) for r in evaluate.by_category(out).collect()}
    assert cat == {"1": (1, 1, 1, 0), "4": (1, 0, 0, 0), "5": (1, 0, 0, 0), "13": (0, 1, 0, 0), "8": (0, 0, 0, 1)}


def test_completeness(spark):
    m = matches_df(spark, [match("a", "reject", ["T"], [], category="x"), match("b", "reject", ["U"], [])])
    c = evaluate.exception_completeness(m).first()
    assert (c.with_reason, c.without_reason, c.completeness_pct) == (1, 1, 50.0) and c.warning


def calib(spark, ps, ys):
    return spark.createDataFrame([("k", float(p), y) for p, y in zip(ps, ys)], "g string, p double, y int")


def test_calibration_vectors(spark):
    assert calibrate.brier(calib(spark, [1, 0], [1, 0]), ["g"]).first().brier == 0
    assert calibrate.brier(calib(spark, [0.5, 0.5], [1, 0]), ["g"]).first().brier == 0.25
    assert calibrate.expected_error(calib(spark, [0.95] * 10, [1] * 5 + [0] * 5), ["g"]).first().ece == 0.45
    assert calib(spark, [0.6, 0.2, 1.0], [0, 0, 0]).select(calibrate.bin_of(F.col("p")).alias("b")).collect() == [(2,), (1,), (4,)]
    curve = calibrate.reliability_curve(calib(spark, [0.9], [1]), ["g"]).orderBy("bin").collect()
    assert [c.sample_count for c in curve] == [0, 0, 0, 0, 1] and curve[0].mean_confidence == 10.0


def test_isotonic_fit_is_monotone_and_pools(spark):
    rows = calib(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0, 0, 1, 0, 1, 1, 1])
    got = calibrate.apply_isotonic(rows, calibrate.fit_isotonic(rows)).orderBy("p").collect()
    assert [round(g.q, 6) for g in got] == [0, 0, 0.5, 0.5, 1, 1, 1]
    assert calibrate.fit_isotonic(calib(spark, [0.1, 0.9], [1, 1])) is None
    assert calibrate.report(rows, ["g"]).first().calibrated_brier <= calibrate.report(rows, ["g"]).first().raw_brier


def test_digit_forensics(spark):
    rows = [inv(f"I{k}", "2026-01-01", "Vendor A" if k < 5 else "Vendor B", 9000 + k if k < 5 else [100, 200, 300, 400, 500][k % 5]) for k in range(10)]
    i = invs_df(spark, rows)
    d = forensics.dominant_counterparties(i, ["batch_id"]).collect()
    assert [(x.counterparty_name, x.dominant_leading_digit, x.dominant_ratio) for x in d] == [("Vendor A", 9, 100.0)]
    fake = txns_df(spark, [txn(f"T{k}", "2026-01-01", 5000 if k < 80 else 9000, "x") for k in range(100)])
    t = forensics.digit_test(fake, F.col("amount"), ["batch_id"]).first()
    assert t.risk_level == "high" and t.n == 100
    few = forensics.digit_test(fake.limit(5), F.col("amount"), ["batch_id"]).first()
    assert (few.risk_level, few.p_value) == ("insufficient_data", 1.0)
    assert forensics.digit_distribution(fake, F.col("amount"), ["batch_id"]).count() == 9
    assert forensics.batch_risk(i, fake).first().overall_risk == "high"


def test_reports(spark):
    m = matches_df(spark, [match("m1", "auto_accept", ["T1", "T2"], ["I1"]), match("m2", "review", ["T3"], ["I9"], 60.0), match("m3", "reject", ["T4"], [], 0.0, category="x")])
    assert report.run_summary(m).first()[2:] == (3, 1, 1, 1)
    b = report.batch_metrics(m).first()
    assert (b.avg_confidence_score, b.auto_accept_rate, b.exception_rate) == (50.0, 33.3, 33.3)
    assert [r.match_id for r in report.search(m, "i9").collect()] == ["m2"] and report.search(m, None, "reject").count() == 1
    assert [r.match_id for r in report.page(m, 1, 1).collect()] == ["m2"]
    e = [json.loads(r.event) for r in report.as_events(m).orderBy("event").collect()]
    first = next(x for x in e if x["match_id"] == "m1")
    assert first["txn_id"] == "T1 + T2" and first["amount"] == "200.00" and first["invoices"] == ["I1"]
    assert report.breakdown(m).where("facet = 'confidence_band'").count() == 3


def test_reviews(spark):
    m = matches_df(spark, [match("m1", "auto_accept", ["T1"], ["I1"]), match("m2", "review", ["T2"], ["I2"]), match("m3", "reject", ["T3"], [])])
    ts = lambda n: datetime(2026, 1, 1, 0, 0, n)
    acts = spark.createDataFrame([("m1", "accepted", "r", "", ts(1)), ("m2", "accepted", "r", "fine", ts(1)), ("m2", "rejected", "q", "", ts(2)), ("m3", "rejected", "r", None, ts(1)), ("zz", "accepted", "r", "", ts(1))],
                                 "match_id string, action string, reviewer_id string, note string, acted_at timestamp")
    out, log, refused = review.apply_reviews(m, acts)
    assert {r.match_id: r.review_action for r in out.collect()} == {"m1": None, "m2": "accepted", "m3": "rejected"}
    assert {r.match_id for r in log.collect()} == {"m2", "m3"}
    assert {(r.match_id, r.refused_because) for r in refused.collect()} == {("m1", "match is already accepted"), ("m2", "match is already reviewed"), ("zz", "match not found")}
    again, _, no = review.apply_reviews(out, acts.where("match_id = 'm2'"))
    assert no.count() == 2


def test_retry(spark):
    m = matches_df(spark, [match("m1", "review", ["T1"], ["I1"], 70.0, True), match("m2", "reject", ["T2"], [], 0.0, True), match("m3", "review", ["T3"], ["gone"], 60.0, True), match("m4", "review", ["T1"], ["I1"], 60.0, True), match("m5", "review", ["T1"], ["I1"], 60.0)])
    t, i = txns_df(spark, [txn(f"T{k}", "2026-01-01", 10, "x") for k in (1, 2, 3)]), invs_df(spark, [inv("I1", "2026-01-01", "A", 10)])
    r = spark.createDataFrame([("m1", '{"assessment":"match","confidence_delta":999,"explanation":"fits"}', "groq"), ("m4", "nope", "groq")], "match_id string, reply string, provider string")
    out, log = adjudicate.retry_pending(m, t, i, r)
    got = {x.match_id: x for x in out.collect()}
    assert (got["m1"].confidence_score, got["m1"].confidence_band, got["m1"].pending_llm_enrichment, got["m1"].explanation_source) == (90.0, "auto_accept", False, "llm")
    assert not got["m2"].pending_llm_enrichment and not got["m3"].pending_llm_enrichment and got["m3"].pending_llm_reason
    assert got["m4"].pending_llm_enrichment and got["m4"].confidence_score == 60.0 and got["m5"].confidence_score == 60.0
    assert [x.match_id for x in log.collect()] == ["m1"] and adjudicate.pending(out).count() == 1


def test_replies_move_the_run(spark):
    i = invs_df(spark, [inv("INV-1", "2026-08-01", "Sharma Trading", 1000), inv("INV-2", "2026-08-01", "Sharma Trading", 1010)])
    t = txns_df(spark, [txn("T1", "2026-08-02", 1000, "NEFT SHARMA TRADING"), txn("T2", "2026-08-02", 900, "NEFT SHARMA TRADING X")])
    replies = spark.createDataFrame([("B", "T1", "INV-1", '{"assessment":"no_match","confidence_delta":-50,"explanation":"differs"}', "gemini")], "batch_id string, txn_id string, invoice_id string, reply string, provider string")
    moved = rc.reconcile(t, i, "R", replies=replies)
    got = {r.line_items[0].txn_id: r for r in moved.matches.collect()}
    # The reply is clipped to -20 on the heuristic score of 100: 0.6 * 80 + 0.4 * 98.72.
    assert got["T1"].confidence_score == pytest.approx(87.49) and got["T1"].explanation_source == "llm"
    assert got["T2"].pending_llm_enrichment and got["T2"].confidence_score > 90
    named = {(r.llm_provider, r.llm_model, r.llm_both_failed) for r in moved.audit.collect()}
    assert named == {("gemini", DEFAULT.gemini_model, False), (None, DEFAULT.groq_model, True), (None, None, False)}


def test_stream_feed_equals_batch_and_replays(spark, tmp_path):
    i = invs_df(spark, [inv("INV-1", "2026-08-01", "Sharma Trading", 1000)])
    t = txns_df(spark, [txn(f"T{k}", "2026-08-02", 1000 + k, "NEFT SHARMA TRADING") for k in range(6)] + [txn("D", "2026-08-02", 7000, "x", "debit")])
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new and leaves the sink as it is
        s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.start_feed(s, i, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = live.preliminary(t, i)
    assert sorted((r.txn_id, r.score, r.band) for r in got.collect()) == sorted((r.txn_id, r.score, r.band) for r in want.collect())
    assert {r.band: r.n for r in live.band_totals(got).collect()}["reject"] >= 1


def test_rules_run_and_catalog_names(spark):
    from ledgerlink.plans.catalog import QUERIES
    from ledgerlink.plans.oracle import ORACLE

    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 90
    m = rules_run(txns_df(spark, [txn("T", "2026-08-02", 1000, "NEFT SHARMA TRADING")]), invs_df(spark, [inv("INV-1", "2026-08-01", "Sharma Trading", 1000)]), "R").first()
    assert (m.confidence_score, m.confidence_band) == (100.0, "auto_accept")


def test_scan_reads_quoted_line_breaks_of_several_files_in_order(spark, tmp_path):
    """Random fields with quotes, commas and line breaks, in files of odd sizes and in splits of few bytes, as the csv module reads them."""
    import csv
    import random

    r = random.Random(11)
    piece = lambda: r.choice(["a", "bc", '"', ",", "\n", '""', " ", "é", '",', ',"', '\n"', "x\ny", '5" pipe'])
    want, names = [], []
    for f, n in enumerate((1, 57, 120)):
        path = tmp_path / f"part-{f}.csv"
        names.append(str(path))
        with open(path, "w", newline="") as out:
            w = csv.writer(out, lineterminator="\n")
            w.writerow(["txn_id", "amount", "narration"])
            for k in range(n):
                rows = ["".join(piece() for _ in range(r.choice([0, 1, 3, 9, 40]))).strip() for _ in range(2)]
                w.writerow([f"T{f}-{k}", *rows])
                want.append((f"T{f}-{k}", *(x or None for x in rows)))
            if f == 1:
                out.write('T1-end,5" wide,plain"ly\n\n')
                want.append(("T1-end", '5" wide', 'plain"ly'))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "90b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = csvs.scan(spark, names, csvs.TXN_COLUMNS).orderBy("row_idx").select("txn_id", "amount", "narration").collect()
            assert [tuple(x) for x in got] == want, size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rows_without_an_id_all_survive(spark):
    n = 200_000
    raw = spark.range(n).select(F.lit(None).cast("string").alias("txn_id"), F.lit("2026-01-05").alias("txn_date"), F.lit("10").alias("amount"), F.lit("same text").alias("narration"), F.col("id").alias("row_idx"))
    parsed = csvs.parse_transactions(csvs.with_columns_present(raw, csvs.TXN_COLUMNS), "M", "B")
    assert parsed.select("txn_id").distinct().count() < n  # eight digits meet in so many rows
    assert csvs.good_rows(parsed, "txn_id").agg(F.countDistinct("txn_id"), F.count("*")).first() == (n, n)


def test_made_ids_leave_given_ids_alone(spark):
    rows = [(None, str(k), k) for k in range(150)] + [(f"TXN-{k:x}", "7", 1000 + k) for k in range(0, 256, 2)] + [("TXN-a", "8", 2000)]
    raw = spark.createDataFrame(rows, "txn_id string, amount string, row_idx long").withColumn("txn_date", F.lit("2026-01-05"))
    read = lambda: csvs.good_rows(csvs.parse_transactions(csvs.with_columns_present(raw.where("amount <> '0'"), csvs.TXN_COLUMNS), "M", "B", id_digits=3), "txn_id")
    got = {x.row_idx: x.txn_id for x in read().collect()}
    assert len(set(got.values())) == len(got) == 149 + 128
    assert all(got[i] == t for t, _, i in rows if t and i < 2000) and 2000 not in got
    assert got == {x.row_idx: x.txn_id for x in read().collect()}


def test_feed_events_are_numbered_and_close_with_totals(spark):
    import json

    item = [("T", "I", Decimal("1.00"))]
    rows = [("B", f"R{k % 2}", f"MATCH-{k % 3}{k:07x}", band, 50.0, "one_to_one", item, "x") for k, band in enumerate(["auto_accept"] * 7 + ["review"] * 5 + ["reject"] * 2 + ["exception"])]
    schema = "batch_id string, run_id string, match_id string, confidence_band string, confidence_score double, match_type string, line_items array<struct<txn_id:string,invoice_id:string,allocated_amount:decimal(18,2)>>, explanation_text string"
    got = report.feed_events(spark.createDataFrame(rows, schema)).orderBy("run_id", "idx").collect()
    for run in ("R0", "R1"):
        mine = [json.loads(x.event) for x in got if x.run_id == run]
        bands = [x[3] for x in rows if x[1] == run]
        assert [e["idx"] for e in mine[:-1]] == list(range(1, len(bands) + 1)) and {e["total"] for e in mine} == {len(bands)}
        assert [e["match_id"] for e in mine[:-1]] == sorted(x[2] for x in rows if x[1] == run)
        assert mine[-1] == {"done": True, "total": len(bands), "auto_accept": bands.count("auto_accept"), "review": bands.count("review"), "exceptions": bands.count("reject") + bands.count("exception")}


def test_allocations_by_id(spark):
    d = Decimal
    rows = [("a", "batch_one_to_many", [("T", "I1", d("3.00")), ("T", "I2", d("4.00"))]), ("b", "split_many_to_one", [("T1", "I", d("1.00")), ("T2", "I", d("2.00")), ("T1", "I", d("5.50"))]), ("c", "exception", [("T", None, None)]), ("d", "one_to_one", [])]
    df = spark.createDataFrame(rows, "match_id string, match_type string, line_items array<struct<txn_id:string,invoice_id:string,allocated_amount:decimal(18,2)>>")
    got = {r.match_id: r.allocated for r in report.allocated_by_id(df).collect()}
    assert got == {"a": {"I1": d("3.00"), "I2": d("4.00")}, "b": {"T1": d("6.50"), "T2": d("2.00")}, "c": {"T": d("0.00")}, "d": {}}


def test_one_id_under_two_merchants_stays_two_transactions(spark):
    i = [inv("INV-1", "2026-08-01", "Sharma Trading", 1000, merchant=m) for m in "MN"]
    t = [txn("T1", "2026-08-02", 1000, "NEFT SHARMA TRADING", merchant="M"), txn("T1", "2026-08-02", 700, "NEFT SHARMA TRADING", merchant="N")]
    got = rules_run(txns_df(spark, t), invs_df(spark, i), "R").collect()
    assert sorted(r.confidence_score for r in got) == [55.0, 100.0] and len({r.match_id for r in got}) == 2
    run = rc.reconcile(txns_df(spark, t), invs_df(spark, i), "R")
    rows = run.matches.collect()
    assert len(rows) == 2 == len({r.match_id for r in rows})
    assert sorted(r.score for r in live.preliminary(txns_df(spark, t), invs_df(spark, i)).collect()) == [55.0, 100.0]


def test_more_rows_than_ids_of_few_digits(spark):
    """Three digits name 4,096 rows; the others get longer ids, and rows that are equal come apart, too."""
    n = 5_000
    raw = spark.range(n).select(F.lit(None).cast("string").alias("txn_id"), F.lit("2026-01-05").alias("txn_date"), F.lit("10").alias("amount"), F.greatest("id", F.lit(60)).alias("row_idx"))
    parsed = csvs.parse_transactions(csvs.with_columns_present(raw.withColumn("narration", F.lit("x")), csvs.TXN_COLUMNS), "M", "B", id_digits=3)
    assert csvs.good_rows(parsed, "txn_id").agg(F.countDistinct("txn_id"), F.count("*")).first() == (n, n)
