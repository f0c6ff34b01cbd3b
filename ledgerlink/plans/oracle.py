"""DuckDB SQL that recomputes the registered queries from the given tables."""

from __future__ import annotations

from ledgerlink.functions.scalars import CHANNEL_PREFIXES, SPLIT_WORDS, STOP_GROUPS, STOP_RULES
from ledgerlink.operators.linkage import PRIORS
from ledgerlink.plans.fuzzy_sql import ratios


def _list(words: list[str]) -> str:
    return ",".join(f"'{w}'" for w in words)


# Reconciliation inputs, as derived in sources/driver_tables.py.
INV = """
np AS (SELECT count(*) AS n, min(p_partkey) AS f FROM part),
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(o_orderdate AS DATE) AS d,
        CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS total_p,
        o_custkey % (SELECT n FROM np) + (SELECT f FROM np) AS pk FROM orders),
inv0 AS (SELECT k, total_p, CASE WHEN k % 16 = 0 THEN total_p // 10 ELSE 0 END AS tds_p, total_p * 100 // 118 AS base_p, st, d,
        'MER-' || c_nationkey || '-' || c_mktsegment AS merchant_id,
        upper(p_name) || ' ' || (['TRADERS','LOGISTICS','PVT LTD','INDUSTRIES'])[1 + c % 4] AS cp
      FROM o JOIN customer ON c = c_custkey JOIN part ON pk = p_partkey),
inv AS (SELECT *, 'INV-' || k AS invoice_id, d AS invoice_date, total_p - tds_p AS net_p, total_p - base_p AS gst_p,
        CASE WHEN k % 5 < 3 THEN (total_p - base_p) // 2 ELSE 0 END AS cgst_p,
        CASE WHEN k % 5 < 3 THEN (total_p - base_p) - (total_p - base_p) // 2 ELSE 0 END AS sgst_p,
        CASE WHEN k % 5 < 3 THEN 0 ELSE total_p - base_p END AS igst_p,
        CASE WHEN k % 16 <> 5 THEN 'UTR' || lpad(CAST(k AS VARCHAR), 9, '0') END AS i_ref,
        CASE st WHEN 'O' THEN 'open' WHEN 'F' THEN 'settled' ELSE 'partially_settled' END AS status,
        CASE WHEN tds_p > 0 THEN '194J' END AS tds_section FROM inv0)
"""

TXN = INV + """,
parts AS (SELECT *, unnest(CASE WHEN k % 16 IN (2, 4) THEN [1, 2] ELSE [1] END) AS part FROM inv),
txn AS (SELECT 'TXN-' || k || '-' || part AS txn_id, k, part, merchant_id,
        CAST(d + CAST(3 + CASE WHEN k % 16 = 7 THEN 50 ELSE 0 END + CASE WHEN k % 16 = 4 AND part = 2 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS txn_date,
        CASE WHEN k % 16 = 0 THEN net_p WHEN k % 16 = 1 THEN total_p + 150 WHEN k % 16 = 2 AND part = 1 THEN total_p * 2 // 5
             WHEN k % 16 = 2 THEN total_p - total_p * 2 // 5 WHEN k % 16 = 3 THEN total_p * 2 // 5 WHEN k % 16 = 9 THEN 500 ELSE total_p END AS amount_p,
        CASE WHEN k % 16 = 8 THEN 'debit' ELSE 'credit' END AS direction,
        (['UPI','NEFT','IMPS','RTGS','cheque'])[1 + k % 5] AS channel,
        (['UPI/','NEFT-','IMPS/','RTGS/','CHQ DEP '])[1 + k % 5] ||
          CASE WHEN k % 16 = 9 THEN 'SB INTEREST CREDIT' WHEN k % 7 = 5 THEN 'FUNDS TRANSFER' WHEN k % 7 = 3 THEN substr(cp, 1, 8) ELSE cp END ||
          CASE WHEN k % 16 = 2 THEN ' PART ' || part || ' ' || invoice_id WHEN k % 16 = 3 THEN ' ADVANCE' ELSE ' SETTLEMENT' END AS narr,
        CASE WHEN k % 16 = 6 THEN substr(i_ref, 1, 6) ELSE i_ref END AS t_ref FROM parts)
"""

PAIRS = TXN + """,
pairs AS (SELECT t.txn_id, t.k AS tk, t.merchant_id, t.txn_date, t.amount_p, t.direction, t.channel, t.narr, t.t_ref,
        i.invoice_id, i.k AS row_idx, i.invoice_date, i.net_p, i.total_p, i.tds_p, i.gst_p, i.i_ref, i.cp,
        abs(date_diff('day', i.invoice_date, t.txn_date)) AS gap
      FROM txn t JOIN inv i ON t.merchant_id = i.merchant_id AND i.status = 'open'
        AND i.invoice_date >= t.txn_date - 60 AND i.invoice_date <= t.txn_date + 7)
"""

_RULES = """,
r0 AS (SELECT *, (net_p * 9764) // 10000 AS gq, (net_p * 9764) % 10000 AS gr FROM {src}),
r1 AS (SELECT *, gq + CASE WHEN gr > 5000 OR (gr = 5000 AND gq % 2 = 1) THEN 1 ELSE 0 END AS gateway_p FROM r0),
r2 AS (SELECT *,
        CASE WHEN t_ref = i_ref THEN 40 WHEN length(t_ref) >= 6 AND length(i_ref) >= 6 AND (starts_with(t_ref, i_ref) OR starts_with(i_ref, t_ref)) THEN 20
             WHEN contains(narr, invoice_id) THEN 35 ELSE 0 END AS s_ref,
        CASE WHEN abs(amount_p - net_p) <= 200 THEN 'exact' WHEN abs(amount_p - total_p) <= 200 THEN 'gross' END AS k_amount,
        CASE WHEN tds_p > 0 AND abs(amount_p - (total_p - tds_p)) <= 200 THEN 'tds' WHEN channel = 'UPI' AND abs(amount_p - gateway_p) <= 200 THEN 'gateway' END AS k_formula,
        CASE WHEN gap <= 3 THEN 20 WHEN gap <= 7 THEN 15 WHEN gap <= 30 THEN 10 WHEN gap <= 60 THEN 5 ELSE 0 END AS s_date,
        CASE WHEN contains(narr, cp) THEN 35
             WHEN len(list_filter(string_split(cp, ' '), lambda w: length(w) >= 4 AND w NOT IN ({stop}) AND contains(narr, substr(w, 1, 4)))) > 0 THEN 15
             ELSE 0 END AS s_name FROM r1),
r3 AS (SELECT *, CASE k_amount WHEN 'exact' THEN 45 WHEN 'gross' THEN 35 ELSE 0 END AS s_amount,
        CASE k_formula WHEN 'tds' THEN 25 WHEN 'gateway' THEN 22 ELSE 0 END AS s_formula FROM r2),
ruled AS (SELECT *, least(100, s_ref + s_amount + s_formula + s_date + s_name) AS p1, (k_amount IS NOT NULL OR k_formula IS NOT NULL) AS p1_amount FROM r3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY p1 DESC, gap, row_idx, invoice_id) AS rk FROM ruled)
"""
RULED = PAIRS + _RULES.format(src="pairs", stop=_list(STOP_RULES))
BAND = "CASE WHEN {s} >= 85 THEN 'auto_accept' WHEN {s} >= 50 THEN 'review' ELSE 'reject' END"

_SPLIT = "|".join(SPLIT_WORDS)

_LIVE = TXN + f""",
live AS (SELECT * FROM txn WHERE NOT regexp_matches(narr, '{_SPLIT}'))"""
_DUPS = """,
dups AS (SELECT a.txn_id, arg_min(b.txn_id, (b.txn_date, b.txn_id)) AS original_id FROM live a JOIN live b
        ON a.merchant_id = b.merchant_id AND a.direction = b.direction AND a.amount_p = b.amount_p AND {alike}
        AND b.txn_date <= a.txn_date AND b.txn_date >= a.txn_date - 3 AND (b.txn_date < a.txn_date OR b.txn_id < a.txn_id) GROUP BY a.txn_id)
"""
DUP_EQUAL = _LIVE + _DUPS.format(alike="a.narr = b.narr")
DUP = _LIVE + """,
said AS (SELECT DISTINCT a.narr AS a, b.narr AS b FROM live a JOIN live b ON a.merchant_id = b.merchant_id AND a.direction = b.direction AND a.amount_p = b.amount_p
        AND b.txn_date <= a.txn_date AND b.txn_date >= a.txn_date - 3),
""" + ratios("said", "alike").strip() + _DUPS.format(alike="(a.narr, b.narr) IN (SELECT (a, b) FROM alike WHERE greatest(plain, sets) >= 85)")

_PRE = """,
pre AS (SELECT t.*, d.original_id, CASE WHEN direction = 'debit' THEN 'debit_transaction'
        WHEN amount_p <= 1000 OR (contains(narr, 'INTEREST') AND amount_p < 10000) THEN 'noise_below_floor'
        WHEN d.original_id IS NOT NULL THEN 'duplicate_detected' END AS excluded_as FROM txn t LEFT JOIN dups d USING (txn_id))
"""
PRE = DUP + _PRE

MATCHES = PRE + PAIRS[len(TXN):] + """,
todo AS (SELECT p.* FROM pairs p JOIN pre USING (txn_id) WHERE pre.excluded_as IS NULL)
""" + _RULES.format(src="todo", stop=_list(STOP_RULES)) + f""",
m0 AS (SELECT p.txn_id, p.k, p.part, p.merchant_id, p.txn_date, p.amount_p, p.narr, p.original_id, p.excluded_as, r.invoice_id, r.row_idx AS ik, coalesce(r.p1, 0) AS p1, r.p1_amount
      FROM pre p LEFT JOIN ranked r ON p.txn_id = r.txn_id AND r.rk = 1),
m AS (SELECT *, {BAND.format(s='p1')} AS band, CASE WHEN invoice_id IS NULL THEN 'exception' ELSE 'one_to_one' END AS match_type,
      CASE WHEN invoice_id IS NOT NULL AND NOT (p1 >= 55 AND p1_amount) THEN 'none' ELSE 'rules_engine' END AS source,
      coalesce(excluded_as, CASE WHEN invoice_id IS NULL THEN 'no_candidate_found' WHEN p1 < 50 THEN 'low_confidence_match' END) AS category FROM m0)
"""

LABELS = """,
lab AS (SELECT k, invoice_id, CASE WHEN k % 16 = 2 THEN ['TXN-' || k || '-1', 'TXN-' || k || '-2'] ELSE ['TXN-' || k || '-1'] END AS txn_ids,
        k % 16 NOT IN (8, 9) AS truth, CAST(k % 16 AS VARCHAR) AS category FROM inv)
"""

# Every true event is one label here, because transaction sets do not repeat across labels.
OUTCOMES = MATCHES + LABELS + """,
pred AS (SELECT *, [txn_id] AS tset, [invoice_id] AS iset FROM m WHERE band <> 'reject'),
ev AS (SELECT invoice_id AS ev_inv, txn_ids, category AS cat FROM lab WHERE truth),
hit AS (SELECT p.txn_id, p.band, e.cat, e.ev_inv FROM pred p JOIN ev e ON p.tset = e.txn_ids AND p.invoice_id = e.ev_inv),
oc AS (SELECT CASE WHEN band = 'auto_accept' THEN 'tp' ELSE 'review_tp' END AS kind, cat AS category, 0 AS amount FROM hit
  UNION ALL SELECT 'fp', coalesce(l.category, 'unknown'), p.amount_p FROM pred p LEFT JOIN lab l ON p.invoice_id = l.invoice_id WHERE p.band = 'auto_accept' AND p.txn_id NOT IN (SELECT txn_id FROM hit)
  UNION ALL SELECT 'fn', cat, 0 FROM ev WHERE ev_inv NOT IN (SELECT ev_inv FROM hit))
"""


def _c(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"


def _micro(x: str, f: int = 1000000) -> str:
    return f"CAST(floor(({x}) * {f} + 0.5) AS BIGINT)"


def _half_up(x: str, digits: int) -> str:
    """Half-up rounding of a double's shortest decimal text."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {digits})"


def _with(base: str, body: str) -> str:
    return "WITH " + base.strip() + "\n" + body


ORACLE: dict[str, str] = {}


def add(name: str, base: str, body: str) -> None:
    ORACLE[name] = _with(base, body)


_G = {"reference_number": "ref", "amount_exact": "exact", "amount_tds": "tds", "amount_gst": "gst", "name_strong": "strong", "name_weak": "weak", "date_close": "close", "date_window": "window"}
_LLR = {_G[f]: (m, u) for f, m, u in PRIORS}
_SIG = """,
names AS (SELECT DISTINCT cp AS a, narr AS b FROM pairs),
""" + ratios("names").strip().replace("{", "{{").replace("}", "}}") + """,
sig AS (SELECT s.*, CASE WHEN t_ref IS NOT NULL AND i_ref IS NOT NULL THEN CAST(t_ref = i_ref AS INTEGER) END AS g_ref,
        CAST(abs(amount_p - net_p) <= 200 AS INTEGER) AS g_exact,
        CASE WHEN tds_p > 0 THEN CAST(abs(amount_p - net_p) <= 200 AS INTEGER) END AS g_tds,
        CASE WHEN gst_p > 0 THEN CAST(abs(amount_p - total_p) <= 200 AS INTEGER) END AS g_gst,
        CAST(greatest(fz.part, fz.sets) >= 85 AS INTEGER) AS g_strong, CAST(greatest(fz.part, fz.sets) >= 60 AS INTEGER) AS g_weak,
        CAST(gap <= 7 AS INTEGER) AS g_close, CAST(gap <= 60 AS INTEGER) AS g_window FROM {src} s JOIN fz ON s.cp = fz.a AND s.narr = fz.b)
"""
_SUM = " + ".join(
    f"CASE g_{k} WHEN 1 THEN ln({m}/{u}) WHEN 0 THEN ln((1-{m})/(1-{u})) ELSE 0 END".replace(f"({m}/{u})", f"(CAST({m} AS DOUBLE)/{u})").replace(f"(1-{m})/(1-{u})", f"CAST(1-{m} AS DOUBLE)/(1-{u})")
    for k, (m, u) in _LLR.items()
)
_FS = f", fs0 AS (SELECT *, {_SUM} AS llr FROM sig), fs AS (SELECT *, floor(10000.0 / (1 + exp(-greatest(-20, least(20, 0.5 * llr)))) + 0.5) / 100 AS fs FROM fs0)"

# ---- sources
_LAYOUT = "strftime(txn_date, '%Y-%m-%d')"
add("src1_bank_csv_scan", TXN, f"SELECT txn_id, {_LAYOUT} AS txn_date, amount_p, direction, narr AS narration, channel, t_ref AS reference_number FROM txn WHERE k % 50 NOT IN (7, 9)")
add("src2_invoice_csv_scan", INV, "SELECT invoice_id, strftime(d, '%Y-%m-%d') AS invoice_date, cp AS counterparty_name, base_p, total_p, CASE WHEN k % 4 = 1 THEN total_p ELSE net_p END AS net_p, cgst_p, CAST(0 AS BIGINT) AS igst_p, tds_section, tds_p, i_ref AS reference_number, status FROM inv")
add("src3_label_csv_scan", INV + LABELS, "SELECT invoice_id, array_to_string(txn_ids, '|') AS txn_ids, CAST(truth AS INTEGER) AS is_true, category AS case_category FROM lab")
add("src4_parse_error_bucket", TXN, "SELECT 'bank_csv' AS file, txn_id, CASE WHEN k % 50 = 7 THEN 'Invalid amount: ''n/a''' ELSE 'Invalid date: ''soon''' END AS errors FROM txn WHERE k % 50 IN (7, 9)")
add("src5_key_filtered_scan", MATCHES, f"SELECT txn_id, invoice_id, {_c('p1')} AS score_c FROM m WHERE band = 'review'")
add("src6_run_fallback_scan", MATCHES, "SELECT txn_id, band AS confidence_band FROM m")
add("src7_src8_idempotent_sink", MATCHES, "SELECT run_id, band AS confidence_band, count(*) AS n FROM m CROSS JOIN (VALUES ('RULES'), ('OTHER')) v(run_id) GROUP BY ALL")
add("src9_upload_summary", TXN, "SELECT (SELECT count(*) FROM txn WHERE k % 50 NOT IN (7, 9)) AS txns_loaded, (SELECT count(*) FROM inv) AS invoices_loaded, (SELECT count(*) FROM txn WHERE k % 50 IN (7, 9)) AS errors")

# ---- projections
_TAXED = INV + """,
tx AS (SELECT *, ([0, 5, 12, 18, 28])[1 + k % 5] AS rate, CASE WHEN k % 3 > 0 THEN (['194J','194C','194I','194Q','999X'])[1 + (k // 5) % 5] END AS sec FROM inv),
tg AS (SELECT *, (base_p * rate * 2 + 100) // 200 AS gst FROM tx),
tt AS (SELECT *, CASE WHEN k % 2 = 0 THEN (gst + 1) // 2 ELSE 0 END AS half, CASE WHEN k % 2 = 0 THEN 0 ELSE gst END AS ig,
       CASE sec WHEN '194C' THEN 20 WHEN '194Q' THEN 1 ELSE CASE WHEN sec IS NULL THEN 0 ELSE 100 END END AS mil FROM tg)
"""
add("prj3_missing_id_synthesis", TXN, "SELECT count(*) AS n_rows, count(*) AS n_made FROM txn")
add("prj5_gst_derivation", _TAXED, "SELECT invoice_id, half AS cgst_p, half AS sgst_p, ig AS igst_p, base_p + half * 2 + ig AS total_p FROM tt")
add("prj6_tds_net_derivation", _TAXED, "SELECT invoice_id, (base_p * mil * 2 + 1000) // 2000 AS tds_p, base_p + half * 2 + ig - (base_p * mil * 2 + 1000) // 2000 AS net_p FROM tt")
add("prj7_gst_slab_mismatch", INV, "SELECT invoice_id, CASE WHEN base_p > 0 AND g <> 0 AND round_even(CAST(g AS DOUBLE) / base_p * 100, 0) NOT IN (0, 5, 12, 18, 28) THEN 1 ELSE 0 END AS mismatch FROM (SELECT *, cgst_p + sgst_p + igst_p + CASE WHEN k % 9 = 0 THEN 10000000 ELSE 0 END AS g FROM inv)")
_MONEY = "CAST(CAST({p} AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))"


def _rs(p: str) -> str:
    return f"({p} // 100) || '.' || lpad(CAST({p} % 100 AS VARCHAR), 2, '0')"


add("prj8_transaction_text", TXN, f"SELECT txn_id, narr || ' amount ' || {_rs('amount_p')} || ' date ' || strftime(txn_date, '%d %B %Y') || ' channel ' || channel AS text FROM txn")
add("prj9_invoice_text", INV, f"SELECT invoice_id, cp || ' invoice amount ' || {_rs('net_p')} || CASE WHEN tds_p > 0 THEN ' tds deducted ' || {_rs('tds_p')} || ' section 194J' ELSE '' END || ' total ' || {_rs('total_p')} || ' date ' || strftime(d, '%d %B %Y') AS text FROM inv")
add("prj10_threshold_snapshot", MATCHES, f"SELECT txn_id, CAST(85 AS DOUBLE) AS auto, CAST(16 AS DOUBLE) AS pool, {_c('p1')} AS fs_c, '0.6 × heuristic + 0.4 × fs' AS fs_blend FROM m")
add("prj12_explanation_source", INV, "SELECT invoice_id, CASE WHEN k % 11 = 0 THEN 'llm' ELSE (['rules_engine','fuzzy','embedding','embedding','llm','none','none'])[1 + k % 7] END AS source FROM inv")
add("prj13_audit_pass_name", INV, "SELECT invoice_id, (['pass1_rules','pass2_fuzzy','pass3_embedding','pass4_split_matcher','pass5_llm','confidence_scorer'])[1 + k % 6] AS pass_name FROM inv")
add("prj14_exception_detail", MATCHES, f"""SELECT txn_id, category AS exception_reason_category, CASE category WHEN 'debit_transaction' THEN 'Debit or refund needs manual handling: ' || narr
    WHEN 'noise_below_floor' THEN 'Amount ₹' || {_rs('amount_p')} || ' is below the noise floor' WHEN 'duplicate_detected' THEN 'Likely copy of ' || original_id || ': same amount and text within 3 days'
    WHEN 'no_candidate_found' THEN 'No open invoice of this merchant in the date window' END AS exception_reason_detail FROM m WHERE category IS NOT NULL""")

# ---- filters
add("flt4_prepass_exclusions", PRE, "SELECT txn_id, coalesce(excluded_as, 'kept') AS excluded_as, original_id FROM pre")
add("flt6_window_counts", PAIRS, "SELECT txn_id, count(*) AS n, CAST(min(gap) AS BIGINT) AS nearest FROM pairs GROUP BY txn_id")
add("flt7_amount_window", PAIRS, """SELECT merchant_id, count(*) FILTER (WHERE abs(CASE WHEN direction = 'credit' THEN net_p ELSE total_p END - amount_p) <= 1.5 * amount_p OR abs(total_p - amount_p) <= 1.5 * amount_p
    OR abs(CASE WHEN direction = 'credit' THEN net_p ELSE total_p END - amount_p) <= 1.5 * CASE WHEN direction = 'credit' THEN net_p ELSE total_p END) AS kept, count(*) AS pairs FROM pairs GROUP BY merchant_id""")
add("flt8_match_search", MATCHES, "SELECT txn_id, invoice_id FROM m WHERE band = 'review' AND contains(lower(txn_id), 'txn-1')")
_REV = "k % 3 = 0 AND band IN ('review', 'reject')"
add("flt9_exception_queue", MATCHES, "SELECT category AS exception_reason_category, count(*) AS n, CASE WHEN k % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS queue FROM m WHERE band = 'reject' GROUP BY ALL")
add("flt10_adjudication_eligibility", RULED, f"SELECT txn_id, invoice_id, {_c('p1')} AS score_c FROM ranked WHERE rk = 1 AND p1 >= 30 AND (row_idx % 13 = 0 OR row_idx % 17 = 0 OR (p1 >= 50 AND p1 < 85))")
add("flt11_pending_list", MATCHES, f"SELECT txn_id, {_c('p1')} AS score_c FROM m WHERE band = 'review'")
add("flt12_exception_list", MATCHES, "SELECT txn_id, invoice_id, category AS exception_reason_category FROM m WHERE band = 'reject'")

# ---- joins
add("jn1_candidate_range_join", PAIRS, "SELECT txn_id, invoice_id, CAST(gap AS BIGINT) AS gap FROM pairs")
add("jn3_duplicate_identical_text", DUP_EQUAL, "SELECT txn_id, original_id FROM dups")
add("jn7_group_equality_join", OUTCOMES, "SELECT kind, category, count(*) AS n FROM oc GROUP BY ALL")
add("jn8_calibration_join", MATCHES + LABELS, "SELECT CAST(p1 AS BIGINT) AS p_c, count(*) AS n, CAST(count(*) FILTER (WHERE l.txn_ids = [m.txn_id]) AS BIGINT) AS \"right\" FROM m LEFT JOIN lab l ON m.invoice_id = l.invoice_id GROUP BY p1")

# ---- scoring
for _name, _col, _extra in [("sco1_reference_points", "s_ref", ""), ("sco2_amount_points", "s_amount", ", k_amount"), ("sco3_formula_points", "s_formula", ", k_formula"), ("sco4_date_points", "s_date", ""), ("sco5_name_points", "s_name", "")]:
    add(_name, RULED, f"SELECT txn_id, invoice_id, {_c(_col)} AS points_c{_extra} FROM ruled WHERE {_col} > 0")
add("sco6_rule_resolution", RULED, f"SELECT txn_id, invoice_id, {_c('p1')} AS score_c, CASE WHEN p1 >= 55 AND p1_amount THEN 'pass1_rules' ELSE 'open' END AS resolved FROM ranked WHERE rk = 1")
_PCT = "(CAST(abs(amount_p - net_p) AS DOUBLE) / net_p)"
add("sco8_fuzzy_amount_points", PAIRS, f"SELECT txn_id, invoice_id, {_c(f'12.0 * exp(-0.5 * ({_PCT} / 0.10) * ({_PCT} / 0.10))')} AS points_c FROM pairs WHERE net_p <> 0 AND {_PCT} <= 0.30")
add("sco9_fuzzy_date_points", PAIRS, f"SELECT txn_id, invoice_id, {_c('10.0 * exp(-0.5 * (gap / 15.0) * (gap / 15.0))')} AS points_c FROM pairs")
_VEC = PAIRS + """,
en AS (SELECT count(*) AS n FROM embeddings),
vs AS (SELECT p.txn_id, p.invoice_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
       FROM pairs p JOIN embeddings a ON a.vec_id = p.tk % (SELECT n FROM en) JOIN embeddings b ON b.vec_id = p.row_idx % (SELECT n FROM en))"""
add("sco11_vector_points", _VEC, f"SELECT txn_id, invoice_id, CASE WHEN sim >= 0.5 THEN {_c('20.0 * (sim - 0.5) / 0.5')} ELSE 0 END AS points_c FROM vs")
add("sco13_comparison_signals", PAIRS + _SIG.format(src="pairs"), "SELECT txn_id, invoice_id, g_ref AS reference_number, g_exact AS amount_exact, g_tds AS amount_tds, g_gst AS amount_gst, g_strong AS name_strong, g_weak AS name_weak, g_close AS date_close, g_window AS date_window FROM sig")
add("sco14_linkage_score", PAIRS + _SIG.format(src="pairs") + _FS, f"SELECT txn_id, invoice_id, {_c('fs')} AS fs_c FROM fs")
add("sco15_blended_score", RULED + _SIG.format(src="ruled") + _FS, f"SELECT txn_id, invoice_id, {_c('greatest(0, least(100, CAST(0.6 AS DOUBLE) * p1 + CAST(0.4 AS DOUBLE) * fs + greatest(-20, least(20, row_idx % 61 - 30))))')} AS final_c FROM fs")
add("sco16_band_cut", RULED, f"SELECT {BAND.format(s='p1')} AS band, count(*) AS n FROM ruled GROUP BY ALL")
add("sco17_safety_gates", RULED, f"""SELECT gate, CASE WHEN gate IN ('exception', 'hard_floor') THEN 'reject' WHEN gate IN ('human_review', 'flagged') THEN 'review' ELSE {BAND.format(s='p1')} END AS decision, count(*) AS n
    FROM (SELECT *, CASE WHEN row_idx % 11 = 0 THEN 'exception' WHEN p1 < 30 THEN 'hard_floor' WHEN row_idx % 5 = 0 AND p1 >= 85 THEN 'human_review' WHEN row_idx % 7 = 0 AND p1 >= 85 THEN 'flagged' ELSE 'none' END AS gate FROM ruled) GROUP BY ALL""")

# ---- groups and fitting
# Every subset of at most 16 members is a number; a member belongs to it if its bit is set.
_SUBSETS = """,
pool AS (SELECT key, target, list({'id': id, 'net': net, 'gap': gap, 'ok': ok} ORDER BY o) AS m FROM member GROUP BY key, target HAVING count(*) BETWEEN 2 AND 16),
subset AS (SELECT key, target, m, list_filter(range(len(m)), lambda i: (x >> i) & 1 = 1) AS pos FROM (SELECT *, unnest(range(1 << len(m)::INTEGER)) AS x FROM pool)),
meets AS (SELECT key, pos, list_transform(pos, lambda i: m[i + 1]) AS got FROM subset WHERE len(pos) >= 2 AND abs(list_sum(list_transform(pos, lambda i: m[i + 1].net)) - target) <= 200),
judged AS (SELECT *, CAST(list_bool_and(list_transform(got, lambda g: g.ok)) AS INTEGER) AS named, list_max(list_transform(got, lambda g: g.gap)) AS far FROM meets),
best AS (SELECT key, count(*) AS n_solutions, CASE WHEN sum(named) > 0 THEN sum(named) ELSE count(*) END AS n_valid, arg_min(got, (-named, len(pos), far, pos)) AS got FROM judged GROUP BY key)
"""
add("grp1_split_groups", TXN + """,
namings AS (SELECT DISTINCT i.invoice_id AS key, i.net_p AS target, t.txn_id AS id, t.amount_p AS net, abs(date_diff('day', i.invoice_date, t.txn_date)) AS gap, true AS ok, (-t.amount_p, t.txn_date, t.txn_id) AS o
    FROM inv i JOIN txn t ON t.merchant_id = i.merchant_id AND t.direction = 'credit' AND list_contains(regexp_extract_all(t.narr, '\\bINV-\\d+\\b'), i.invoice_id) WHERE i.status = 'open'),
member AS (SELECT * FROM namings)""" + _SUBSETS, """SELECT key AS invoice_id, array_to_string(list_sort(list_transform(got, lambda g: g.id)), '|') AS txn_ids, n_solutions, 0 AS flagged FROM best
    UNION ALL SELECT key, NULL, 0, 1 FROM namings GROUP BY key HAVING count(*) > 16""")
add("grp3_partial_payments", TXN, """SELECT i.invoice_id, arg_min(t.txn_id, (-t.amount_p, t.txn_date, t.txn_id)) AS txn_id, max(t.amount_p) AS paid_p, any_value(i.net_p) - max(t.amount_p) AS open_p
    FROM inv i JOIN txn t ON t.merchant_id = i.merchant_id AND t.t_ref = i.i_ref AND t.direction = 'credit' AND t.amount_p < i.net_p WHERE i.status = 'open' GROUP BY i.invoice_id""")
_PRIOR = {f: (f"g_{_G[f]}", m, u) for f, m, u in PRIORS}
_EST = " UNION ALL ".join(
    (f"SELECT '{f}' AS field, (count(*) FILTER (WHERE tk = row_idx AND {g} = 1) + 1.0) / (count(*) FILTER (WHERE tk = row_idx AND {g} IS NOT NULL) + 2) AS m, (count(*) FILTER (WHERE tk <> row_idx AND {g} = 1) + 1.0) / (count(*) FILTER (WHERE tk <> row_idx AND {g} IS NOT NULL) + 2) AS u, {m} AS m0, {u} AS u0 FROM sig" if g
     else f"SELECT '{f}', 0.5, 0.5, {m}, {u}") for f, (g, m, u) in _PRIOR.items())
_EST2 = PAIRS + _SIG.format(src="pairs") + f", est AS ({_EST}), fin AS (SELECT field, CASE WHEN m > u THEN CAST(m AS DOUBLE) ELSE m0 END AS m, CASE WHEN m > u THEN CAST(u AS DOUBLE) ELSE u0 END AS u, CAST(m > u AS INTEGER) AS updated FROM est)"
add("fs1_weight_estimation", _EST2, f"SELECT field, {_micro('m')} AS m_micro, {_micro('u')} AS u_micro, updated FROM fin")
add("fs2_weight_summary", _EST2, f"SELECT field, {_micro('m', 1000)} AS m_prob, {_micro('u', 1000)} AS u_prob, {_micro('ln(m / u)', 1000)} AS agree_llr, {_micro('ln((1 - m) / (1 - u))', 1000)} AS disagree_llr, 1 AS valid FROM fin")

# ---- adjudication and review
_REPLY = """,
rep AS (SELECT *, row_idx % 4 < 2 AS ok, (['match','no_match','insufficient_evidence'])[1 + row_idx % 3] AS verdict, row_idx % 71 - 35 AS raw FROM ranked WHERE rk = 1),
ans AS (SELECT *, CASE WHEN NOT ok OR verdict = 'insufficient_evidence' THEN 0 ELSE greatest(-20, least(20, raw)) END AS delta FROM rep)
"""
_AFTER = "greatest(0, least(100, p1 + delta))"
add("adj1_apply_replies", RULED + _REPLY, f"SELECT txn_id, CASE WHEN ok THEN verdict END AS assessment, {_c('delta')} AS delta_c, {_c(_AFTER)} AS score_c, {BAND.format(s=_AFTER)} AS band FROM ans")
add("jsn1_reply_extraction", RULED + _REPLY, "SELECT txn_id, CASE WHEN ok THEN verdict END AS assessment, CASE WHEN ok THEN CAST(raw AS DOUBLE) END AS delta, CASE WHEN ok THEN 'see {' || row_idx || '}' END AS explanation FROM rep")
_RETRY = MATCHES + """,
q0 AS (SELECT *, band = 'review' AND ik % 4 < 2 AS done, (['match','no_match','insufficient_evidence'])[1 + ik % 3] AS verdict FROM m),
q AS (SELECT *, CASE WHEN done AND verdict <> 'insufficient_evidence' THEN greatest(0, least(100, p1 + greatest(-20, least(20, ik % 71 - 35)))) ELSE p1 END AS s FROM q0)
"""
add("adj3_retry_pending", _RETRY, f"SELECT txn_id, {_c('s')} AS score_c, {BAND.format(s='s')} AS confidence_band, CASE WHEN band = 'review' AND NOT done THEN 1 ELSE 0 END AS pending, CASE WHEN done THEN 'llm' ELSE source END AS explanation_source FROM q")
add("rev1_human_review", MATCHES, f""", a AS (SELECT *, {_REV} AS ok FROM m WHERE k % 3 = 0)
    SELECT what, n FROM (SELECT CASE WHEN {_REV} THEN CASE WHEN k % 2 = 0 THEN 'accepted' ELSE 'rejected' END ELSE 'none' END AS what, count(*) AS n FROM m GROUP BY 1
    UNION ALL SELECT 'match is already accepted', sum(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END)::BIGINT FROM a WHERE NOT ok
    UNION ALL SELECT 'match is already reviewed', count(*) FROM a WHERE ok AND k % 5 = 0 UNION ALL SELECT 'audit rows', count(*) FROM a WHERE ok)""".replace(", a AS", ", a AS", 1))

# ---- aggregations
add("agg1_run_summary", MATCHES, "SELECT 'TESTDATA' AS batch_id, 'RULES' AS run_id, count(*) AS total, count(*) FILTER (WHERE band = 'auto_accept') AS auto_accept, count(*) FILTER (WHERE band = 'review') AS review, count(*) FILTER (WHERE band = 'reject') AS reject FROM m")
add("agg2_batch_metrics", MATCHES, "SELECT 'TESTDATA' AS batch_id, count(*) AS total, count(*) FILTER (WHERE band = 'auto_accept') AS auto_accept, count(*) FILTER (WHERE band = 'review') AS review, count(*) FILTER (WHERE band = 'reject') AS reject, CAST(floor(CAST(sum(p1) AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS avg_confidence_score, CAST(floor(count(*) FILTER (WHERE band = 'auto_accept') * 1000.0 / count(*) + 0.5) AS BIGINT) AS auto_accept_rate, CAST(floor(count(*) FILTER (WHERE band = 'reject') * 1000.0 / count(*) + 0.5) AS BIGINT) AS exception_rate, CAST(0 AS BIGINT) AS pending_count FROM m")
add("agg2_breakdown", MATCHES, "SELECT 'TESTDATA' AS batch_id, facet, value, n FROM (SELECT 'confidence_band' AS facet, band AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'match_type', match_type, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'explanation_source', source, count(*) FROM m GROUP BY 2)")
add("agg3_truth_events", INV + LABELS, "SELECT array_to_string(txn_ids, '|') AS txns, invoice_id AS invoices, category FROM lab WHERE truth")
_CNT = "count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn, count(*) FILTER (WHERE kind = 'review_tp') AS review_tp"
add("agg4_category_outcomes", OUTCOMES, f"SELECT *, CASE WHEN tp + fp > 0 THEN {_micro('CAST(tp AS DOUBLE) / (tp + fp)', 1000)} END AS precision, CASE WHEN tp + fn > 0 THEN {_micro('CAST(tp AS DOUBLE) / (tp + fn)', 1000)} END AS recall FROM (SELECT category, {_CNT} FROM oc GROUP BY category)")
add("agg5_precision_recall", OUTCOMES, f"SELECT tp, fp, fn, p AS precision, r AS recall, {_micro('2 * (p / 10000.0) * (r / 10000.0) / ((p + r) / 10000.0)', 10000)} AS f1 FROM (SELECT *, {_micro('CAST(tp AS DOUBLE) / (tp + fp)', 10000)} AS p, {_micro('CAST(tp AS DOUBLE) / (tp + fn)', 10000)} AS r FROM (SELECT {_CNT} FROM oc))")
add("agg6_false_positive_cost", OUTCOMES, "SELECT 'TESTDATA' AS batch_id, CAST(sum(amount) AS BIGINT) AS cost_p FROM oc")
add("agg7_exception_completeness", MATCHES, "SELECT 'TESTDATA' AS batch_id, count(*) FILTER (WHERE category IS NOT NULL) AS with_reason, count(*) FILTER (WHERE category IS NULL) AS without_reason, CAST(floor(count(*) FILTER (WHERE category IS NOT NULL) * 1000.0 / count(*) + 0.5) AS BIGINT) AS pct_d FROM m WHERE band = 'reject'")
_FC = "fc AS (SELECT CAST(toxic AS BIGINT) AS grp, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS p, CAST(quality AS INTEGER) AS y FROM labels)"
_BINS = _FC + ", fb AS (SELECT *, CASE WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < CAST('0.6000000000000001' AS DOUBLE) THEN 2 WHEN p < 0.8 THEN 3 ELSE 4 END AS bin FROM fc), bn AS (SELECT grp, bin, avg(y) AS acc, avg(p) AS conf, count(*) AS n FROM fb GROUP BY grp, bin)"
add("agg8_brier_score", _FC, f"SELECT grp, {_micro('avg((p - y) * (p - y))')} AS brier_micro, count(*) AS n FROM fc GROUP BY grp")
add("agg9_expected_calibration_error", _BINS, f"SELECT grp, {_micro('sum(n * abs(acc - conf)) / sum(n)', 10000)} AS ece_e4 FROM bn GROUP BY grp")
add("agg10_reliability_curve", _BINS, f"SELECT g.grp, CAST(b.bin AS BIGINT) AS bin, (['0%-20%','20%-40%','40%-60%','60%-80%','80%-100%'])[1 + b.bin] AS bin_label, {_micro('coalesce(conf, (b.bin * 2 + 1) / 10.0) * 100', 10)} AS conf_d, {_micro('coalesce(acc, 0) * 100', 10)} AS acc_d, coalesce(n, 0) AS sample_count FROM (SELECT DISTINCT grp FROM fc) g CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS bin) b LEFT JOIN bn ON bn.grp = g.grp AND bn.bin = b.bin")
_DIG = ", dg AS (SELECT *, CAST(nullif(regexp_extract(CAST({p} AS VARCHAR), '[1-9]'), '') AS BIGINT) AS digit FROM {src})"
add("agg11_digit_distribution", INV + _DIG.format(p="total_p", src="inv"), f"""SELECT merchant_id, digit, c AS observed_count, CAST({_half_up('CAST(' + _half_up('CAST(c AS DOUBLE) / n', 4) + ' AS DOUBLE) * 100', 1)} * 10 AS BIGINT) AS pct_d, {_micro('log10(1 + 1.0 / digit) * 100', 10)} AS expected_d,
    CASE WHEN n >= 10 THEN CAST({_half_up('(c - n * log10(1 + 1.0 / digit)) / sqrt(n * log10(1 + 1.0 / digit))', 2)} * 100 AS BIGINT) ELSE 0 END AS residual_c
    FROM (SELECT t.merchant_id, d.digit, t.n, count(g.k) AS c FROM (SELECT merchant_id, count(digit) AS n FROM dg GROUP BY 1) t CROSS JOIN (SELECT unnest(range(1, 10)) AS digit) d LEFT JOIN dg g ON g.merchant_id = t.merchant_id AND g.digit = d.digit GROUP BY ALL)""")
add("agg11_digit_test", TXN + _DIG.format(p="amount_p", src="txn"), f"""SELECT merchant_id, n, CASE WHEN n < 10 THEN 0 ELSE {_c('x')} END AS chi2_c, CASE WHEN n < 10 THEN 10000 ELSE {_micro('p', 10000)} END AS p_e4,
    CASE WHEN n < 10 THEN 'insufficient_data' WHEN p >= 0.05 THEN 'low' WHEN p >= 0.01 THEN 'medium' ELSE 'high' END AS risk_level
    FROM (SELECT *, exp(-x / 2) * (1 + x / 2 + (x / 2) * (x / 2) / 2 + (x / 2) * (x / 2) * (x / 2) / 6) AS p FROM (
      SELECT merchant_id, any_value(n) AS n, sum((c - n * log10(1 + 1.0 / digit)) * (c - n * log10(1 + 1.0 / digit)) / (n * log10(1 + 1.0 / digit))) AS x
      FROM (SELECT t.merchant_id, d.digit, t.n, count(g.k) AS c FROM (SELECT merchant_id, count(digit) AS n FROM dg GROUP BY 1) t CROSS JOIN (SELECT unnest(range(1, 10)) AS digit) d LEFT JOIN dg g ON g.merchant_id = t.merchant_id AND g.digit = d.digit GROUP BY ALL) GROUP BY merchant_id))""")
_DOM = INV + _DIG.format(p="total_p", src="inv") + """,
dc AS (SELECT merchant_id, cp, digit, count(*) AS c FROM dg GROUP BY ALL),
da AS (SELECT merchant_id, cp, sum(c) AS n, max(c) AS best FROM dc GROUP BY ALL),
dm AS (SELECT da.*, (SELECT min(digit) FROM dc WHERE dc.merchant_id = da.merchant_id AND dc.cp = da.cp AND dc.c = da.best) AS digit FROM da WHERE n >= 3 AND CAST(best AS DOUBLE) / n >= 0.6),
ds AS (SELECT merchant_id, cp, sum(total_p) AS s FROM inv GROUP BY ALL)
"""
add("agg12_dominant_counterparties", _DOM, f"SELECT merchant_id, cp AS counterparty_name, CAST(n AS BIGINT) AS total_invoices, digit, best AS digit_count, {_micro('CAST(best AS DOUBLE) / n * 100', 10)} AS ratio_d, CAST(s AS BIGINT) AS sum_p FROM dm JOIN ds USING (merchant_id, cp)")

_CHI = """(SELECT any_value(n) AS n, sum((c - n * log10(1 + 1.0 / digit)) * (c - n * log10(1 + 1.0 / digit)) / (n * log10(1 + 1.0 / digit))) AS x
    FROM (SELECT digit, count(*) AS c, sum(count(*)) OVER () AS n FROM {src} WHERE digit IS NOT NULL GROUP BY digit))"""
_TAIL = "exp(-x / 2) * (1 + x / 2 + (x / 2) * (x / 2) / 2 + (x / 2) * (x / 2) * (x / 2) / 6)"
# The leading digits of every batch table here cover 1 to 9, so no empty class is missed.
_RISK = TXN + _DIG.format(p="total_p", src="inv") + ", tg AS (SELECT *, CAST(nullif(regexp_extract(CAST(amount_p AS VARCHAR), '[1-9]'), '') AS BIGINT) AS digit FROM txn)" + """,
dcb AS (SELECT cp, digit, count(*) AS c FROM dg GROUP BY ALL),
dmb AS (SELECT count(*) AS flagged FROM (SELECT cp FROM dcb GROUP BY cp HAVING sum(c) >= 3 AND CAST(max(c) AS DOUBLE) / sum(c) >= 0.6)),
""" + f"ri AS (SELECT n, {_TAIL} AS p FROM {_CHI.format(src='dg')}), rt AS (SELECT n, {_TAIL} AS p FROM {_CHI.format(src='tg')})"
add("agg12_batch_risk", _RISK, """SELECT 'TESTDATA' AS batch_id, CAST(ri.n AS BIGINT) AS n_invoices, CAST(rt.n AS BIGINT) AS n_transactions,
    CASE WHEN ri.p < 0.01 OR rt.p < 0.01 OR flagged >= 3 THEN 'high' WHEN ri.p < 0.05 OR rt.p < 0.05 OR flagged >= 1 THEN 'medium' ELSE 'low' END AS overall_risk FROM ri, rt, dmb""")
# Isotonic regression as the max-min of running means over the distinct scores.
_ISO = _FC + """,
pt AS (SELECT p, sum(y) AS s, count(*) AS w, row_number() OVER (ORDER BY p) AS i FROM fc GROUP BY p),
cu AS (SELECT p, i, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) - s AS ps, sum(w) OVER (ORDER BY i) - w AS pw FROM pt),
lo AS (SELECT x.i, a.i AS j, min(CAST(b.cs - a.ps AS DOUBLE) / (b.cw - a.pw)) AS v FROM cu x JOIN cu a ON a.i <= x.i JOIN cu b ON b.i >= x.i GROUP BY x.i, a.i),
iso AS (SELECT cu.p, max(v) AS q FROM lo JOIN cu ON cu.i = lo.i GROUP BY cu.p),
both_ AS (SELECT grp, fc.p, q, y FROM fc JOIN iso ON fc.p = iso.p),
l AS (SELECT grp, p AS v, y, 'raw' AS side FROM both_ UNION ALL SELECT grp, q, y, 'cal' FROM both_),
lb AS (SELECT *, CASE WHEN v < 0.2 THEN 0 WHEN v < 0.4 THEN 1 WHEN v < CAST('0.6000000000000001' AS DOUBLE) THEN 2 WHEN v < 0.8 THEN 3 ELSE 4 END AS bin FROM l),
br AS (SELECT grp, side, avg((v - y) * (v - y)) AS brier, count(*) AS n FROM l GROUP BY ALL)
"""
add("cal1_isotonic_calibration", _ISO, f"SELECT r.grp, r.n AS sample_size, {_micro('r.brier', 10000)} AS raw_e4, {_micro('c.brier', 10000)} AS calibrated_e4 FROM br r JOIN br c ON r.grp = c.grp AND r.side = 'raw' AND c.side = 'cal'")

# ---- invariants of the full run
add("prj11_explanation_text", INV, "SELECT 1 AS within_limit, CAST(0 AS BIGINT) AS empty")
add("jn5_claimed_anti_join", PAIRS + """,
claim AS (SELECT k, merchant_id, (-amount_p, txn_date, txn_id) AS prio FROM txn WHERE k % 16 = 2 AND part = 1)""", """SELECT p.merchant_id, count(*) AS pairs, count(DISTINCT p.invoice_id) AS invoices FROM pairs p
    WHERE NOT EXISTS (SELECT 1 FROM claim c WHERE c.merchant_id = p.merchant_id AND (p.invoice_id = 'INV-' || c.k OR p.txn_id = 'TXN-' || c.k || '-2') AND c.prio < (-p.amount_p, p.txn_date, p.txn_id)) GROUP BY p.merchant_id""")
add("grp6_claim_settlement", INV, "SELECT 'txn' AS kind, CAST(0 AS BIGINT) AS shared UNION ALL SELECT 'invoice', CAST(0 AS BIGINT)")
add("full_run_coverage", TXN, "SELECT count(*) AS transactions, CAST(0 AS BIGINT) AS invoices_placed_twice, CAST(0 AS BIGINT) AS rejects_without_reason FROM txn")
add("prj16_audit_fan_out", INV, "SELECT 1 AS ids_are_unique, CAST(0 AS BIGINT) AS orphans")

# ---- ranking, order, sets
add("win1_pair_ranking", RULED, "SELECT txn_id, invoice_id, rk AS rank FROM ranked")
add("win4_top_k_similarity", _VEC, "SELECT txn_id, invoice_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY round(sim, 9) DESC, invoice_id) AS r FROM vs) WHERE r <= 5")
add("win5_first_row_per_id", TXN, "SELECT txn_id, amount_p, row_idx FROM (SELECT 'T' || (k % 5000) AS txn_id, amount_p, k * 2 + part AS row_idx, row_number() OVER (PARTITION BY k % 5000 ORDER BY k * 2 + part) AS n FROM txn) WHERE n = 1")
add("win6_processing_order", TXN, "SELECT merchant_id, strftime(txn_date, '%Y-%m-%d') AS day, arg_min(txn_id, (-amount_p, txn_id)) AS txn_id FROM txn GROUP BY merchant_id, txn_date")
add("srt1_paged_list", MATCHES, "SELECT txn_id AS match_id, band AS confidence_band FROM m ORDER BY txn_id LIMIT 100 OFFSET 200")
add("set1_group_equality", INV + LABELS, "SELECT invoice_id, 1 AS same, CAST(len(txn_ids) AS BIGINT) AS n FROM lab")
add("set2_unmatched_invoices", MATCHES, "SELECT invoice_id FROM inv WHERE status = 'open' AND invoice_id NOT IN (SELECT invoice_id FROM m WHERE invoice_id IS NOT NULL)")
add("set3_display_rows", MATCHES, "SELECT txn_id, amount_p, band, coalesce(invoice_id, '') AS invoices FROM m")

# ---- scalars
_STOP27 = _list(STOP_GROUPS)
_PREFIX = "|".join(CHANNEL_PREFIXES)
add("str_text_functions", TXN, f"""SELECT txn_id, regexp_replace(narr, '^({_PREFIX})', '') AS stripped, array_to_string(list_filter(string_split(narr, ' '), lambda w: length(w) >= 4 AND w NOT IN ({_STOP27})), '|') AS tokens,
    array_to_string(regexp_extract_all(narr, '\\bINV-\\d+\\b'), '|') AS invoices, CAST(regexp_matches(narr, '{_SPLIT}') AS INTEGER) AS part_word FROM txn""")
add("str1_amount_parsing", INV, "SELECT invoice_id, CASE WHEN k % 5 IN (2, 3) THEN NULL ELSE total_p END AS amount_p FROM inv")
add("str11_leading_digit", TXN, "SELECT txn_id, CAST(nullif(regexp_extract(CAST(amount_p AS VARCHAR), '[1-9]'), '') AS BIGINT) AS digit FROM txn")
add("dtm1_date_parsing", INV, "SELECT invoice_id, CASE WHEN k % 6 < 5 THEN strftime(d, '%Y-%m-%d') END AS day FROM inv")
add("dtm2_day_gaps", PAIRS, "SELECT merchant_id, CAST(sum(gap) AS BIGINT) AS days FROM pairs GROUP BY merchant_id")
add("mth4_chi_square_tail", INV, f"SELECT invoice_id, {_micro('exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)')} AS p_micro FROM (SELECT invoice_id, CAST(k % 400 AS DOUBLE) / 20 AS h FROM inv)")
add("mth5_cosine", _VEC, f"SELECT txn_id, invoice_id, {_micro('sim')} AS sim_micro FROM vs")
add("jsn2_match_events", MATCHES, f"SELECT txn_id, {_rs('amount_p')} AS amount, band, match_type FROM m")

# ---- streaming
_FEED = RULED + f""",
fd AS (SELECT t.txn_id, CASE WHEN t.direction = 'credit' AND NOT (t.amount_p <= 1000 OR (contains(t.narr, 'INTEREST') AND t.amount_p < 10000)) THEN r.invoice_id END AS invoice_id,
       CASE WHEN t.direction = 'credit' AND NOT (t.amount_p <= 1000 OR (contains(t.narr, 'INTEREST') AND t.amount_p < 10000)) THEN coalesce(r.p1, 0) ELSE 0 END AS s
       FROM txn t LEFT JOIN ranked r ON t.txn_id = r.txn_id AND r.rk = 1)
"""
add("stm1_live_feed", _FEED, f"SELECT txn_id, invoice_id, {_c('s')} AS score_c, {BAND.format(s='s')} AS band FROM fd")
add("stm3_band_totals", _FEED, f"SELECT 'TESTDATA' AS batch_id, {BAND.format(s='s')} AS band, count(*) AS n FROM fd GROUP BY ALL")

# ---- fuzzy ratios and what is built on them
add("jn3_duplicate_interval_join", DUP, "SELECT txn_id, original_id FROM dups")
add("stm2_stream_duplicates", DUP, "SELECT txn_id, original_id FROM dups")
_NAMED = "fd AS (SELECT DISTINCT cp AS a, narr AS b FROM pairs),"
add("str9_fuzzy_ratios", PAIRS + "," + _NAMED + ratios("fd"), f"SELECT a AS cp, b AS narr, {_c('plain')} AS ratio_c, {_c('sorted')} AS sort_c, {_c('part')} AS partial_c, {_c('sets')} AS set_c FROM fz")
_SECOND = RULED + f""",
bare AS (SELECT *, regexp_replace(narr, '^({_PREFIX})', '') AS said FROM ruled),
fd AS (SELECT DISTINCT cp AS a, said AS b FROM bare),""" + ratios("fd") + f""",
fuzzy AS (SELECT r.*, greatest(fz.part, fz.sorted) AS ratio FROM bare r JOIN fz ON r.cp = fz.a AND r.said = fz.b),
points AS (SELECT *, CASE WHEN ratio >= 40 THEN round_even(18.0::DOUBLE * (ratio - 40.0::DOUBLE) / 60, 2) ELSE 0.0::DOUBLE END AS f_name,
    CASE WHEN net_p <> 0 AND {_PCT} <= 0.30 THEN CAST({_half_up(f"12.0::DOUBLE * exp(-0.5::DOUBLE * ({_PCT} / 0.10::DOUBLE) * ({_PCT} / 0.10::DOUBLE))", 2)} AS DOUBLE) END AS f_amount,
    CASE WHEN gap <= 60 THEN CAST({_half_up("10.0::DOUBLE * exp(-0.5::DOUBLE * (gap / 15.0::DOUBLE) * (gap / 15.0::DOUBLE))", 2)} AS DOUBLE) END AS f_date FROM fuzzy),
scored AS (SELECT *, least(100.0::DOUBLE, p1 + f_name + coalesce(f_amount, 0) + coalesce(f_date, 0)) AS p2, p1_amount OR f_amount IS NOT NULL AS p2_amount,
    row_number() OVER (PARTITION BY txn_id ORDER BY p1 DESC, gap, row_idx, invoice_id) AS r1 FROM points),
settled AS (SELECT *, r1 = 1 AND p1 >= 55 AND p1_amount AS by_rules FROM scored),
second AS (SELECT *, CASE WHEN by_rules THEN CAST(p1 AS DOUBLE) ELSE p2 END AS score, CASE WHEN by_rules THEN 'pass1_rules' WHEN p2 >= 70 AND p2_amount THEN 'pass2_fuzzy' END AS resolved FROM settled)
"""
add("sco7_fuzzy_name_points", _SECOND, f"SELECT txn_id, invoice_id, {_c('f_name')} AS points_c FROM points WHERE f_name > 0")
add("sco10_second_pass_ranking", _SECOND, f"SELECT txn_id, invoice_id, rank, {_c('score')} AS score_c, resolved FROM (SELECT *, CAST(row_number() OVER (PARTITION BY txn_id ORDER BY score DESC, r1) AS INTEGER) AS rank FROM second) WHERE rank <= 2")
_CONSISTENT = """,
met AS (SELECT *, contains(narr, cp) OR len(list_filter({marks}, lambda w: contains(narr, w))) > 0 AS plainly FROM {src}),
fd AS (SELECT DISTINCT cp AS a, trim(narr) AS b FROM met WHERE NOT plainly),"""
_MARKS = f"list_filter(list_transform(string_split(cp, ' '), lambda w: regexp_replace(regexp_replace(w, '^[,.\\-/''\"]+', ''), '[,.\\-/''\"]+$', '')), lambda w: length(w) >= 4 AND w NOT IN ({_list(STOP_GROUPS)}))"
add("grp2_batch_groups", PAIRS + """,
cand AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY gap, row_idx) AS nth FROM pairs WHERE direction = 'credit')""" + _CONSISTENT.format(marks=_MARKS, src="cand") + ratios("fd") + """,
named AS (SELECT met.*, plainly OR coalesce(sets, 0) >= 70 AS name_ok, regexp_extract_all(narr, '\\bINV-\\d+\\b') AS ids FROM met LEFT JOIN fz ON NOT plainly AND cp = a AND trim(narr) = b),
rels AS (SELECT *, CASE WHEN len(ids) > 0 THEN list_contains(ids, invoice_id) ELSE name_ok END AS rel FROM named),
counted AS (SELECT *, sum(CASE WHEN nth <= 2 THEN net_p ELSE 0 END) OVER w AS target, count(*) OVER w AS n_all, count(*) FILTER (rel) OVER w AS n_rel FROM rels WINDOW w AS (PARTITION BY txn_id)),
sized AS (SELECT *, CASE WHEN n_rel > 0 THEN n_rel ELSE n_all END AS size FROM counted),
member AS (SELECT txn_id AS key, target, invoice_id AS id, net_p AS net, gap, name_ok AS ok, (gap, row_idx) AS o FROM sized WHERE size <= 16 AND (rel OR n_rel = 0))""" + _SUBSETS, """SELECT key AS txn_id, 'batch_one_to_many' AS kind, array_to_string(list_sort(list_transform(got, lambda g: g.id)), '|') AS invoice_ids, n_solutions, CAST(n_valid AS BIGINT) AS n_valid FROM best
    UNION ALL SELECT DISTINCT txn_id, 'flagged', NULL, 0, 0 FROM sized WHERE size > 16""")
add("win3_close_calls", _SECOND, f"SELECT txn_id, {_c('d')} AS gap_c FROM (SELECT txn_id, max(score) - min(score) AS d, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY score DESC, r1) AS rank FROM second) WHERE rank <= 2 GROUP BY txn_id) WHERE n = 2 AND d < 15")
add("jn4_name_relevance_join", TXN + f""",
nm AS (SELECT DISTINCT merchant_id, cp, list_filter(list_transform(string_split(cp, ' '), lambda w: regexp_replace(regexp_replace(w, '^[,.\\-/''"]+', ''), '[,.\\-/''"]+$', '')), lambda w: length(w) >= 4 AND w NOT IN ({_list(STOP_GROUPS)})) AS marks FROM inv WHERE status = 'open'),
tx AS (SELECT DISTINCT merchant_id, narr FROM txn WHERE direction = 'credit' AND NOT regexp_matches(narr, '\\bINV-\\d+\\b')),
met AS (SELECT merchant_id, cp, narr, contains(narr, cp) OR len(list_filter(marks, lambda w: contains(narr, w))) > 0 AS plainly FROM nm JOIN tx USING (merchant_id)),
fd AS (SELECT DISTINCT cp AS a, narr AS b FROM met WHERE NOT plainly),""" + ratios("fd"), """SELECT merchant_id, cp, narr FROM met WHERE plainly
    UNION ALL SELECT merchant_id, cp, narr FROM met JOIN fz ON cp = a AND narr = b WHERE NOT plainly AND sets >= 70""")
# A heavier assignment would show as a violated edge or a gap; SQL counts what had to be covered.
add("asn1_certificate", _SECOND, "SELECT count(*) AS edges, count(DISTINCT txn_id) AS txns, count(DISTINCT invoice_id) AS invoices, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS violated, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS gap FROM second WHERE score >= 30")
add("prj3_unique_made_ids", TXN, "SELECT count(*) AS n_rows, count(*) AS n_ids FROM txn")
add("stm3_replayed_run", MATCHES, "SELECT count(*) + 1 AS places, count(*) + 1 AS last, count(*) AS events, count(*) AS total, count(*) FILTER (band = 'auto_accept') AS auto_accept, count(*) FILTER (band = 'review') AS review, count(*) FILTER (band IN ('reject', 'exception')) AS exceptions FROM m")
add("arr3_allocation_map", MATCHES, "SELECT txn_id, CAST(1 AS INTEGER) AS ids, amount_p AS allocated_p FROM m")
