"""Blend, bands, gates, contributions and texts of the chosen pair (SCO-12, SCO-15..18, PRJ-11..15)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlink.functions import scalars as fx
from ledgerlink.operators.scoring import band
from ledgerlink.params import DEFAULT, Params

TEXT_MAX = 280


def final_score(heuristic: Column, linkage: Column | None, delta: Column | None, params: Params = DEFAULT) -> Column:
    """SCO-15, not rounded."""
    d = fx.clip(F.coalesce(delta, F.lit(0.0)), -params.delta_limit, params.delta_limit) if delta is not None else F.lit(0.0)
    mixed = heuristic
    if linkage is not None:
        mixed = F.when(linkage.isNull(), heuristic).otherwise(
            params.blend_heuristic * heuristic + params.blend_linkage * linkage
        )
    return fx.clip(mixed + d, 0, 100)


def gate(score: Column, needs_review: Column, flagged: Column, is_exception: Column | None = None, params: Params = DEFAULT) -> Column:
    """SCO-17: name of the first gate that applies, else null."""
    auto = band(score, params) == "auto_accept"
    exc = is_exception if is_exception is not None else F.lit(False)
    return (
        F.when(exc, "exception")
        .when(score < params.hard_floor, "hard_floor")
        .when(needs_review & auto, "human_review")
        .when(flagged & auto, "flagged")
    )


def decision(score: Column, gate_name: Column, params: Params = DEFAULT) -> Column:
    return (
        F.when(gate_name.isin("exception", "hard_floor"), "reject")
        .when(gate_name.isin("human_review", "flagged"), "review")
        .otherwise(band(score, params))
    )


def eligible_for_adjudication(score: Column, needs_review: Column, flagged: Column, params: Params = DEFAULT) -> Column:
    """FLT-10: looks at the heuristic score, not at the blended one."""
    return (score >= params.hard_floor) & (
        flagged | needs_review | ((score >= params.threshold_review) & (score < params.threshold_auto_accept))
    )


def _entry(source: Column | str, delta: Column, reason: Column, fired: Column) -> Column:
    src = F.lit(source) if isinstance(source, str) else source
    return F.struct(
        src.alias("source"),
        F.coalesce(delta, F.lit(0.0)).cast("double").alias("delta"),
        reason.alias("reason"),
        F.coalesce(fired, F.lit(False)).alias("fired"),
    )


def _money(c: Column) -> Column:
    return F.concat(F.lit("₹"), c.cast("string"))


def contributions() -> Column:
    """Ordered signals of passes 1-3 for a chosen pair row, fired or not."""
    gap = F.col("gap").cast("string")
    ref_reason = (
        F.when(F.col("s_ref") == 40, F.concat(F.lit("Reference numbers agree: "), F.col("t_ref")))
        .when(F.col("s_ref") == 20, F.concat(F.lit("Truncated reference agrees: "), F.least("t_ref", "i_ref")))
        .when(F.col("s_ref") == 35, F.concat(F.lit("Narration names invoice "), F.col("invoice_id")))
        .otherwise(F.lit("No reference evidence"))
    )
    amount_reason = (
        F.when(F.col("k_amount") == "exact", F.concat(F.lit("Paid "), _money(F.col("amount")), F.lit(", net due "), _money(F.col("expected_net_amount"))))
        .when(F.col("k_amount") == "gross", F.concat(F.lit("Paid "), _money(F.col("amount")), F.lit(", gross total "), _money(F.col("total_amount"))))
        .otherwise(F.lit("Amount outside tolerance"))
    )
    formula_reason = (
        F.when(F.col("k_formula") == "tds", F.concat(F.lit("Total less TDS "), _money(F.col("tds_amount")), F.lit(" (section "), F.coalesce("tds_section", F.lit("N/A")), F.lit(")")))
        .when(F.col("k_formula") == "gateway", F.concat(F.lit("Net less 2.36% gateway fee: "), _money((F.col("gateway_p") / 100).cast("decimal(18,2)"))))
        .otherwise(F.lit("No derived amount fits"))
    )
    name_reason = (
        F.when(F.col("s_name") == 35, F.concat(F.lit("Narration holds the name "), F.col("cp")))
        .when(F.col("s_name") == 15, F.lit("Narration holds part of the name"))
        .otherwise(F.lit("Name not in narration"))
    )
    past1 = F.coalesce(F.col("resolved"), F.lit("")) != "pass1_rules"
    entries = F.array(
        _entry("pass1_utr", F.col("s_ref"), ref_reason, F.col("s_ref") > 0),
        _entry(F.when(F.col("k_amount") == "gross", "pass1_amount_gross").otherwise("pass1_amount_exact"), F.col("s_amount"), amount_reason, F.col("s_amount") > 0),
        _entry(
            F.when(F.col("k_formula") == "tds", "pass1_tds_adjusted").when(F.col("k_formula") == "gateway", "pass1_gateway_fee").otherwise("pass1_formula"),
            F.col("s_formula"), formula_reason, F.col("s_formula") > 0,
        ),
        _entry("pass1_date", F.col("s_date"), F.concat(gap, F.lit(" days between payment and invoice")), F.col("s_date") > 0),
        _entry(F.when(F.col("s_name") == 35, "pass1_name_exact").otherwise("pass1_name_token"), F.col("s_name"), name_reason, F.col("s_name") > 0),
    )
    fuzzy = F.array_compact(
        F.array(
            F.when(past1, _entry("pass2_name_fuzzy", F.col("f_name"), F.format_string("Name similarity %.0f of 100", F.col("f_ratio")), F.col("f_ratio") >= 40)),
            F.when(past1 & (F.col("net_p") != 0), _entry("pass2_amount_fuzzy", F.col("f_amount"), F.lit("Amount close to the net due"), F.col("f_amount").isNotNull())),
            F.when(past1, _entry("pass2_date_fuzzy", F.col("f_date"), F.concat(F.lit("Date closeness at "), gap, F.lit(" days")), F.col("f_date").isNotNull())),
            F.when(
                past1 & F.col("sim").isNotNull() & (F.coalesce(F.col("resolved"), F.lit("")) != "pass2_fuzzy"),
                _entry("pass3_embedding", F.col("s_vec"), F.format_string("Text similarity %.3f", F.col("sim")), F.col("s_vec").isNotNull()),
            ),
        )
    )
    return F.concat(entries, fuzzy)


def explanation(contribs: Column, score: Column, gate_name: Column, decided: Column) -> Column:
    """PRJ-11: fired reasons, cut, then the gate note, cut again."""
    fired = F.transform(F.filter(contribs, lambda c: c["fired"]), lambda c: c["reason"])
    body = F.substring(F.array_join(fired, ". "), 1, TEXT_MAX)
    shown = F.when(body == "", F.concat(F.format_string("Score %.1f: ", score), decided)).otherwise(body)
    note = (
        F.when(gate_name == "human_review", F.lit(" [Review gate: human approval required]"))
        .when(gate_name == "flagged", F.lit(" [Review gate: awaiting adjudication]"))
        .when(gate_name == "hard_floor", F.format_string(" [Reject gate: score %.1f under the hard floor]", score))
        .when(gate_name == "exception", F.lit(" [Exception]"))
        .otherwise(F.lit(""))
    )
    return F.substring(F.concat(shown, note), 1, TEXT_MAX)


def explanation_source(resolved: Column, provider: Column | None = None) -> Column:
    """PRJ-12."""
    by_pass = (
        F.when(resolved.startswith("pass1"), "rules_engine")
        .when(resolved.startswith("pass2"), "fuzzy")
        .when(resolved.startswith("pass3") | resolved.startswith("pass4"), "embedding")
        .when(resolved.startswith("pass5"), "llm")
        .otherwise("none")
    )
    if provider is None:
        return by_pass
    return F.when(provider.isin("gemini", "groq"), "llm").otherwise(by_pass)


def audit_pass(source: Column) -> Column:
    """PRJ-13."""
    out = F.when(source.startswith("pass1"), "pass1_rules")
    for prefix, name in [
        ("pass2", "pass2_fuzzy"), ("pass3", "pass3_embedding"), ("pass4", "pass4_split_matcher"), ("pass5", "pass5_llm"),
    ]:
        out = out.when(source.startswith(prefix), name)
    return out.otherwise("confidence_scorer")


def exclusion_detail(category: Column) -> Column:
    """PRJ-14: detail text of the pre-pass categories."""
    return (
        F.when(category == "debit_transaction", F.concat(F.lit("Debit or refund needs manual handling: "), F.col("narration")))
        .when(category == "noise_below_floor", F.concat(F.lit("Amount "), _money(F.col("amount")), F.lit(" is below the noise floor")))
        .when(category == "duplicate_detected", F.concat(F.lit("Likely copy of "), F.col("original_id"), F.lit(": same amount and text within 3 days")))
        .when(category == "no_candidate_found", F.lit("No open invoice of this merchant in the date window"))
    )


def stable_id(prefix: str, *cols) -> Column:
    """Deterministic row id: the same inputs give the same id on a retry."""
    body = F.concat_ws("|", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 16))
