"""Rules-only run: exclusions, best pair by the rule pass, bands.  One search by terms, no iteration.

It is the engine's quick look at a batch and the input of the report queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlink.operators import candidates as cand, decide, scoring
from ledgerlink.operators.duplicates import find_duplicates
from ledgerlink.operators.rule_search import best_by_rules
from ledgerlink.params import DEFAULT, Params


def same_text(a, b):
    return a == b


def rules_run(txns: DataFrame, invoices: DataFrame, run_id: str, params: Params = DEFAULT, similar=None) -> DataFrame:
    """Match rows (a subset of the full run's columns) with one line item each."""
    t = cand.txn_view(txns)
    pre = cand.prepass(t, find_duplicates(t, params, similar), params)
    todo = pre.where(F.col("excluded_as").isNull()).drop("original_id", "excluded_as")
    top = best_by_rules(todo, cand.invoice_view(invoices, params), params).select(
        *scoring.TXN, F.col("invoice_id").alias("top_invoice"), "p1", "resolved"
    )
    rows = pre.join(top, scoring.TXN, "left")
    found = F.col("top_invoice").isNotNull()
    score = F.coalesce("p1", F.lit(0.0))
    band = scoring.band(score, params)
    category = F.coalesce(
        "excluded_as", F.when(~found, "no_candidate_found").when(band == "reject", "low_confidence_match")
    )
    item = F.struct("txn_id", F.col("top_invoice").alias("invoice_id"), F.col("amount").alias("allocated_amount"))
    return rows.select(
        decide.stable_id("MATCH-", "batch_id", "merchant_id", F.lit(run_id), "txn_id").alias("match_id"),
        "batch_id", F.lit(run_id).alias("run_id"),
        F.when(found, "one_to_one").otherwise("exception").alias("match_type"),
        score.alias("confidence_score"), band.alias("confidence_band"),
        F.concat(F.lit("Rule score "), F.format_string("%.0f", score)).alias("explanation_text"),
        F.when(found & F.col("resolved").isNull(), "none").otherwise("rules_engine").alias("explanation_source"),
        F.array(item).alias("line_items"),
        category.alias("exception_reason_category"),
        decide.exclusion_detail(category).alias("exception_reason_detail"),
        F.lit(False).alias("pending_llm_enrichment"),
        F.lit(None).cast("string").alias("pending_llm_reason"),
        F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("string").alias("review_action"),
    )
