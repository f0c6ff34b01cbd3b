"""Table schemas.  Schemas are declared, never inferred; money is decimal(18,2)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(9, 6)


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


S, D, B, TS, DBL = T.StringType(), T.DateType(), T.BooleanType(), T.TimestampType(), T.DoubleType()

MERCHANT = _st(("merchant_id", S), ("name", S), ("gstin", S), ("state_code", S), ("bank_account_masked", S))

TRANSACTION = _st(
    ("txn_id", S), ("merchant_id", S), ("batch_id", S), ("txn_date", D), ("value_date", D), ("amount", MONEY),
    ("direction", S), ("channel", S), ("narration", S), ("reference_number", S), ("running_balance", MONEY),
)

INVOICE = _st(
    ("invoice_id", S), ("merchant_id", S), ("batch_id", S), ("counterparty_name", S), ("counterparty_gstin", S),
    ("counterparty_state_code", S), ("invoice_date", D), ("due_date", D), ("base_amount", MONEY),
    ("cgst_amount", MONEY), ("sgst_amount", MONEY), ("igst_amount", MONEY), ("total_amount", MONEY),
    ("tds_section", S), ("tds_rate", RATE), ("tds_amount", MONEY), ("expected_net_amount", MONEY),
    ("reference_number", S), ("status", S),
)

LINE_ITEM = _st(("txn_id", S), ("invoice_id", S), ("allocated_amount", MONEY))

CONTRIBUTION = _st(("source", S), ("delta", DBL), ("reason", S), ("fired", B))

SNAPSHOT = _st(
    ("threshold_auto_accept", DBL), ("threshold_review", DBL), ("hard_floor_reject", DBL),
    ("amount_tolerance_rupees", DBL), ("candidate_date_window_days", DBL), ("embedding_similarity_floor", DBL),
    ("split_pool_max_size", DBL), ("fs_score", DBL), ("fs_blend", S),
)

MATCH = _st(
    ("match_id", S), ("batch_id", S), ("run_id", S), ("match_type", S), ("confidence_score", DBL),
    ("confidence_band", S), ("explanation_text", S), ("explanation_source", S),
    ("line_items", T.ArrayType(LINE_ITEM)), ("threshold_snapshot", SNAPSHOT),
    ("exception_reason_category", S), ("exception_reason_detail", S), ("pending_llm_enrichment", B),
    ("pending_llm_reason", S), ("created_at", TS), ("reviewed_by", S), ("reviewed_at", TS), ("review_action", S),
)

AUDIT = _st(
    ("log_id", S), ("match_id", S), ("batch_id", S), ("run_id", S), ("pass_name", S), ("score_delta", DBL),
    ("score_after", DBL), ("reasoning_text", S), ("raw_llm_response", S), ("llm_provider", S), ("llm_model", S),
    ("llm_fallback_used", B), ("llm_both_failed", B), ("timestamp", TS),
)

LABEL = _st(
    ("invoice_id", S), ("txn_ids", T.ArrayType(S)), ("is_true_match", B), ("case_category", S), ("batch_id", S),
    ("row_idx", T.LongType()),
)

# Accepted enum members.
DIRECTIONS = ["credit", "debit"]
CHANNELS = ["UPI", "NEFT", "IMPS", "RTGS", "cheque", "other"]
INVOICE_STATUSES = ["open", "settled", "partially_settled", "written_off"]
BANDS = ["auto_accept", "review", "reject"]
MATCH_TYPES = ["one_to_one", "split_many_to_one", "batch_one_to_many", "partial", "exception"]
