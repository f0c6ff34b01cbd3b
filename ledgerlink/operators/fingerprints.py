"""Text fingerprints handed to any outside encoder (PRJ-8, PRJ-9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_LONG_DAY = "dd MMMM yyyy"


def transaction_text() -> Column:
    return F.concat_ws(
        " ", "narration",
        F.concat(F.lit("amount "), F.col("amount").cast("string")),
        F.concat(F.lit("date "), F.date_format("txn_date", _LONG_DAY)),
        F.concat(F.lit("channel "), F.nullif("channel", F.lit(""))),
    )


def invoice_text() -> Column:
    tds = F.when(
        F.col("tds_amount") > 0,
        F.concat(F.lit("tds deducted "), F.col("tds_amount").cast("string"), F.lit(" section "), F.coalesce("tds_section", F.lit(""))),
    )
    return F.concat_ws(
        " ", "counterparty_name",
        F.concat(F.lit("invoice amount "), F.col("expected_net_amount").cast("string")),
        tds,
        F.concat(F.lit("total "), F.col("total_amount").cast("string")),
        F.concat(F.lit("date "), F.date_format("invoice_date", _LONG_DAY)),
    )
