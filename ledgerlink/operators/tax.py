"""GST and TDS arithmetic on decimals (PRJ-5, PRJ-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlink.schemas import MONEY

# TDS rate per section; sections not listed use the last one.
TDS_RATES = {"194J": "0.10", "194C": "0.02", "194I": "0.10", "194Q": "0.001"}
TDS_OTHER = "0.10"


def _rupee(c: Column) -> Column:
    """Two decimals, half-up (Spark's decimal round)."""
    return F.round(c, 2).cast(MONEY)


def gst_parts(base: Column, rate_percent: Column, intrastate: Column) -> dict[str, Column]:
    """PRJ-5: same-state invoices split the tax in two rounded halves, others carry it whole."""
    zero = F.lit(0).cast(MONEY)
    total = _rupee(base * rate_percent / 100)
    half = _rupee(total / 2)
    return {
        "cgst_amount": F.when(intrastate, half).otherwise(zero),
        "sgst_amount": F.when(intrastate, half).otherwise(zero),
        "igst_amount": F.when(intrastate, zero).otherwise(total),
    }


def tds_rate(section: Column) -> Column:
    out = F.when(section.isNull(), F.lit("0"))
    for name, rate in TDS_RATES.items():
        out = out.when(section == name, F.lit(rate))
    return out.otherwise(F.lit(TDS_OTHER)).cast("decimal(6,4)")


def derive(df: DataFrame) -> DataFrame:
    """Adds tax parts, total, TDS and net to rows with base_amount, gst_rate, intrastate, tds_section (PRJ-6)."""
    base = F.col("base_amount")
    out = df.withColumns(gst_parts(base, F.col("gst_rate").cast("decimal(6,2)"), F.col("intrastate")))
    out = out.withColumn("total_amount", _rupee(base + F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")))
    out = out.withColumn("tds_amount", _rupee(base * tds_rate(F.col("tds_section"))))
    return out.withColumn("expected_net_amount", _rupee(F.col("total_amount") - F.col("tds_amount")))
