"""First-digit statistics (AGG-11, AGG-12)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlink.functions.scalars import chi_square_sf8, leading_digit

MIN_SAMPLE = 10


def benford_share(d: Column) -> Column:
    return F.log10(1 + 1 / d)


def invoice_amount() -> Column:
    """Total, else net, else base: a zero counts as absent."""
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce(F.nullif("total_amount", zero), F.nullif("expected_net_amount", zero), F.col("base_amount"))


def digit_counts(df: DataFrame, amount: Column, keys: list[str]) -> DataFrame:
    """One row per key with nine counts: a single aggregation, no row per (key, digit) until it is small."""
    d = leading_digit(amount)
    return df.withColumn("_d", d).groupBy(*keys).agg(*[F.count_if(F.col("_d") == k).alias(f"_c{k}") for k in range(1, 10)])


def digit_distribution(df: DataFrame, amount: Column, keys: list[str]) -> DataFrame:
    """AGG-11 breakdown: key, digit, observed_count, observed_pct, expected_pct, residual."""
    counts = digit_counts(df, amount, keys)
    total = sum((F.col(f"_c{k}") for k in range(1, 10)), F.lit(0))
    rows = F.array(*[F.struct(F.lit(k).alias("digit"), F.col(f"_c{k}").alias("n")) for k in range(1, 10)])
    out = counts.withColumn("total", total).select(*keys, "total", F.inline(rows))
    share = F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total"), 4)).otherwise(0.0)
    expect = F.col("total") * benford_share(F.col("digit"))
    return out.select(
        *keys, "digit", F.col("n").alias("observed_count"), F.round(share * 100, 1).alias("observed_pct"),
        F.round(benford_share(F.col("digit")) * 100, 1).alias("expected_pct"),
        F.when(F.col("total") >= MIN_SAMPLE, F.round((F.col("n") - expect) / F.sqrt(expect), 2)).otherwise(0.0).alias("residual"),
    )


def digit_test(df: DataFrame, amount: Column, keys: list[str]) -> DataFrame:
    """AGG-11 test: chi-square over nine digits, p-value with 8 degrees of freedom, risk level."""
    counts = digit_counts(df, amount, keys)
    n = sum((F.col(f"_c{k}") for k in range(1, 10)), F.lit(0))
    out = counts.withColumn("n", n)
    chi = F.lit(0.0)
    for k in range(1, 10):
        e = F.col("n") * F.lit(math.log10(1 + 1 / k))
        chi = chi + (F.col(f"_c{k}") - e) * (F.col(f"_c{k}") - e) / F.nullif(e, F.lit(0.0))
    few = F.col("n") < MIN_SAMPLE
    out = out.withColumn("_chi", F.when(few, 0.0).otherwise(chi)).withColumn("_p", F.when(few, 1.0).otherwise(chi_square_sf8(F.col("_chi"))))
    return out.select(
        *keys, "n", F.round("_chi", 2).alias("chi2"), F.round("_p", 4).alias("p_value"),
        F.when(few, "insufficient_data").when(F.col("_p") >= 0.05, "low").when(F.col("_p") >= 0.01, "medium").otherwise("high").alias("risk_level"),
    )


def dominant_counterparties(invoices: DataFrame, keys: list[str], min_invoices: int = 3, threshold: float = 0.60) -> DataFrame:
    """AGG-12: counterparties whose amounts cluster on one leading digit; ties take the smaller digit."""
    zero = F.lit(0).cast("decimal(18,2)")
    amount = F.coalesce(F.nullif("total_amount", zero), F.nullif("expected_net_amount", zero))
    named = invoices.where(F.nullif("counterparty_name", F.lit("")).isNotNull()).withColumn("_a", amount).where(F.col("_a").isNotNull())
    k = [*keys, "counterparty_name"]
    d = leading_digit(F.col("_a"))
    counts = named.withColumn("_d", d).groupBy(*k).agg(
        F.count("*").alias("total_invoices"), F.sum("_a").alias("total_amount_sum"),
        *[F.count_if(F.col("_d") == x).alias(f"_c{x}") for x in range(1, 10)],
    )
    best = F.greatest(*[F.col(f"_c{x}") for x in range(1, 10)])
    digit = F.coalesce(*[F.when(F.col(f"_c{x}") == best, x) for x in range(1, 10)])
    valid = sum((F.col(f"_c{x}") for x in range(1, 10)), F.lit(0))
    out = counts.where((F.col("total_invoices") >= min_invoices) & (valid > 0)).withColumn("ratio", best / valid).where(F.col("ratio") >= threshold)
    pct = F.round(F.col("ratio") * 100, 1)
    return out.select(
        *k, "total_invoices", digit.alias("dominant_leading_digit"), best.alias("dominant_digit_count"), pct.alias("dominant_ratio"), "total_amount_sum",
        F.concat(best.cast("string"), F.lit(" of "), F.col("total_invoices").cast("string"), F.lit(" invoices start with digit "), digit.cast("string")).alias("flag_reason"),
    )


def ordered(dominant: DataFrame) -> DataFrame:
    """SRT-3."""
    return dominant.orderBy(F.desc("dominant_ratio"), F.desc("total_invoices"), "counterparty_name")


def batch_risk(invoices: DataFrame, txns: DataFrame) -> DataFrame:
    """AGG-12: overall risk per batch."""
    i = digit_test(invoices, invoice_amount(), ["batch_id"]).select("batch_id", F.col("n").alias("n_invoices"), F.col("risk_level").alias("invoice_risk"))
    t = digit_test(txns, F.col("amount"), ["batch_id"]).select("batch_id", F.col("n").alias("n_transactions"), F.col("risk_level").alias("transaction_risk"))
    s = dominant_counterparties(invoices, ["batch_id"]).groupBy("batch_id").agg(F.count("*").alias("flagged"))
    out = i.join(t, "batch_id", "full").join(s, "batch_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))

    def any_is(level: str) -> Column:
        return F.coalesce(F.col("invoice_risk") == level, F.lit(False)) | F.coalesce(F.col("transaction_risk") == level, F.lit(False))

    return out.withColumn(
        "overall_risk",
        F.when(any_is("high") | (F.col("flagged") >= 3), "high").when(any_is("medium") | (F.col("flagged") >= 1), "medium").otherwise("low"),
    )
