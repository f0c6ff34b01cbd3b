"""Derives reconciliation inputs from star-schema tables by key arithmetic, so that SQL can repeat it.

Invoices come from orders; transactions are the payments of those invoices with one settlement case per
key modulo 16.  Nothing here is random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlink.schemas import MONEY

BATCH = "TESTDATA"
SUFFIXES = ["TRADERS", "LOGISTICS", "PVT LTD", "INDUSTRIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _from_paise(p: Column) -> Column:
    return (p.cast(MONEY) / 100).cast(MONEY)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_part = part.agg(F.count("*")).scalar()
    first = part.agg(F.min("p_partkey")).scalar()
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = orders.withColumn("part_key", c % n_part + first)
    total_p = F.round(F.col("o_totalprice").cast(MONEY) * 100, 0).cast("bigint")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (c % 4 + 1).cast("int"))
    return (
        # Both tables grow with the orders: they are sorted and merged, never sent through the driver.
        base.join(customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        .join(part.hint("merge"), F.col("part_key") == F.col("p_partkey"))
        .withColumn("total_p", total_p)
        .withColumn("tds_p", F.when(k % 16 == 0, F.expr("total_p div 10")).otherwise(F.lit(0).cast("bigint")))
        .withColumn("base_p", F.expr("total_p * 100 div 118"))
        .withColumn("gst_p", F.col("total_p") - F.col("base_p"))
        .withColumn("half_p", F.when(k % 5 < 3, F.expr("gst_p div 2")).otherwise(F.lit(0)))
        .select(
            F.concat(F.lit("INV-"), k).alias("invoice_id"),
            F.concat(F.lit("MER-"), F.col("c_nationkey"), F.lit("-"), F.col("c_mktsegment")).alias("merchant_id"),
            F.lit(BATCH).alias("batch_id"),
            F.concat(F.upper("p_name"), F.lit(" "), suffix).alias("counterparty_name"),
            F.col("o_orderdate").cast("date").alias("invoice_date"),
            _from_paise(F.col("base_p")).alias("base_amount"),
            _from_paise(F.col("total_p")).alias("total_amount"),
            _from_paise(F.col("total_p") - F.col("tds_p")).alias("expected_net_amount"),
            F.when(F.col("tds_p") > 0, F.lit("194J")).alias("tds_section"),
            _from_paise(F.col("tds_p")).alias("tds_amount"),
            _from_paise(F.col("half_p")).alias("cgst_amount"),
            _from_paise(F.when(k % 5 < 3, F.col("gst_p") - F.col("half_p")).otherwise(0)).alias("sgst_amount"),
            _from_paise(F.when(k % 5 < 3, F.lit(0)).otherwise(F.col("gst_p"))).alias("igst_amount"),
            F.when(k % 16 != 5, F.concat(F.lit("UTR"), F.lpad(k.cast("string"), 9, "0"))).alias("reference_number"),
            F.when(F.col("o_orderstatus") == "O", "open")
            .when(F.col("o_orderstatus") == "F", "settled")
            .otherwise("partially_settled")
            .alias("status"),
            k.cast("bigint").alias("row_idx"),
        )
    )


def transactions(inv: DataFrame) -> DataFrame:
    """Payments of every invoice; see the README for the case table."""
    k = F.col("row_idx")
    case = k % 16
    total_p = (F.col("total_amount") * 100).cast("bigint")
    net_p = (F.col("expected_net_amount") * 100).cast("bigint")
    forty = F.expr("total_p * 2 div 5")
    parts = inv.withColumn("total_p", total_p).withColumn("net_p", net_p).withColumn(
        "part", F.explode(F.when(case.isin(2, 4), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    )
    amount_p = (
        F.when(case == 0, F.col("net_p"))
        .when(case == 1, F.col("total_p") + 150)
        .when((case == 2) & (F.col("part") == 1), forty)
        .when(case == 2, F.col("total_p") - forty)
        .when(case == 3, forty)
        .when(case == 9, F.lit(500))
        .otherwise(F.col("total_p"))
    )
    days = F.lit(3) + F.when(case == 7, 50).otherwise(0) + F.when((case == 4) & (F.col("part") == 2), 1).otherwise(0)
    channel = F.element_at(F.array(*[F.lit(x) for x in ["UPI", "NEFT", "IMPS", "RTGS", "cheque"]]), (k % 5 + 1).cast("int"))
    prefix = F.element_at(
        F.array(*[F.lit(x) for x in ["UPI/", "NEFT-", "IMPS/", "RTGS/", "CHQ DEP "]]), (k % 5 + 1).cast("int")
    )
    name = (
        F.when(case == 9, F.lit("SB INTEREST CREDIT"))
        .when(k % 7 == 5, F.lit("FUNDS TRANSFER"))
        .when(k % 7 == 3, F.substring("counterparty_name", 1, 8))
        .otherwise(F.col("counterparty_name"))
    )
    tail = (
        F.when(case == 2, F.concat(F.lit(" PART "), F.col("part"), F.lit(" "), F.col("invoice_id")))
        .when(case == 3, F.lit(" ADVANCE"))
        .otherwise(F.lit(" SETTLEMENT"))
    )
    return parts.select(
        F.concat(F.lit("TXN-"), k, F.lit("-"), F.col("part")).alias("txn_id"),
        "merchant_id",
        "batch_id",
        F.date_add("invoice_date", days.cast("int")).alias("txn_date"),
        _from_paise(amount_p).alias("amount"),
        F.when(case == 8, "debit").otherwise("credit").alias("direction"),
        channel.alias("channel"),
        F.concat(prefix, name, tail).alias("narration"),
        F.when(case == 6, F.substring("reference_number", 1, 6)).otherwise(F.col("reference_number")).alias("reference_number"),
        F.col("row_idx"),
    )


def labels(inv: DataFrame) -> DataFrame:
    """Ground truth of the derived payments: one label per invoice, false for notices that settle nothing."""
    k = F.col("row_idx")
    case = k % 16
    one = F.concat(F.lit("TXN-"), k, F.lit("-1"))
    two = F.concat(F.lit("TXN-"), k, F.lit("-2"))
    return inv.select(
        "invoice_id",
        F.when(case == 2, F.array(one, two)).otherwise(F.array(one)).alias("txn_ids"),
        (~case.isin(8, 9)).alias("is_true_match"),
        case.cast("string").alias("case_category"),
        "batch_id",
        k.alias("row_idx"),
    )


class _Inputs(dict):
    """The three derived tables, each written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from ledgerlink.session import Workspace

        super().__init__()
        self.spark, self.sf_dir, self.ws = spark, sf_dir, Workspace(spark)

    def __missing__(self, name: str) -> DataFrame:
        made = invoices(self.spark, self.sf_dir) if name == "invoices" else {"transactions": transactions, "labels": labels}[name](self["invoices"])
        self[name] = self.ws.save(made, name)
        return self[name]


_WRITTEN: dict[tuple[str, str], dict[str, DataFrame]] = {}


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three derived tables, written once per session as Parquet the way an upload would store them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = _Inputs(spark, sf_dir)
    return _WRITTEN[key]
