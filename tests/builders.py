"""Small input tables for tests."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import types as T

M = T.DecimalType(18, 2)
TXN = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("batch_id", T.StringType()), ("merchant_id", T.StringType()), ("txn_id", T.StringType()), ("txn_date", T.DateType()), ("amount", M),
        ("direction", T.StringType()), ("channel", T.StringType()), ("narration", T.StringType()), ("reference_number", T.StringType())]]
)
INV = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("batch_id", T.StringType()), ("merchant_id", T.StringType()), ("invoice_id", T.StringType()), ("invoice_date", T.DateType()), ("counterparty_name", T.StringType()),
        ("base_amount", M), ("total_amount", M), ("expected_net_amount", M), ("tds_amount", M), ("tds_section", T.StringType()), ("cgst_amount", M),
        ("sgst_amount", M), ("igst_amount", M), ("reference_number", T.StringType()), ("status", T.StringType()), ("row_idx", T.LongType())]]
)
NO = Decimal("0.00")


def day(s) -> date:
    return s if isinstance(s, date) else date.fromisoformat(s)


def txn(txn_id, on, amount, narration, direction="credit", channel="NEFT", ref=None, batch="B", merchant="M"):
    return dict(batch_id=batch, merchant_id=merchant, txn_id=txn_id, txn_date=day(on), amount=Decimal(str(amount)).quantize(NO), direction=direction,
                channel=channel, narration=narration, reference_number=ref)


def inv(invoice_id, on, name, net, total=None, tds=0, section=None, ref=None, status="open", gst=0, batch="B", merchant="M", row=0):
    total = net if total is None else total
    q = lambda x: Decimal(str(x)).quantize(NO)
    return dict(batch_id=batch, merchant_id=merchant, invoice_id=invoice_id, invoice_date=day(on), counterparty_name=name, base_amount=q(total),
                total_amount=q(total), expected_net_amount=q(net), tds_amount=q(tds), tds_section=section, cgst_amount=q(gst), sgst_amount=NO, igst_amount=NO,
                reference_number=ref, status=status, row_idx=row)


def txns_df(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in TXN) for r in rows], TXN)


def invs_df(spark, rows):
    return spark.createDataFrame([tuple({**r, "row_idx": k}[f.name] for f in INV) for k, r in enumerate(rows)], INV)
