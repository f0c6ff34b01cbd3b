"""Engine views, pre-pass filters and the candidate range join (PRJ-4, FLT-1..7, JN-1, WIN-6)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlink.functions import scalars as fx
from ledgerlink.operators.tiles import TILE_ROWS, tiled
from ledgerlink.params import DEFAULT, Params
from ledgerlink.session import spread

CELL = ["batch_id", "merchant_id"]


def txn_view(txns: DataFrame) -> DataFrame:
    """Narrow transaction rows with everything the pair rules need computed once per row, not once per pair."""
    narr = F.upper(F.coalesce("narration", F.lit("")))
    return txns.select(
        "batch_id", "merchant_id", "txn_id", "txn_date", "amount", "direction", "channel", "narration",
        F.nullif(F.upper(F.trim("reference_number")), F.lit("")).alias("t_ref"),
        fx.paise(F.col("amount")).alias("amount_p"),
        narr.alias("narr"),
        fx.invoice_tokens(narr).alias("ids"),
    )


def invoice_view(invoices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Narrow invoice rows, amounts as paise, name upper-cased, gateway net precomputed."""
    zero = F.lit(0).cast("decimal(18,2)")
    gst = F.coalesce("cgst_amount", zero) + F.coalesce("sgst_amount", zero) + F.coalesce("igst_amount", zero)
    name = F.upper(F.trim(F.coalesce("counterparty_name", F.lit(""))))
    return invoices.select(
        "batch_id", "merchant_id", "invoice_id", "invoice_date", "base_amount", "total_amount", "expected_net_amount",
        "tds_amount", "tds_section", "status", "row_idx", "counterparty_name",
        F.nullif(F.upper(F.trim("reference_number")), F.lit("")).alias("i_ref"),
        fx.paise(F.col("expected_net_amount")).alias("net_p"),
        fx.paise(F.col("total_amount")).alias("total_p"),
        F.coalesce(fx.paise(F.col("tds_amount")), F.lit(0)).alias("tds_p"),
        fx.paise(F.bround(F.col("expected_net_amount") * F.lit(params.gateway_keep_rate).cast("decimal(6,4)"), 2)).alias("gateway_p"),
        fx.paise(gst).alias("gst_p"),
        name.alias("cp"),
        F.upper(F.trim("invoice_id")).alias("inv_u"),
        fx.token_heads(name, fx.STOP_RULES).alias("heads"),
        fx.name_marks(name).alias("marks"),
    )


def priority() -> Column:
    """WIN-6 as a comparable value instead of a row number: larger amounts first, then date, then id.

    Comparing structs needs no global or per-batch sort, so a hot batch never lands in one task.
    """
    return F.struct((-F.col("amount_p")).alias("neg"), F.col("txn_date").alias("day"), F.col("txn_id").alias("id"))


def is_noise(params: Params = DEFAULT) -> Column:
    """FLT-2."""
    small = F.col("amount") <= F.lit(params.noise_floor).cast("decimal(18,2)")
    interest = F.col("narr").contains("INTEREST") & (F.col("amount") < F.lit(params.interest_noise_floor).cast("decimal(18,2)"))
    return small | interest


def prepass(t: DataFrame, duplicates: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """FLT-1..4 and PRJ-14: exclusion category per transaction, first hit wins; null means 'go on to matching'.

    duplicates has (batch_id, merchant_id, txn_id, original_id) from JN-3.
    """
    key = ["batch_id", "merchant_id", "txn_id"]
    out = t.join(duplicates.select(*key, "original_id"), key, "left")
    category = (
        F.when(F.col("direction") == "debit", "debit_transaction")
        .when(is_noise(params), "noise_below_floor")
        .when(F.col("original_id").isNotNull(), "duplicate_detected")
    )
    return out.withColumn("excluded_as", category)


def in_window(params: Params = DEFAULT) -> Column:
    """FLT-6."""
    return (F.col("invoice_date") >= F.date_sub("txn_date", params.window_back_days)) & (
        F.col("invoice_date") <= F.date_add("txn_date", params.window_forward_days)
    )


def amount_window() -> Column:
    """FLT-7: amounts within 150 % of each other in one of three directions, or a direct signal.

    True for every pair of positive amounts (if the net is the larger one the last test holds, else the first),
    so it is evaluated for fidelity and never relied on for pruning.
    """
    a = F.col("amount_p")
    ref = F.when(F.col("direction") == "credit", F.col("net_p")).otherwise(F.col("total_p"))
    near = (F.abs(ref - a) * 2 <= a * 3) | (F.abs(F.col("total_p") - a) * 2 <= a * 3)
    return (a != 0) & near | ((ref != 0) & (F.abs(a - ref) * 2 <= ref * 3)) | F.col("narr").contains(F.col("inv_u")) | F.exists(
        F.filter(F.split("cp", r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(fx.STOP_WINDOW)),
        lambda w: F.col("narr").contains(w),
    )


def plain_txn() -> Column:
    """Rows that the amount window never parts from a plain invoice."""
    return F.coalesce(F.col("amount_p") > 0, F.lit(False))


def plain_invoice() -> Column:
    return F.coalesce((F.col("net_p") > 0) & (F.col("total_p") > 0), F.lit(False))


def window_totals(t: DataFrame, i: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """CELL, txn_id, n, nearest, gap_days: candidate pairs of a transaction, counted by days without being made.

    Positive amounts always pass the amount window, so only the days decide; a transaction with others of its own or
    with invoices of other amounts has a second row for those pairs.
    """
    due = i.where("status = 'open'")
    day = lambda c: F.unix_date(c).alias("day")
    asked = t.where(plain_txn() & F.col("txn_date").isNotNull()).select(*CELL, day("txn_date")).distinct().withColumns({"asks": F.lit(True), "n": F.lit(0).cast("bigint")})
    owed = due.where(plain_invoice() & F.col("invoice_date").isNotNull()).groupBy(*CELL, day("invoice_date")).agg(F.count("*").alias("n"))
    # Days of a merchant are few, whatever its rows, so one ordered pass over them counts what each day's window holds.
    days = asked.unionByName(owed.withColumn("asks", F.lit(False)).select(asked.columns)).groupBy(*CELL, "day").agg(F.bool_or("asks").alias("asks"), F.sum("n").alias("n"))
    by = Window.partitionBy(*CELL).orderBy("day")
    back, ahead = by.rangeBetween(-params.window_back_days, 0), by.rangeBetween(1, params.window_forward_days)
    held, at = F.when(F.col("n") > 0, F.col("day")), F.col("day")
    sums = {"n": F.col("n"), "at": F.col("n") * at}
    counts = days.withColumns(
        {f"{side}_{k}": F.coalesce(F.sum(v).over(w), F.lit(0)) for side, w in (("back", back), ("ahead", ahead)) for k, v in sums.items()}
        | {"back_near": F.max(held).over(back), "ahead_near": F.min(held).over(ahead)}
    ).where("asks and back_n + ahead_n > 0")
    near = F.least(at - F.col("back_near"), F.col("ahead_near") - at)
    gaps = at * F.col("back_n") - F.col("back_at") + F.col("ahead_at") - at * F.col("ahead_n")
    per_day = counts.select(*CELL, F.date_from_unix_date("day").alias("txn_date"), (F.col("back_n") + F.col("ahead_n")).alias("n"), near.alias("nearest"), gaps.alias("gap_days"))
    out = [t.where(plain_txn()).select(*CELL, "txn_id", "txn_date").join(per_day.hint("merge"), [*CELL, "txn_date"]).drop("txn_date")]
    for left, right in ((t.where(~plain_txn()), due), (t.where(plain_txn()), due.where(~plain_invoice()))):
        if not (left.isEmpty() or right.isEmpty()):
            pairs = candidate_pairs(left, right, params)
            out.append(pairs.groupBy(*CELL, "txn_id").agg(F.count("*").alias("n"), F.min("gap").alias("nearest"), F.sum("gap").alias("gap_days")))
    return functools.reduce(DataFrame.unionByName, out)


def candidate_pairs(t: DataFrame, i: DataFrame, params: Params = DEFAULT, tile_rows: int = TILE_ROWS, also: list[str] | None = None) -> DataFrame:
    """JN-1: every transaction with every open invoice of its merchant inside the date window.

    The range predicate becomes an equi-join on a date bucket as wide as the window: a transaction touches at
    most two buckets, an invoice lies in one, so no pair repeats.  Hot (merchant, bucket) cells are tiled.
    Rows meet only where the columns ``also`` agree, too.
    """
    span = params.window_span

    def bucket(day: Column) -> Column:
        return F.floor(F.unix_date(day) / span).cast("int")

    low = bucket(F.date_sub("txn_date", params.window_back_days))
    high = bucket(F.date_add("txn_date", params.window_forward_days))
    left = t.withColumn("_bucket", F.explode(F.sequence(low, high)))
    right = i.where(F.col("status") == "open").withColumn("_bucket", bucket(F.col("invoice_date")))
    l, r, keys = tiled(left, right, [*CELL, *(also or []), "_bucket"], ["txn_id"], ["invoice_id"], tile_rows)
    return (
        l.join(r, keys)
        .where(in_window(params) & amount_window())
        .drop("_bucket", "_tl", "_tr")
        .withColumn("gap", fx.day_gap(F.col("txn_date"), F.col("invoice_date")))
    )


def _met(t: DataFrame, i: DataFrame, params: Params, tile_rows: int) -> DataFrame:
    """Candidate pairs whose _key is equal."""
    return candidate_pairs(t.where("_key is not null"), i.where("_key is not null"), params, tile_rows, also=["_key"]).drop("_key")


def pairs_near_amount(t: DataFrame, i: DataFrame, owed: Column, within: int, params: Params = DEFAULT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The candidate pairs whose invoice has an amount ``owed`` within so many paise of the paid one; no other is made."""
    place = lambda c: F.floor(c / F.lit(32 * (within + 1)))
    paid = t.withColumn("_key", F.explode(F.sequence(place(F.col("amount_p") - within), place(F.col("amount_p") + within))))
    near = F.abs(F.col("amount_p") - F.col("_owed")) <= within
    return _met(paid, i.withColumn("_owed", owed).withColumn("_key", place(F.col("_owed"))), params, tile_rows).where(near).drop("_owed")


def pairs_near_reference(t: DataFrame, i: DataFrame, params: Params = DEFAULT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The candidate pairs whose references are equal, or one the beginning of the other; no other is made."""
    t, i = t.where("t_ref is not null"), i.where("i_ref is not null and status = 'open'")

    def cuts(df: DataFrame, ref: str, other: DataFrame, o_ref: str) -> DataFrame:
        """The beginnings of each reference in the shorter lengths that the merchant's other references have."""
        sizes = other.where(F.length(o_ref) >= fx.PREFIX_MIN).groupBy(*CELL).agg(F.collect_set(F.length(o_ref)).alias("_sizes"))
        shorter = F.filter("_sizes", lambda n: n < F.length(ref))
        return df.join(sizes, CELL).withColumn("_key", F.explode(F.transform(shorter, lambda n: F.substr(ref, F.lit(1), n)))).drop("_sizes")

    equal = _met(t.withColumn("_key", F.col("t_ref")), i.withColumn("_key", F.col("i_ref")), params, tile_rows)
    long_t, long_i = t.where(F.length("t_ref") >= fx.PREFIX_MIN), i.where(F.length("i_ref") >= fx.PREFIX_MIN)
    begun = _met(long_t.withColumn("_key", F.col("t_ref")), cuts(long_i, "i_ref", long_t, "t_ref"), params, tile_rows)
    begins = _met(cuts(long_t, "t_ref", long_i, "i_ref"), long_i.withColumn("_key", F.col("i_ref")), params, tile_rows)
    return equal.unionByName(begun).unionByName(begins)


def pairs_by_txn(t: DataFrame, i: DataFrame, params: Params = DEFAULT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The candidate pairs, with all pairs of a transaction in one partition; _bucket and _tl follow from the transaction.

    A transaction lies in one bucket of its date, an invoice is copied to the two it may touch.  Windows partitioned by
    these columns and the transaction sort the pairs where the join has made them, so that no pair is shuffled.
    """
    span = params.window_span
    keys = [*CELL, "_bucket"]

    def bucket(day: Column) -> Column:
        return F.floor(F.unix_date(day) / span).cast("int")

    left = t.withColumn("_bucket", bucket(F.col("txn_date")))
    low, high = bucket(F.date_sub("invoice_date", params.window_forward_days)), bucket(F.date_add("invoice_date", params.window_back_days))
    right = i.where(F.col("status") == "open").withColumn("_bucket", F.explode(F.sequence(low, high)))
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > tile_rows).select(*keys, F.ceil(F.col("_n") / tile_rows).cast("int").alias("_g"))
    parts = F.coalesce(F.col("_g"), F.lit(1))
    l = left.join(hot, keys, "left").withColumn("_tl", F.pmod(F.xxhash64("txn_id"), parts).cast("int")).drop("_g")
    r = right.join(hot, keys, "left").withColumn("_tl", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_g")
    cell = [*keys, "_tl"]
    return spread(l, cell).join(spread(r, cell), cell).where(in_window(params) & amount_window()).withColumn("gap", fx.day_gap(F.col("txn_date"), F.col("invoice_date")))
