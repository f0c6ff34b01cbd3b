"""CSV upload: all-string scan, typed projection, error bucket, in-file dedup (SRC-1..4, PRJ-1..3, PRJ-7, WIN-5).

Every step is a projection or filter on one scan; the only shuffle is the dedup by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlink import schemas
from ledgerlink.functions import scalars as fx
from ledgerlink.session import Workspace
from ledgerlink.sources.csv_records import records

TXN_COLUMNS = ["txn_id", "txn_date", "date", "amount", "direction", "narration", "channel", "reference_number"]
INVOICE_COLUMNS = [
    "invoice_id", "invoice_date", "date", "counterparty_name", "base_amount", "total_amount", "expected_net_amount",
    "cgst_amount", "sgst_amount", "igst_amount", "tds_section", "tds_rate", "tds_amount", "reference_number", "status",
]
LABEL_COLUMNS = ["invoice_id", "txn_ids", "is_true_match", "case_category"]


def scan(spark: SparkSession, path: str | list[str], wanted: list[str]) -> DataFrame:
    """Header-keyed scan of one file or several with the same header.  Columns are bound by name; the header row alone is read to
    learn them.

    Quoted fields may hold line breaks.  row_idx rises in the order of the files' names and of the records in them.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    fields = F.from_csv("record", schema, {"escape": '"'})
    raw = records(spark, path).select("row_idx", fields.alias("f")).select("f.*", "row_idx")
    return with_columns_present(raw, wanted)


def with_columns_present(raw: DataFrame, wanted: list[str]) -> DataFrame:
    """Add absent columns as a typed marker so that 'absent' and 'blank' stay distinguishable."""
    have = set(raw.columns)
    out = raw
    for c in wanted:
        out = out.withColumn(f"_has_{c}", F.lit(c in have))
        if c not in have:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _either(first: str, second: str) -> Column:
    """The first column when the file has it, else the second."""
    return F.when(F.col(f"_has_{first}"), _text(first)).otherwise(_text(second))


ID_DIGITS = 8
ID_ROUNDS = 40


def _digits(row: Column, attempt: Column, digits: Column) -> Column:
    """PRJ-3: the digits of a made id follow from the row, so that a retried task makes the same id."""
    body = F.concat_ws("|", F.to_json(row), F.col("row_idx").cast("string"), attempt.cast("string"))
    return F.substr(F.sha2(body, 256), F.lit(1), digits)


def with_unique_ids(parsed: DataFrame, id_col: str) -> DataFrame:
    """Made ids that meet a given id or the made id of an earlier row are derived again, until all differ.

    Only the rows that meet are touched in a round, about n * n / 16^digits / 2 of n.  An id that is derived again gets more digits
    where those it has are too few for the rows, so that each round leaves a small share of the one before; rows that are equal
    come apart at once.  The rounds are bounded, running out of them raises.  Given ids are never changed.
    """
    if parsed.where("made").isEmpty():
        return parsed
    ws = Workspace(parsed.sparkSession)
    rows = ws.save(parsed.withColumn("_attempt", F.lit(0)), "made-ids")
    enough = len(f"{rows.count():x}") + 1  # 16 to 256 places a row
    digits = F.greatest(F.length(id_col) - F.instr(id_col, "-"), F.lit(enough))
    for _ in range(ID_ROUNDS):
        met = rows.groupBy("batch_id", id_col).agg(F.count("*").alias("n"), F.count_if("made").alias("n_made")).where("n > 1 and n_made > 0")
        met = ws.save(met.select("batch_id", id_col), "met-ids")
        if met.isEmpty():
            return rows.drop("_attempt")
        order = Window.partitionBy("batch_id", id_col).orderBy("made", "row_idx")
        again = rows.join(met, ["batch_id", id_col], "left_semi").withColumn("_n", F.row_number().over(order))
        moved = F.col("made") & (F.col("_n") > 1)
        attempt = F.col("_attempt") + F.col("_n") - 1
        fresh = F.concat(F.substring_index(id_col, "-", 1), F.lit("-"), _digits(F.col("row"), attempt, digits))
        again = again.withColumns({id_col: F.when(moved, fresh).otherwise(F.col(id_col)), "_attempt": F.when(moved, attempt).otherwise(F.col("_attempt"))}).drop("_n")
        rows = ws.save(rows.join(met, ["batch_id", id_col], "left_anti").unionByName(again.select(rows.columns)), "made-ids")
    raise RuntimeError("made ids did not come apart; use more digits")


def _problem(bad: Column, label: str, raw: Column) -> Column:
    return F.when(bad, F.concat(F.lit(f"Invalid {label}: '"), raw, F.lit("'")))


def parse_transactions(raw: DataFrame, merchant_id: str | Column, batch_id: str | Column, id_digits: int = ID_DIGITS) -> DataFrame:
    """PRJ-1 plus an errors array.  Rows with errors keep their raw columns."""
    date_raw = _either("txn_date", "date")
    amount = fx.parse_amount(F.col("amount"))
    day = fx.parse_date(date_raw)
    direction = F.when(F.col("_has_direction"), F.lower(_text("direction"))).otherwise(F.lit("credit"))
    channel = fx.blank_to_null(F.col("channel"))
    given = fx.blank_to_null(F.col("txn_id"))
    return raw.select(
        F.coalesce(given, F.concat(F.lit("TXN-"), _digits(F.struct(*TXN_COLUMNS), F.lit(0), F.lit(id_digits)))).alias("txn_id"),
        given.isNull().alias("made"),
        _as_col(merchant_id).alias("merchant_id"),
        _as_col(batch_id).alias("batch_id"),
        day.alias("txn_date"),
        amount.alias("amount"),
        direction.alias("direction"),
        channel.alias("channel"),
        _text("narration").alias("narration"),
        fx.blank_to_null(F.col("reference_number")).alias("reference_number"),
        "row_idx",
        F.array_compact(
            F.array(
                _problem(amount.isNull(), "amount", _text("amount")),
                _problem(day.isNull(), "date", date_raw),
                _problem(amount <= 0, "amount", _text("amount")),
                _problem(~direction.isin(schemas.DIRECTIONS), "direction", direction),
                _problem(channel.isNotNull() & ~channel.isin(schemas.CHANNELS), "channel", channel),
            )
        ).alias("errors"),
        F.struct(*[F.col(c).alias(c) for c in TXN_COLUMNS]).alias("row"),
    )


def parse_invoices(raw: DataFrame, merchant_id: str | Column, batch_id: str | Column, id_digits: int = ID_DIGITS) -> DataFrame:
    """PRJ-2: null or zero net falls back to total; GST parts default to 0; zero TDS rate is null."""
    date_raw = _either("invoice_date", "date")
    base, total = fx.parse_amount(F.col("base_amount")), fx.parse_amount(F.col("total_amount"))
    day = fx.parse_date(date_raw)
    zero = F.lit(0).cast(schemas.MONEY)
    status = F.when(F.col("_has_status"), _text("status")).otherwise(F.lit("open"))
    given = fx.blank_to_null(F.col("invoice_id"))

    def gst(c: str) -> Column:
        return F.coalesce(fx.parse_amount(F.col(c)), zero).alias(c)

    rate = F.regexp_replace(F.col("tds_rate"), r"[₹,\s]", "")
    rate = F.when(rate != "", rate.try_cast(schemas.RATE))
    return raw.select(
        F.coalesce(given, F.concat(F.lit("INV-"), _digits(F.struct(*INVOICE_COLUMNS), F.lit(0), F.lit(id_digits)))).alias("invoice_id"),
        given.isNull().alias("made"),
        _as_col(merchant_id).alias("merchant_id"),
        _as_col(batch_id).alias("batch_id"),
        _text("counterparty_name").alias("counterparty_name"),
        day.alias("invoice_date"),
        base.alias("base_amount"),
        total.alias("total_amount"),
        F.coalesce(F.nullif(fx.parse_amount(F.col("expected_net_amount")), zero), total).alias("expected_net_amount"),
        gst("cgst_amount"),
        gst("sgst_amount"),
        gst("igst_amount"),
        fx.blank_to_null(F.col("tds_section")).alias("tds_section"),
        F.nullif(rate, F.lit(0).cast(schemas.RATE)).alias("tds_rate"),
        fx.parse_amount(F.col("tds_amount")).alias("tds_amount"),
        fx.blank_to_null(F.col("reference_number")).alias("reference_number"),
        status.alias("status"),
        "row_idx",
        F.array_compact(
            F.array(
                _problem(base.isNull(), "base_amount", _text("base_amount")),
                _problem(total.isNull(), "total_amount", _text("total_amount")),
                _problem(day.isNull(), "invoice_date", date_raw),
                _problem(~status.isin(schemas.INVOICE_STATUSES), "status", status),
            )
        ).alias("errors"),
        F.struct(*[F.col(c).alias(c) for c in INVOICE_COLUMNS]).alias("row"),
    )


def parse_labels(raw: DataFrame, batch_id: str | Column) -> DataFrame:
    """SRC-3: no row is rejected."""
    truth = F.when(F.col("_has_is_true_match"), F.lower(_text("is_true_match"))).otherwise(F.lit("true"))
    category = F.when(F.col("_has_case_category"), _text("case_category")).otherwise(F.lit("clean"))
    return raw.select(
        _text("invoice_id").alias("invoice_id"),
        fx.comma_list(F.col("txn_ids")).alias("txn_ids"),
        truth.isin("true", "1", "yes").alias("is_true_match"),
        category.alias("case_category"),
        _as_col(batch_id).alias("batch_id"),
        "row_idx",
    )


def good_rows(parsed: DataFrame, id_col: str) -> DataFrame:
    """Error-free rows, first row per given id in file order (WIN-5); rows without an id all stay (PRJ-3)."""
    first = Window.partitionBy("batch_id", id_col).orderBy("row_idx")
    good = parsed.where(F.size("errors") == 0)
    return (
        (with_unique_ids(good, id_col) if "made" in parsed.columns else good)
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n", "errors", "row", "made")
    )


def error_rows(parsed: DataFrame, file_tag: str) -> DataFrame:
    """SRC-4: file tag, original row, messages."""
    return parsed.where(F.size("errors") > 0).select(
        F.lit(file_tag).alias("file"), "row_idx", F.to_json("row").alias("row"), "errors"
    )


def upload_summary(txns: DataFrame, invoices: DataFrame, errors: DataFrame) -> DataFrame:
    """SRC-9: one row with loaded counts, error count and message."""
    tagged = (
        txns.select(F.lit("t").alias("k"))
        .union(invoices.select(F.lit("i").alias("k")))
        .union(errors.select(F.lit("e").alias("k")))
    )
    c = tagged.agg(
        F.count_if(F.col("k") == "t").alias("txns_loaded"),
        F.count_if(F.col("k") == "i").alias("invoices_loaded"),
        F.count_if(F.col("k") == "e").alias("errors"),
    )
    return c.withColumn(
        "message",
        F.when(F.col("errors") == 0, F.lit("Batch created and ready to run."))
        .otherwise(F.format_string("Batch created with %d skipped rows; see the error table.", F.col("errors"))),
    )


def gst_mismatch(invoices: DataFrame) -> DataFrame:
    """PRJ-7: flag invoices whose GST share of the base is no known slab."""
    gst = F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")
    slab = F.bround(gst / F.col("base_amount") * 100, 0)
    known = slab.isin(0, 5, 12, 18, 28)
    return invoices.withColumn(
        "gst_mismatch", F.coalesce((F.col("base_amount") > 0) & (gst != 0) & ~known, F.lit(False))
    )


def _as_col(v: str | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
