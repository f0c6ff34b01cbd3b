"""Probability calibration (AGG-8..10, JN-8, CAL-1)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlink.functions.scalars import clip, sorted_set

# Edges of five equal bins as evenly spaced doubles; the fourth is one step above 0.6.
EDGES = [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]
BINS = len(EDGES) - 1


def outcome_rows(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """JN-8: (batch_id, match_id, p, y).  A match is right when some invoice's last label has the same
    transactions and the match holds exactly that invoice."""
    last = labels.groupBy("batch_id", "invoice_id").agg(F.max_by(sorted_set(F.col("txn_ids")), "row_idx").alias("true_txns"))
    m = matches.select(
        "batch_id", "match_id", (F.col("confidence_score") / 100).alias("p"),
        sorted_set(F.col("line_items.txn_id")).alias("txn_set"), sorted_set(F.col("line_items.invoice_id")).alias("invoice_set"),
    )
    # Only single-invoice matches can be right, so there is nothing to explode.
    return m.withColumn("invoice_id", F.when(F.size("invoice_set") == 1, F.get("invoice_set", F.lit(0)))).join(
        last, ["batch_id", "invoice_id"], "left"
    ).select("batch_id", "match_id", "p", F.coalesce(F.col("txn_set") == F.col("true_txns"), F.lit(False)).cast("int").alias("y"))


def bin_of(p: Column) -> Column:
    """Half-open bins, the last one closed; null outside [0, 1]."""
    out = F.when((p < EDGES[0]) | (p > EDGES[-1]), F.lit(None).cast("int"))
    for b in range(1, BINS):
        out = out.when(p < EDGES[b], b - 1)
    return out.otherwise(BINS - 1)


def brier(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-8."""
    d = F.col("p") - F.col("y")
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("brier"), F.count("*").alias("n"))


def bins(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, bin_of(F.col("p")).alias("bin")).agg(
        F.avg("y").alias("accuracy"), F.avg("p").alias("confidence"), F.count("*").alias("n")
    )


def expected_error(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-9: the second aggregation sees five rows per key."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bins(rows, keys).groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * gap).otherwise(0.0)) / F.sum("n"), 4).alias("ece")
    )


def reliability_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-10: five bins per key; an empty bin has accuracy 0 and its mid-point as confidence."""
    got = bins(rows, keys)
    frame = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    edge = F.array(*[F.lit(e) for e in EDGES])
    low, high = F.element_at(edge, F.col("bin") + 1), F.element_at(edge, F.col("bin") + 2)
    conf = F.round(F.coalesce("confidence", (low + high) / 2) * 100, 1)
    return frame.join(got, [*keys, "bin"], "left").select(
        *keys, "bin",
        F.concat((low * 100).cast("int").cast("string"), F.lit("%-"), (high * 100).cast("int").cast("string"), F.lit("%")).alias("bin_label"),
        conf.alias("mean_confidence"), F.round(F.coalesce("accuracy", F.lit(0.0)) * 100, 1).alias("empirical_accuracy"),
        F.coalesce("n", F.lit(0)).alias("sample_count"), conf.alias("ideal"),
    )


def fit_isotonic(rows: DataFrame) -> IsotonicRegressionModel | None:
    """CAL-1: monotone fit of y on p; None unless both outcomes occur.

    Rows with equal p are pooled into one weighted point first, so the fit sees at most one row per distinct
    score (scores carry two decimals) however large the batch is.
    """
    points = rows.groupBy(F.col("p").alias("x")).agg(F.avg(F.col("y").cast("double")).alias("label"), F.count("*").cast("double").alias("w"))
    spread = points.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if spread["hi"] is None or not (spread["hi"] > 0 and spread["lo"] < 1):
        return None
    data = points.select(array_to_vector(F.array("x")).alias("features"), "label", "w")
    return IsotonicRegression(isotonic=True, weightCol="w").fit(data)


def apply_isotonic(rows: DataFrame, model: IsotonicRegressionModel | None) -> DataFrame:
    """Calibrated probability q in [0, 1]; the raw one where no model could be fitted."""
    if model is None:
        return rows.withColumn("q", F.col("p"))
    scored = model.transform(rows.withColumn("features", array_to_vector(F.array("p"))))
    return scored.withColumn("q", clip(F.col("prediction"), 0, 1)).drop("features", "prediction")


def report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brier and calibration error before and after isotonic calibration, and the improvement in percent."""
    after = apply_isotonic(rows, fit_isotonic(rows)).withColumn("p", F.col("q")).select(*rows.columns)

    def side(r: DataFrame, tag: str) -> DataFrame:
        return brier(r, keys).join(expected_error(r, keys), keys).select(*keys, F.col("brier").alias(f"{tag}_brier"), F.col("ece").alias(f"{tag}_ece"), F.col("n").alias(f"{tag}_n"))

    both = side(rows, "raw").join(side(after, "cal").drop("cal_n"), keys)
    gain = F.when(F.col("raw_brier") > 0, F.round((F.col("raw_brier") - F.col("cal_brier")) / F.col("raw_brier") * 100, 1)).otherwise(0.0)
    return both.select(
        *keys, F.col("raw_n").alias("sample_size"), F.round("raw_brier", 4).alias("raw_brier"), "raw_ece",
        F.round("cal_brier", 4).alias("calibrated_brier"), F.col("cal_ece").alias("calibrated_ece"), gain.alias("brier_improvement_pct"),
    )
