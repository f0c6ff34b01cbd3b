"""Accidental duplicate payments (JN-3).

Rows with the same key, day and text are one class whose earliest id speaks for all of them; only distinct
texts are compared.  A class's original is the earliest (date, id) among the similar classes of the last
days, its own included, so no transaction-by-transaction comparison is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlink.functions import scalars as fx
from ledgerlink.functions.fuzzy import duplicate_similarity
from ledgerlink.operators.tiles import TILE_ROWS, tiled
from ledgerlink.params import DEFAULT, Params

KEY = ["batch_id", "merchant_id", "direction", "amount_p"]


def find_duplicates(t: DataFrame, params: Params = DEFAULT, similar=None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(batch_id, txn_id, original_id) for each later copy.  `similar` replaces the text test if given."""
    span = params.duplicate_days + 1
    rows = t.where(~fx.has_split_word(F.col("narr"))).select(*KEY, "txn_date", "narr", "txn_id")
    classes = rows.groupBy(*KEY, "txn_date", "narr").agg(F.min("txn_id").alias("first_id"))
    # A text that is alone under its (key, bucket neighbourhood) can only duplicate itself.
    bucket = F.floor(F.unix_date("txn_date") / span).cast("int")
    later = classes.withColumn("_bucket", F.explode(F.sequence(
        F.floor((F.unix_date("txn_date") - params.duplicate_days) / span).cast("int"), bucket)))
    earlier = classes.select(
        *KEY, bucket.alias("_bucket"), F.col("txn_date").alias("o_date"), F.col("narr").alias("o_narr"),
        F.col("first_id").alias("o_id"),
    )
    l, r, keys = tiled(later, earlier, [*KEY, "_bucket"], ["narr", "txn_date"], ["o_narr", "o_date"], tile_rows)
    met = l.join(r, keys).where(
        (F.col("o_date") <= F.col("txn_date")) & (F.datediff("txn_date", "o_date") <= params.duplicate_days)
    )
    # Equal texts are passed as nulls, which count as equal and cost nothing.
    differ = F.col("narr") != F.col("o_narr")
    test: Column = similar(F.col("narr"), F.col("o_narr")) if similar is not None else (
        duplicate_similarity(F.when(differ, F.col("narr")), F.when(differ, F.col("o_narr"))) >= params.duplicate_similarity
    )
    original = met.where(test).groupBy(*KEY, "txn_date", "narr").agg(
        F.min(F.struct(F.col("o_date").alias("day"), F.col("o_id").alias("id"))).alias("orig")
    )
    return (
        rows.join(original, [*KEY, "txn_date", "narr"])
        .where((F.col("orig.day") < F.col("txn_date")) | (F.col("orig.id") < F.col("txn_id")))
        .select("batch_id", "merchant_id", "txn_id", F.col("orig.id").alias("original_id"))
    )
