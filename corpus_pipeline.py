"""The corpus pipeline: documents in, packed sequences out.

Each stage works on all that the stage before has kept.  Its result is written as Parquet to the shared folder and
read again, which cuts lineage and survives lost executors.  Toxic documents, exact copies and near copies go;
secrets are replaced inside the text, so that their documents stay; what is left is packed.  Near copies are found by SimHash
fingerprints in BK-trees, by min-hash buckets where they lie beyond the trees' radius, and decided by their whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import exact_dedup, packing, secret_scan, shingle_dedup, toxicity
from ledgerlink.llm.base import free_name, table
from ledgerlink.session import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_dedup.survivors(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced; n_chars follows the text where it changed."""
    name = free_name(docs.columns, "clean")
    clean = docs.withColumn(name, secret_scan.redact(F.col("text")))
    n_chars = F.when(F.col(name) == F.col("text"), F.col("n_chars")).otherwise(F.char_length(name).cast(docs.schema["n_chars"].dataType))
    swapped = {"text": F.col(name), "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n_chars)}
    return clean.select(*[swapped[c].alias(c) if c in swapped else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot fit the toxicity classifier or run the tokenizer; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
