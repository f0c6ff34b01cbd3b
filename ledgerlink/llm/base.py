"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

BATCH_ROWS = 2_000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts stay small: by rows, and by bytes where some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty.  Pure ASCII takes the faster built-in."""
    s = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: Iterable[bytes], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about ``limit`` bytes; a longer text is alone in its run."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls in the held-out fold; a null id is never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, which Spark reuses for later tasks.

    Functions travel by value, so their own module's globals start anew with each task.
    """
    return sys.modules.setdefault("_corpus_worker_cache", types.ModuleType("_corpus_worker_cache")).__dict__


def keep_listed(docs: DataFrame, listed: DataFrame, doc_id: str, body: Column) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``listed`` (id, sha of ``text_sha(body)``, n rows), one row each.

    Rows travel as one struct, so that columns of ``docs`` may have any name.  Only where a row repeats, a further pass over
    the repeated ones leaves one of them.
    """
    tagged = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own"), text_sha(body).alias("key"))
    rows = tagged.join(listed, tagged["own"].eqNullSafe(listed["id"]) & (tagged["key"] == listed["sha"]))
    once = rows.filter("n = 1").select("row.*")
    if listed.filter("n > 1").isEmpty():
        return once
    return once.unionByName(rows.filter("n > 1").dropDuplicates(["id", "sha"]).select("row.*"))


def free_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)
