"""Exact deduplication with skew-safe combining, in DataFrame functions only.

1. Each map task folds its own copies (partial aggregation on the full text), so a text that makes up a third
   of all rows leaves a task as one row.
2. Those rows meet by (digest, salt, full text); the salt is the map task's number modulo ``salts``, so not even
   the one row per task of a hot text goes to a single reducer.
3. The salt winners of a text meet by (digest, full text).

Texts are compared in full in all three steps; the digest only routes.  A digest that stands for exactly one
text may then stand for it in the narrow join that brings the result to each document.  Should a digest ever
stand for several texts, its documents are joined by the full text instead.

Defined cases: a null text equals the empty text.  A null id never wins against an id; a group of null ids only
has a null ``keep_id``.  Rows that repeat an id with an equal text count in ``group_size`` and share one verdict;
``survivors`` keeps one of them.  Very long texts are compared whole.  Columns other than the two named are ignored by
``exact_groups``, kept by ``survivors``, and may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import ascii_lower, keep_listed
from ledgerlink.session import Workspace


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(docs.sparkSession)
    bodies = docs.select(F.col(doc_id).alias("id"), ascii_lower(F.col(text)).alias("body"))
    rows = bodies.select("id", "body", digest(F.col("body")).alias("digest"))

    local = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    )
    merged = local.groupBy("digest", "body").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    routes = ws.save(
        merged.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n_bodies"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "routes",
    )
    narrow = rows.select("id", "digest", sha256(F.col("body")).alias("text_sha256"))
    out = narrow.join(routes.filter("n_bodies = 1").drop("n_bodies"), "digest")
    clashes = routes.filter("n_bodies > 1").select("digest")
    if not clashes.isEmpty():
        whole = rows.select("id", "digest", "body", sha256(F.col("body")).alias("text_sha256")).join(clashes, "digest", "left_semi")
        out = out.unionByName(whole.join(merged, ["digest", "body"]).drop("body"))
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns, one row for each text as ``exact_groups`` compares it."""
    keep = exact_groups(docs, doc_id, text).filter("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    return keep_listed(docs, Workspace(docs.sparkSession).save(keep.agg(F.count(F.lit(1)).alias("n")), "keep"), doc_id, ascii_lower(F.col(text)))
