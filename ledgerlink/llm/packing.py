"""Packing by power-of-two decomposition.

A document's tokens are cut from the left into pieces of ``limit`` tokens, and what is left into pieces of falling
powers of two, one for each bit of its length.  Every piece is a sequence of its own: none crosses documents, none
is padded, and the pieces of one length form a bucket that can be batched as it is.  A document leaves at most
log2(limit) pieces besides its full ones.  Documents are independent, so nothing is shuffled.

Defined cases: a null or empty text has only the end token, one piece of length 1.  Rows that repeat a doc_id are
packed each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import small_batches, utf8
from ledgerlink.llm.word_bpe import default_vocabulary, id_lists, worker_encoder

LIMIT = 2048
END_ID = 1
RUN_TOKENS = 1 << 20


def decompose(n: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of all pieces of documents with n tokens; lengths add up to n, in order."""
    levels = limit.bit_length() - 1
    full, rest = n // limit, n % limit
    bits = (rest[:, None] >> np.arange(levels - 1, -1, -1)) & 1
    per = full + bits.sum(axis=1)
    row = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    length = np.full(len(row), limit, np.int64)
    i, b = np.nonzero(bits)
    length[at >= full[row]] = 1 << (levels - 1 - b)
    return row, length


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket (log2 of the length), sequence_id, offset.

    ``limit`` is a power of two.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        encoder = worker_encoder(vocabulary)
        for b in batches:
            for first, ids, n in id_lists(encoder, utf8(b.column(1))):
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                row, length = decompose(n, limit)
                begin = np.cumsum(length) - length
                start = begin - np.repeat((np.cumsum(n) - n), np.bincount(row, minlength=len(n)))
                step = max(1, RUN_TOKENS // limit)
                for a in range(0, len(row), step):  # a very long document leaves in several batches
                    z = min(a + step, len(row))
                    offsets = np.concatenate([begin[a:z], [begin[z - 1] + length[z - 1]]])
                    pieces = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(ids[offsets[0] : offsets[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(first + row[a:z])), pa.array(start[a:z]), pa.array(length[a:z]), pieces, pa.array(n[row[a:z]])],
                        ["doc_id", "start", "length", "ids", "doc_tokens"],
                    )

    pieces = docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids array<int>, doc_tokens long")
    return pieces.select(
        "*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
