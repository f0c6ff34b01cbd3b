"""Digest columns that the registered queries derive from the operators' real outputs."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlink.llm.word_bpe import decode_ids, default_vocabulary, lists, worker_encoder


def encoding_digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows (doc_id, ids)."""
    vocabulary = vocabulary or default_vocabulary()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = worker_encoder(vocabulary).vocabulary
        for b in batches:
            n, packed, text = [], [], []
            for ids in lists(b.column(1)):
                n.append(len(ids))
                packed.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text.append(hashlib.sha256(decode_ids(table, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_digests(packed: DataFrame) -> DataFrame:
    """The packed pieces with ids_crc32 in place of ids."""
    names = [c for c in packed.columns if c != "ids"]
    schema = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in lists(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(np.array(crc, np.int64))], [*names, "ids_crc32"])

    return packed.select(*names, "ids").mapInArrow(run, f"{schema}, ids_crc32 long")
