"""Ranked lexical search by pipelined term partitioning.

Documents are laid out in blocks of at most ``BLOCK_DOCS``; each block holds for each of its terms the places of its documents
and the counts there.  Every term has one owner stage, rare terms an early one.  Items travel in bundles: a bundle meets each
block as one row that carries, beside its items' weights, a sparse accumulator of partial scores for (item, document).  Stage
after stage the bundles are co-grouped with the postings that the stage owns, add integer contributions, and go on.
After the last stage a bundle hands out the best ``k`` documents of its block, and a window picks the best of all blocks.

A stage first drops accumulators that can no longer win: with R the most that this and later stages can add for an item, a document
below (k-th best so far) - R is out, and documents not seen so far are let in only if R alone reaches the k-th best.
Both are exact; equal scores stay.

Counts, lengths and document frequencies cover all documents.  Of the terms of documents, only those of items are indexed: a
bit map of fixed size (``MAP_BITS``) pre-filters them where they are read, the join by term decides.  No group grows with the
table: a bundle has about ``BUNDLE_ITEMS`` items, a block a bounded number of documents, and a frequent term one row a block.

Terms are maximal stretches of ASCII letters and digits and of characters beyond ASCII; A-Z is lower-cased.

Defined cases: null and empty texts have no terms; such documents do not count, such items give no rows.  Rows that repeat an id are
documents (items) of their own; ids of documents are cast to long, equal scores of equal ids are in any order, null ids come
last.  Fewer than ``k`` documents above score 0 are all returned.  Very long texts are counted whole.  Other columns are ignored and may
have any name.  An empty table of either kind gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm.base import small_batches, utf8, worker_cache
from ledgerlink.session import Workspace

BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 22
BUNDLE_ITEMS = 64
MAP_BITS = 1 << 22
#: A term held by at most one document in so many belongs to the first, second, ... stage; all others to the last.
OWNERS = (128, 32, 8)
KNOWN_TERMS = 1 << 20
#: Separators become blanks, A-Z becomes a-z, other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_terms(ws: Workspace, items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_no (one a row), item_id, term, times."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, t in enumerate(utf8(b.column(2))):
                found = Counter(terms(t))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([b.column(c)[i]] * n, b.schema.field(c).type) for c in (0, 1)), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["item_no", "item_id", "term", "times"],
                )

    numbered = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    return ws.save(numbered.mapInArrow(run, f"item_no long, item_id {kind}, term string, times long"), "item-terms")


def term_map(asked: DataFrame) -> bytes:
    """A bit for the hash of each term: ``MAP_BITS`` bits, however many terms there are."""
    places = asked.select(F.pmod(F.xxhash64("term"), F.lit(MAP_BITS)).cast("int").alias("at"))
    words = places.select(F.expr("at div 32").cast("int").alias("word"), F.expr("shiftleft(1L, at % 32)").alias("bit"))
    out = np.zeros(MAP_BITS // 32, np.uint32)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most MAP_BITS / 32 rows
        out[r.word] = r.bits
    return out.tobytes()


def block_index(docs: DataFrame, bits: bytes) -> DataFrame:
    """Rows (block, term, at, tf): where in the block the term occurs; and for each block (block, null term, ids, n)."""

    def known_terms() -> dict[bytes, bool]:
        cache = worker_cache()
        if cache.get("terms_of") != hash(bits) or len(cache["terms"]) > KNOWN_TERMS:
            cache["terms_of"], cache["terms"] = hash(bits), {}
        return cache["terms"]

    def run(batches):
        asked = np.frombuffer(bits, np.uint32)
        task, number = TaskContext.get().partitionId(), 0
        ids, n, index, postings = [], [], {}, 0

        def flush():
            nonlocal number, ids, n, index, postings
            block = task << 32 | number
            lists = lambda k: pa.array([None, *(np.array(x[k], np.int32) for x in index.values())], pa.list_(pa.int32()))
            rows = len(index) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * rows, pa.int64()),
                    pa.array([None, *index], pa.binary()).cast(pa.string()),
                    lists(0),
                    lists(1),
                    pa.array([ids] + [None] * (rows - 1), pa.list_(pa.int64())),
                    pa.array([n] + [None] * (rows - 1), pa.list_(pa.int64())),
                ],
                ["block", "term", "at", "tf", "ids", "n"],
            )
            number, ids, n, index, postings = number + 1, [], [], {}, 0

        for b in batches:
            known = known_terms()
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                words = terms(t)
                if not words:
                    continue
                for w, tf in Counter(words).items():
                    is_asked = known.get(w)
                    if is_asked is None:
                        h = xxhash.xxh64_intdigest(w, 42) % MAP_BITS
                        is_asked = known[w] = bool(asked[h >> 5] >> np.uint32(h & 31) & np.uint32(1))
                    if is_asked:
                        at, tfs = index.setdefault(w, ([], []))
                        at.append(len(ids))
                        tfs.append(tf)
                        postings += 1
                ids.append(i)
                n.append(len(words))
                if len(ids) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.mapInArrow(run, "block long, term string, at array<int>, tf array<int>, ids array<long>, n array<long>")


CARRIED = "bundle long, block long, items array<struct<item_no:long,item_id:{kind},terms:array<struct<term:string,weight:long,stage:int,most:long>>>>, ids array<long>, m array<long>"
ACCUMULATOR = "acc_item array<int>, acc_doc array<int>, acc_score array<long>"


def accumulate(carried: dict, postings: pa.Table, stage: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The accumulator (item, document, score) of a bundle at a block after ``stage``."""
    items, m = carried["items"], np.array(carried["m"], np.int64)
    score = np.zeros((len(items), len(m)), np.int64)
    score[carried["acc_item"], carried["acc_doc"]] = carried["acc_score"]
    users: dict[str, list[tuple[int, int]]] = {}
    live = np.ones(score.shape, bool)
    for i, item in enumerate(items):
        rest = 0
        for t in item["terms"]:
            if t["stage"] >= stage:
                rest += t["most"]
            if t["stage"] == stage:
                users.setdefault(t["term"], []).append((i, t["weight"]))
        if len(m) > k:
            bar = int(np.partition(score[i], -k)[-k])
            if bar > 0:
                live[i] = score[i] + rest >= bar
    score[~live] = 0
    for t, at, tf in zip(postings.column("term").to_pylist(), postings.column("at").to_pylist(), postings.column("tf").to_pylist()):
        at, tf = np.array(at), np.array(tf, np.int64)
        part = 1_000_000_000 * tf // (1_000 * tf + 12 * m[at])
        for i, weight in users.get(t, ()):
            score[i, at] += weight * part * live[i, at]
    item, doc = np.nonzero(score)
    return item, doc, score[item, doc]


def best(carried: dict, item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[list, list, list, list]:
    """item_no, item_id, doc_id, score of the ``k`` best documents of each item in a block."""
    ids = carried["ids"]
    none = np.array([i is None for i in ids], bool)
    whole = np.array([0 if i is None else i for i in ids], np.int64)
    by = np.lexsort((whole[doc], none[doc], -score, item))
    item, doc, score = item[by], doc[by], score[by]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    top = np.flatnonzero(rank < k)
    of = [carried["items"][i] for i in item[top]]
    return [x["item_no"] for x in of], [x["item_id"] for x in of], [ids[d] for d in doc[top]], score[top].tolist()


def stage_step(bundles: DataFrame, postings: DataFrame, stage: int, last: bool, k: int, kind: str) -> DataFrame:
    """Bundles after the owner ``stage``: with their new accumulators, or (``last``) the best documents of their blocks."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result.empty_table()
        carried = left.to_pylist()[0]
        item, doc, score = accumulate(carried, right, stage, k)
        if last:
            return pa.table(dict(zip(result.names, best(carried, item, doc, score, k))), schema=result)
        out = left.select(range(5))
        for name, x, type_ in (("acc_item", item, pa.int32()), ("acc_doc", doc, pa.int32()), ("acc_score", score, pa.int64())):
            out = out.append_column(name, pa.array([x.astype(type_.to_pandas_dtype())], pa.list_(type_)))
        return out.cast(result)

    schema = f"item_no long, item_id {kind}, doc_id long, score long" if last else f"{CARRIED.format(kind=kind)}, {ACCUMULATOR}"
    empty = bundles.sparkSession.createDataFrame([], schema)
    result = empty.toArrow().schema
    keys = ["bundle", "block"]
    owned = postings.filter(F.col("stage") == stage).select(*[F.col(c).alias(c) for c in (*keys, "term", "at", "tf")])
    return bundles.groupBy(*keys).cogroup(owned.groupBy(*keys)).applyInArrow(add, empty.schema)


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", owners: tuple[int, ...] = OWNERS
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark)
    kind = items.schema[item_id].dataType.simpleString()
    asked = item_terms(ws, items, item_id, item_text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    index = ws.save(block_index(rows, term_map(asked)), "index")
    blocks, lists = index.filter("term is null").select("block", "ids", "n"), index.filter("term is not null").select("block", "term", "at", "tf")

    # Two whole numbers: how many documents, and all their terms.
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n_docs, n_terms = blocks.agg(total(F.size("n")), total(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_items = asked.agg(F.count_distinct("item_no")).first()[0]
    if not n_docs or not n_items:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

    held = lists.groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.max(F.array_max("tf")).cast("long").alias("tf"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))
    stage = F.lit(len(owners))
    for s, one_in in reversed(list(enumerate(owners))):
        stage = F.when(F.col("df") * one_in <= n_docs, F.lit(s)).otherwise(stage)
    owned = held.select("term", weight.alias("w"), stage.alias("stage"), F.expr("(1000000000 * tf) div (1000 * tf + 12 * 75)").alias("part"))
    n_bundles = -(-n_items // BUNDLE_ITEMS)
    weighted = ws.save(
        asked.join(owned, "term").select(
            F.pmod(F.xxhash64("item_no"), F.lit(n_bundles)).alias("bundle"), "item_no", "item_id", "term", (F.col("w") * F.col("times")).alias("weight"), "stage", (F.col("w") * F.col("times") * F.col("part")).alias("most")
        ),
        "weights",
    )
    bundles = (
        weighted.groupBy("bundle", "item_no", "item_id")
        .agg(F.collect_list(F.struct("term", "weight", "stage", "most")).alias("terms"))  # of one item
        .groupBy("bundle")
        .agg(F.collect_list(F.struct("item_no", "item_id", "terms")).alias("items"))  # of one bundle
    )
    owners_of = weighted.select("term", "stage", "bundle").distinct()
    postings = ws.save(lists.join(owners_of, "term"), "postings")
    m = F.expr(f"transform(n, x -> 75L + (25L * x * {n_docs}L) div {n_terms}L)")
    empty = F.array().cast("array<int>")
    state = (
        postings.select("bundle", "block").distinct().join(bundles, "bundle").join(blocks.hint("merge"), "block")  # packed lists are small files but large in memory
        .select("bundle", "block", "items", "ids", m.alias("m"), empty.alias("acc_item"), empty.alias("acc_doc"), F.array().cast("array<long>").alias("acc_score"))
    )
    for s in range(len(owners) + 1):
        state = ws.save(stage_step(state, postings, s, s == len(owners), k, kind), f"stage-{s}")
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
