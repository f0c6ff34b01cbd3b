"""SimHash near-duplicates by BK-trees.

Fingerprint: lower-case A-Z, words split at ASCII white space, XXH64 (seed 42) of every ``width``-word shingle;
a bit is set where over half of the hashes have it.  Repeated shingles count each time.

Links (``radius`` differing bits or fewer) are searched among distinct fingerprints only:

1. The 64 bits are cut into ``blocks`` blocks.  Two linked fingerprints differ in at most ``radius`` blocks, so they
   agree on at least ``blocks - radius`` of them; one shard per choice of so many blocks and their bits therefore
   holds both.  The shard trees reach the queries this way instead of one tree of all fingerprints reaching
   every task, so that the work grows with the input and no broadcast does.
2. A shard of more than ``tree_max`` fingerprints is cut into parts by hash; each pair of parts is a tile of its
   own, one part building the tree and the other searching it.  No link is lost and no task holds a whole shard.
3. Within a tile a BK-tree is built (children keyed by their integer Hamming distance to the parent) and searched,
   following only edges within ``radius`` of the query's own distance.  All trees of a batch are built and searched
   together, level by level, in numpy.  A tile returns its links as stars, one row per linked fingerprint.
4. Stars of all tiles are joined to components by alternating large-star and small-star rounds.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other.  Fewer words than
``width`` form one shingle.  Copies share a fingerprint.  A component's id is its smallest non-null doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import keep_listed, small_batches, text_sha, utf8
from ledgerlink.session import Workspace

SEED = 42
SEGMENT = 1 << 20
FRONTIER = 1 << 18
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, width: int, segment: int = SEGMENT) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in runs, so that a very long text is never split into words at once."""
    digest, carry, at, found = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        cut = BLANK.search(text, at + segment)
        end = cut.end() if cut else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= width:
            found = True
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes).tolist()
            ends = ends.tolist()
            yield np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if not found and carry:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The signed 64-bit fingerprint of one text."""
    return majority_bits(shingle_hashes(text, width))


def majority_bits(runs: Iterable[np.ndarray]) -> int:
    """The signed 64-bit fingerprint of the hashes in ``runs``."""
    ones, n = np.zeros(64, np.int64), 0
    for h in runs:
        for part in np.array_split(h, len(h) // 65_536 + 1):
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (long) for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- BK-trees of one batch of tiles


def build_trees(tile: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge) of each node; a tile's first node is its root, with parent -1.  Rows are sorted by tile."""
    parent, edge = np.full(len(fp), -1), np.zeros(len(fp), np.int64)
    todo, group = np.arange(len(fp)), np.unique(tile, return_inverse=True)[1]
    while len(todo):
        first = np.ones(len(todo), bool)
        first[1:] = group[1:] != group[:-1]
        root = todo[first][np.cumsum(first) - 1][~first]
        todo = todo[~first]
        d = np.bitwise_count(fp[todo] ^ fp[root]).astype(np.int64)
        parent[todo], edge[todo] = root, d  # the last one written, just before a node heads its group, stays
        group = root * 65 + d
        order = np.argsort(group, kind="stable")
        todo, group = todo[order], group[order]
    return parent, edge


def search_trees(fp: np.ndarray, parent: np.ndarray, edge: np.ndarray, query: np.ndarray, root: np.ndarray, qfp: np.ndarray, radius: int):
    """Yields (query, node) arrays of links.  The frontier is cut so that it stays within a fixed size."""
    key = np.where(parent >= 0, parent * 65 + edge, -1)
    order = np.argsort(key, kind="stable")
    keys = key[order]
    stack = [(query, root)]
    while stack:
        q, node = stack.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            stack += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = np.bitwise_count(qfp[q] ^ fp[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
        total = int(n.sum())
        if total:
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            stack.append((np.repeat(q, n), order[np.repeat(low, n) + step]))


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; a class is named by its smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label, nxt := label[label]):
            label = nxt


def tile_links(tile: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields the links of whole tiles as (query row, tree row) arrays."""
    tree_at, query_at = np.flatnonzero(in_tree), np.flatnonzero(asks)
    parent, edge = build_trees(tile[tree_at], fp[tree_at])
    roots = np.flatnonzero(parent < 0)
    tiles = tile[tree_at][roots]
    at = np.searchsorted(tiles, tile[query_at])
    has = (at < len(tiles)) & (tiles[np.minimum(at, len(tiles) - 1)] == tile[query_at]) if len(tiles) else np.zeros(len(query_at), bool)
    q = np.flatnonzero(has)
    for a, b in search_trees(fp[tree_at], parent, edge, q, roots[at[q]], fp[query_at], radius):
        yield query_at[a], tree_at[b]


def tile_stars(tile: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole tiles as stars: (fingerprint, head of its class)."""
    label = np.arange(len(fp))
    for a, b in tile_links(tile, in_tree, asks, fp, radius):
        label = hook(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked].view(np.int64), fp[label[linked]].view(np.int64)


def tile_apart(tile: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, fp: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields all links of whole tiles but those whose two fingerprints have one and the same class (``low`` = ``high``)."""
    for a, b in tile_links(tile, in_tree, asks, fp, radius):
        keep = ((low[a] != high[b]) | (high[a] != low[b])) & (fp[a] != fp[b])
        yield fp[a[keep]].view(np.int64), fp[b[keep]].view(np.int64)


def shard_masks(blocks: int, radius: int) -> list[int]:
    """Masks of all choices of ``blocks - radius`` blocks of the 64 bits."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(ws: Workspace, forms: DataFrame, radius: int = 4, blocks: int = 6, tree_max: int = 4096, apart: bool = False) -> DataFrame:
    """Star links u, v among distinct fingerprints ``fp``; their components are those of all links.

    With ``apart`` the links themselves, all of them but those inside a class: ``forms`` then has ``low`` and ``high``, the
    first and last class of the forms of a fingerprint.
    """
    masks = shard_masks(blocks, radius)
    own = ["fp", "low", "high"] if apart else ["fp"]
    keyed = forms.select(
        *own, F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("s")
    ).select(*own, F.xxhash64("s.choice", "s.bits").alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = (
        # Spark sizes a table after an explode as before it and would send the choices of all fingerprints through the driver.
        keyed.join(sizes.hint("merge"), "shard")
        .withColumn("parts", F.ceil(F.col("n") / tree_max))
        .withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    )
    low, high = F.least("part", "other"), F.greatest("part", "other")
    tiles = parts.select(F.xxhash64("shard", low, high).alias("tile"), (F.col("part") == low).alias("in_tree"), (F.col("part") == high).alias("asks"), *own)
    n = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        rest = None
        for b in batches:
            rows = [np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(rest)] if rest else [b.column(i).to_numpy(zero_copy_only=False) for i in range(3 + len(own))]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last tile may go on in the next batch
            rest = [x[cut:] for x in rows]
            if cut:
                yield from found([x[:cut] for x in rows])
        if rest and len(rest[0]):
            yield from found(rest)

    def found(rows):
        rows = [rows[0], rows[1].astype(bool), rows[2].astype(bool), rows[3].view(np.uint64), *rows[4:]]
        for u, v in tile_apart(*rows, radius) if apart else [tile_stars(*rows, radius)]:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    pairs = tiles.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(run, "u long, v long")
    return ws.save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")


# ---------------------------------------------------------------- components of all links


def component_heads(ws: Workspace, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """u, v: each linked node with the smallest node of its component, the head itself left out.

    Large-star ties every larger neighbour of a node to the node's smallest one, small-star ties a node and its
    smaller neighbours to the smallest.  Only minima are gathered.  They are written before they are joined, so that
    both sides of each join come straight from a shuffle and Spark can split the links of a node of high degree.
    """
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = ws.save(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = ws.save(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, blocks: int = 6, tree_max: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    ws = Workspace(docs.sparkSession)
    fps = ws.save(fingerprints(docs, doc_id, text, width), "fingerprints")
    forms = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "forms")
    heads = component_heads(ws, links(ws, forms, radius, blocks, tree_max)).withColumnsRenamed({"u": "fp", "v": "head"})
    named = forms.join(heads, "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    ids = named.groupBy("head").agg(F.min("least").alias("component_id"))
    names = ws.save(named.join(ids, "head").select("fp", "component_id"), "names")
    return fps.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, all columns: the one with the smallest id.

    Ids are taken together with the text's digest, so that rows which share an id are told apart; rows without an id
    come last in a component.
    """
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), text_sha(F.col(text)).alias("sha"))
    groups = near_groups(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", **how)
    keep = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id.id", "doc_id.sha").agg(F.count(F.lit(1)).alias("n"))
    return keep_listed(docs, Workspace(docs.sparkSession).save(keep, "keep"), doc_id, F.col(text))
