"""Exact top-k inner products by a pivot-distance index.

Index: pivots are picked from a bounded sample (``SAMPLE`` rows with the smallest id hashes, farthest first); every
vector is keyed by its nearest pivot and the ring (annulus) of its distance to it.  Of each (pivot, ring) the least
and greatest distance, the greatest norm and the number of rows are known.

Bound: with |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, and |q - x| at least the gap between |q - pivot| and the ring (triangle
inequality), q.x <= (|q|^2 + norm^2 - gap^2) / 2.  Also q.x <= q.pivot + |q| * distance.  The lesser holds.

Search: rings are sorted by their bound.  Each query first visits the leading rings that together hold ``FIRST`` rows, which
gives it a k-th best score; then all further rings whose bound reaches that score.  Where no ring's bound falls below
it, all are visited, so the result is exact for any data.

Queries meet rings in tiles of at most about ``TILE_ROWS`` rows and ``TILE_QUERIES`` queries; a ring with very many rows (one vector
that makes up a third of all) is cut into parts by the hash of its rows' numbers.  Rows go only to the blocks of queries that visit their ring.
The number of pivots grows with the square root of the rows, up to the sample's size.

Components are floor(1024 x) whatever their size, and scores are exact integers; a score that leaves 64 bits raises.

Defined cases: rows whose id or vector is null, or whose vector holds null or non-finite components, take no part.
Shorter vectors count as filled up with zeros.  A query's own id is no candidate, in no row.  A query row that
repeats has one result; a candidate row that repeats is ranked as often as it occurs.  Equal scores go by the smaller id.  Other columns
are ignored and may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.session import Workspace

SCALE = 1024
SAMPLE = 4_096
PIVOTS = 64
RINGS = 8
FIRST = 256
TILE_ROWS = 4_096
TILE_QUERIES = 4_096
MEET_QUERIES = 256  # queries of a tile that are scored at once


def prepare(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (packed components), dim of the rows that take part."""
    e = F.transform(F.col(embedding), lambda v: v.cast("double"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite)

    def run(batches):
        for b in batches:
            flat, ends = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            with np.errstate(over="ignore"):
                x = np.floor(flat * SCALE)
            packed = [pack(x[a:z]) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(np.diff(ends).astype(np.int32))], ["vec_id", "x", "dim"])

    return rows.mapInArrow(run, "vec_id long, x binary, dim int")


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers where they fit, else as doubles, which hold them exactly."""
    if len(x) and np.abs(x).max() >= 2**31:
        if not np.isfinite(x).all():
            raise OverflowError("a component leaves the range of doubles")
        return b"\1" + x.astype("<f8").tobytes()
    return b"\0" + x.astype("<i4").tobytes()


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(packed), dim))
    for i, p in enumerate(packed):
        x = np.frombuffer(p, "<f8" if p[0] else "<i4", offset=1)
        out[i, : len(x)] = x
    return out


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    chosen = [0]
    apart = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can leave their 53 bits."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    exact = whole(q) @ whole(x).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score leaves 64 bits")
    return exact.astype(np.int64)


class Rings:
    """What is known of each (pivot, ring): at most SAMPLE * RINGS rows."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        rows = sorted(rows, key=lambda r: r["ring"])
        self.ring = np.array([r["ring"] for r in rows], np.int64)
        self.near = np.array([r["near"] for r in rows], float)
        self.far = np.array([r["far"] for r in rows], float)
        self.norm2 = np.array([r["norm2"] for r in rows], float)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.parts = np.maximum(1, -(-self.n // TILE_ROWS))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Greatest possible score of each query in each ring, rounded up."""
        pivot = self.ring // RINGS
        d = distances(q, self.pivots)[:, pivot]
        q2 = (q * q).sum(axis=1)[:, None]
        gap = np.maximum(0, np.maximum(d - self.far, self.near - d))
        triangle = (q2 + self.norm2 - gap**2) / 2
        cauchy = (q @ self.pivots.T)[:, pivot] + np.sqrt(q2) * self.far
        best = np.minimum(triangle, cauchy)
        size = q2 + self.norm2 + (self.pivots * self.pivots).sum(axis=1)[pivot]
        return best + 1 + 1e-9 * size  # more than what rounding can take off

    def visits(self, q: np.ndarray, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring index) to visit: the leading rings if ``least`` is None, else the others that may reach it."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        leading = before < FIRST
        go = leading if least is None else ~leading & (np.take_along_axis(bound, order, axis=1) >= least[:, None])
        row, at = np.nonzero(go)
        return row, order[row, at]


def search(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best other rows."""
    spark = vectors.sparkSession
    ws = Workspace(spark)
    rows = ws.save(prepare(vectors, vec_id, embedding), "vectors")
    dim, n_rows = rows.agg(F.max("dim"), F.count(F.lit(1))).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    pivots = pick_pivots(matrix(sample, dim), max(PIVOTS, math.isqrt(n_rows) // 8))

    def nearest(batches):
        for b in batches:
            x = matrix(b.column(1).to_pylist(), dim)
            d = distances(x, pivots)
            pivot = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pivot.astype(np.int64)), pa.array(d[np.arange(len(d)), pivot]), pa.array((x * x).sum(axis=1))], ["vec_id", "x", "pivot", "distance", "norm2"]
            )

    keyed = ws.save(rows.select("vec_id", "x").mapInArrow(nearest, "vec_id long, x binary, pivot long, distance double, norm2 double"), "keyed")
    width = (keyed.agg(F.max("distance")).first()[0] or 0.0) / RINGS + 1e-9
    ring = F.col("pivot") * RINGS + F.least(F.floor(F.col("distance") / width), F.lit(RINGS - 1))
    keyed = keyed.withColumn("ring", ring).withColumn("row", F.monotonically_increasing_id())
    known = keyed.groupBy("ring").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm2").alias("norm2"), F.count(F.lit(1)).alias("n")).collect()
    rings = Rings(pivots, known)

    queries = ws.save(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "x").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-queries.count() // TILE_QUERIES))
    parts = spark.createDataFrame(list(zip(rings.ring.tolist(), rings.parts.tolist())), "ring long, parts long")  # one row a ring
    placed = keyed.join(parts, "ring").select("ring", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.col("vec_id").alias("id"), "x")

    def route(first: bool):
        def run(batches):
            for b in batches:
                q = matrix(b.column(2).to_pylist(), dim)
                least = None if first else b.column(3).to_numpy(zero_copy_only=False).astype(float)
                for a in range(0, len(q), 256):
                    row, at = rings.visits(q[a : a + 256], None if first else least[a : a + 256])
                    n = rings.parts[at]
                    row, at = np.repeat(row + a, n), np.repeat(at, n)
                    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    take = pa.array(row)
                    number = b.column(0).take(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rings.ring[at]), pa.array(piece), pa.array((number.to_numpy() % blocks).astype(np.int32)), number, *(b.column(i).take(take) for i in (1, 2, 3))],
                        ["ring", "part", "block", "q", "vec_id", "x", "least"],
                    )

        return run

    def visited(first: bool):
        """(ring, block) of each visit of a batch."""

        def run(batches):
            for b in batches:
                number, q = b.column(0).to_numpy(), matrix(b.column(2).to_pylist(), dim)
                least = None if first else b.column(3).to_numpy(zero_copy_only=False).astype(float)
                for a in range(0, len(q), 256):
                    row, at = rings.visits(q[a : a + 256], None if first else least[a : a + 256])
                    pair = np.unique(np.stack([rings.ring[at], number[row + a] % blocks]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0].astype(np.int64)), pa.array(pair[1].astype(np.int32))], ["ring", "block"])

        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q", "query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int64())] * 4, names)
        if not left.num_rows or not right.num_rows:
            return empty
        ids = right.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], matrix([p for p in right.column("x").to_pylist()], dim)[order]
        return pa.concat_tables([empty, *(scored(left.slice(a, MEET_QUERIES), ids, x, names) for a in range(0, left.num_rows, MEET_QUERIES))])

    def scored(left: pa.Table, ids: np.ndarray, x: np.ndarray, names: list[str]) -> pa.Table:
        number, own, least = (left.column(c).to_numpy() for c in ("q", "vec_id", "least"))
        score = products(matrix(left.column("x").to_pylist(), dim), x)
        fits = (ids[None] != own[:, None]) & (score >= least[:, None])
        low = np.iinfo(np.int64).min
        top = np.argsort(-np.where(fits, np.maximum(score, low + 1), low + 1), axis=1, kind="stable")[:, :k] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), score.shape)
        row = np.repeat(np.arange(len(own)), top.shape[1])
        col = top.ravel()
        good = fits[row, col]
        row, col = row[good], col[good]
        return pa.table([pa.array(number[row]), pa.array(own[row]), pa.array(ids[col]), pa.array(score[row, col])], names)

    def best(pairs: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        routed = asked.mapInArrow(route(first), "ring long, part long, block int, q long, vec_id long, x binary, least long")
        tile = ["ring", "part", "block"]
        blocks_of = asked.mapInArrow(visited(first), "ring long, block int").distinct()
        data = placed.join(blocks_of, "ring").select("ring", "part", "block", "id", "x")
        return routed.groupBy(*tile).cogroup(data.groupBy(*tile)).applyInArrow(meet, "q long, query_id long, vec_id long, score long")

    none = F.lit(-(2**63)).cast("long")
    leading = ws.save(best(visit(queries.select("q", "vec_id", "x", none.alias("least")), True)), "leading")
    reached = leading.filter(F.col("rank") == k).select("q", F.col("score").alias("least"))
    asked = queries.join(reached, "q", "left").select("q", "vec_id", "x", F.coalesce("least", none).alias("least"))
    every_pair = leading.drop("rank").unionByName(visit(asked, False))
    return best(every_pair).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
