"""Repeated passages by a depth-limited radix sort of suffixes.

Every position of every text starts a suffix, of which only the first ``depth`` bytes count.  Sorting goes from the
most significant digit on, a group of equal digits at a time: a group of one suffix ends (it repeats nothing), a
group whose members are equal through the full depth ends (it is a set of repeated windows), and only mixed groups
go on to the next digit.  Digits are hashes of byte ranges, since the order between groups is never asked for.

Neighbouring suffixes share most of their bytes, so the early digits sort them in blocks:

1. Anchor.  The suffix's digit is the gram of ``gram`` bytes, among those inside its ``depth`` bytes, with the least hash (leftmost
   on ties), and the suffix's distance to it.  Equal suffixes have equal anchors.  A run of suffixes with one
   anchor is one row: its group is the gram, its class the run's bytes as a whole.  Classes that meet another row are
   repeated in all their suffixes.  Runs in mixed groups go on, one row for each class.
2. Core.  A run is cut into cells of ``CELL`` suffixes on a grid around the anchor.  A cell's group is the bytes that all
   its suffixes share, its class the cell's bytes as a whole.
3. Window.  Cells of mixed groups are sorted suffix by suffix, to the full depth: equal groups are the repeated windows.

A row's place in the sort is 128 bits wide (group and class), and group hashes take the digits before them in.

Texts with equal digests are one text: all of it repeats if it is long enough, and one of them stands for it in the
sort.  Each task drops its own copies first, so copies never make up a group.  Groups are only counted and joined,
never gathered, so that no task holds a group.

Defined cases: a null text equals the empty one.  A text shorter than ``depth`` is kept whole.  Rows are judged each for
itself; rows that repeat an id with an equal text are copies of each other and lose it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import small_batches, utf8
from ledgerlink.session import Workspace

DEPTH = 400
GRAM = 100
CELL = 16
RUN_BYTES = 1 << 20
KNOWN_TEXTS = 200_000
MULTIPLIER = 0x9E3779B97F4A7C15
ALL = (1 << 64) - 1


# ---------------------------------------------------------------- hashes of byte ranges


class Ranges:
    """64-bit polynomial hashes of byte ranges of one buffer, from prefix sums."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    _bytes = None

    def __init__(self, data: bytes):
        n = len(data)
        if len(Ranges._powers[0]) <= n:
            Ranges._powers = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, r & ALL, np.uint64)])) for r in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
        if Ranges._bytes is None:
            Ranges._bytes = mix(np.arange(1, 257, dtype=np.uint64))
        b = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(Ranges._bytes[b] * Ranges._powers[0][:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * Ranges._powers[1][start]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from block-wise minima to both sides."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, ALL, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---------------------------------------------------------------- first digit: runs of one anchor


def segments(texts: list[bytes], depth: int, limit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of about ``limit`` bytes.  Pieces of a longer text overlap by depth - 1."""
    out, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - depth + 1, limit):
            piece = t[at : at + limit + depth - 1]
            out.append((i, at, piece))
            size += len(piece)
            if size >= limit:
                yield out
                out, size = [], 0
    if out:
        yield out


def runs(pieces: list[tuple[int, int, bytes]], depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first suffix, number of suffixes, anchor minus first, gram hash, run hash) of each run."""
    size = np.array([len(p) for _, _, p in pieces], np.int64)
    begin = np.cumsum(size) - size
    data = b"".join(p for _, _, p in pieces)
    ranges = Ranges(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(ranges(at, at + gram))
    least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), depth - gram + 1)
    n = size - depth + 1
    start = spans(begin, n)
    piece = np.repeat(np.arange(len(pieces)), n)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(start)]]))
    low, anchor, piece = start[first], anchor[first], piece[first]
    place = mix(((anchor - low) << 32 | n).astype(np.uint64))
    whole = mix(ranges(low, low + n - 1 + depth) + place)
    text = np.array([i for i, _, _ in pieces], np.int64)[piece]
    offset = np.array([o for _, o, _ in pieces], np.int64)[piece]
    return text, low - begin[piece] + offset, n, anchor - low, grams[anchor], whole


# ---------------------------------------------------------------- further digits: cells and windows of a run


def cells(contexts: list[bytes], n: np.ndarray, ahead: np.ndarray, gram: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(context number, first suffix in the context, number of suffixes, core hash, cell hash) of each cell."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(size) - size
    ranges = Ranges(b"".join(contexts))
    low = -ahead // CELL
    count = (n - 1 - ahead) // CELL - low + 1
    row = np.repeat(np.arange(len(contexts)), count)
    grid = spans(low, count)
    origin = ahead[row] + CELL * grid  # the grid cell's first suffix, relative to the run
    a, z = np.maximum(origin, 0), np.minimum(origin + CELL, n[row])
    at = begin[row]
    core = mix(ranges(at + origin + CELL - 1, at + origin + depth) + mix(gram[row] + grid.astype(np.uint64)))
    whole = mix(ranges(at + a, at + z - 1 + depth) + mix(core + ((a - origin) << 32 | (z - a)).astype(np.uint64)))
    return row, a, z - a, core, whole


def windows(contexts: list[bytes], row: np.ndarray, first: np.ndarray, n: np.ndarray, ahead: np.ndarray, core: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(cell number, suffix in the context, window hash) of each suffix of the cells."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(size) - size
    ranges = Ranges(b"".join(contexts))
    cell = np.repeat(np.arange(len(row)), n)
    p = spans(first, n)
    at = begin[row[cell]] + p
    return cell, p, mix(ranges(at, at + depth) + mix(core[cell] + (p - ahead[cell]).astype(np.uint64)))


# ---------------------------------------------------------------- Spark passes


def text_key(text: bytes) -> tuple[int, int]:
    d = hashlib.sha256(text).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


class OncePerTask:
    """Lets each text of a task pass once; a bounded memory only lets some copies pass again."""

    def __init__(self):
        self.seen: set = set()

    def __call__(self, texts: list[bytes]) -> tuple[list[bytes], list[tuple[int, int]]]:
        keys = [text_key(t) for t in texts]
        out = []
        for t, k in zip(texts, keys):
            if k not in self.seen:
                self.seen.add(k)
                out.append((t, k))
        if len(self.seen) > KNOWN_TEXTS:
            self.seen.clear()
        return [t for t, _ in out], [k for _, k in out]


RUN = "t1 long, t2 long, lo long, n int, ahead int, grp long, cls long"


def scan_runs(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    def scan(batches):
        once = OncePerTask()
        for b in batches:
            fresh, keys = once(utf8(b.column(0)))
            key = np.array(keys, np.int64).reshape(-1, 2)
            for pieces in segments(fresh, depth, RUN_BYTES):
                text, lo, n, ahead, grp, cls = runs(pieces, depth, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[text, 0]), pa.array(key[text, 1]), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(ahead.astype(np.int32)), signed(grp), signed(cls)],
                    ["t1", "t2", "lo", "n", "ahead", "grp", "cls"],
                )

    return texts.mapInArrow(scan, RUN)


def shared_groups(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The rows of groups with at least two rows; ``same`` if all of them are of one class.

    Counts are written before the join, so that both of its sides come straight from a shuffle and Spark can split
    the rows of a group that very many texts share.
    """
    known = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("a"), F.max("cls").alias("z")).filter("m > 1")
    known = ws.save(known.select("grp", (F.col("a") == F.col("z")).alias("same")), "groups")
    return rows.join(known, "grp")


def resolve(ws: Workspace, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(repeated rows, one row for each class of mixed groups), both of ``shared_groups`` rows.

    A class's row is ``alone`` if it stands for one row only: then its own suffixes are still open.
    """
    mixed = rows.filter("not same")
    classes = ws.save(mixed.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*columns)).alias("row")), "classes")
    again = classes.filter("m > 1").select("grp", "cls")
    repeated = rows.filter("same").select(columns).unionByName(mixed.join(again, ["grp", "cls"], "left_semi").select(columns))
    return repeated, classes.select("row.*", "grp", "cls", (F.col("m") == 1).alias("alone"))


def packed_texts(docs: DataFrame, once: bool) -> DataFrame:
    """The rows with the text packed (zstd) under its key; ``once``: each text once per task, without other columns."""
    others = [] if once else docs.columns[:-1]
    schema = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in others) + "t1 long, t2 long, packed binary"

    def run(batches):
        press, first = zstandard.ZstdCompressor(level=1), OncePerTask()
        for b in batches:
            texts = utf8(b.column(b.num_columns - 1))
            if once:
                texts, keys = first(texts)
            else:
                keys = [text_key(t) for t in texts]
            key = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(others))), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([press.compress(t) for t in texts], pa.binary())], [*others, "t1", "t2", "packed"]
            )

    return (docs.select(docs.columns[-1]) if once else docs).mapInArrow(run, schema)


def cut_contexts(texts: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """wanted (t1, t2, lo, n, ...) with the bytes of each run."""
    extra = [c for c in wanted.columns if c not in ("t1", "t2")]
    per = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct(*extra)).alias("asked"))  # runs of one text
    kinds = {c: wanted.schema[c].dataType.simpleString() for c in extra}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = zstandard.decompress(b.column(2)[i].as_py())
                asked = b.column(3).slice(i, 1).flatten()
                lo, n = asked.field("lo").to_pylist(), asked.field("n").to_pylist()
                for a in range(0, len(lo), 2048):
                    part = asked.slice(a, 2048)
                    bytes_ = pa.array([text[x : x + m - 1 + depth] for x, m in zip(lo[a : a + 2048], n[a : a + 2048])], pa.binary())
                    key = [pa.array([b.column(j)[i].as_py()] * len(part), pa.int64()) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*key, *(part.field(c) for c in extra), bytes_], ["t1", "t2", *extra, "context"])

    joined = texts.join(per, ["t1", "t2"]).select("t1", "t2", "packed", "asked")
    return joined.mapInArrow(run, "t1 long, t2 long, " + "".join(f"{c} {k}, " for c, k in kinds.items()) + "context binary")


def cell_rows(contexts: DataFrame, depth: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                p = pa.Table.from_batches([b.slice(a, 1024)])
                get = lambda c, p=p: p.column(c).to_numpy()
                row, first, n, core, whole = cells(p.column("context").to_pylist(), get("n").astype(np.int64), get("ahead").astype(np.int64), get("grp").view(np.uint64), depth)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(get(c)[row]) for c in ("t1", "t2", "lo", "alone")), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), signed(core), signed(whole)],
                    ["t1", "t2", "lo", "open", "first", "n", "grp", "cls"],
                )

    return contexts.mapInArrow(run, "t1 long, t2 long, lo long, open boolean, first int, n int, grp long, cls long")


def window_rows(contexts: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """One row per suffix of the wanted cells: core, window hash, the suffix's text and position, whether it is still open."""
    per = wanted.groupBy("t1", "t2", "lo").agg(F.collect_set(F.struct("first", "n", "grp", (F.col("open") & F.col("alone")).alias("open"))).alias("asked"))  # cells of one run

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 512):
                p = pa.Table.from_batches([b.slice(a, 512)]).combine_chunks()
                asked = p.column("asked").chunk(0) if p.num_rows else None
                if asked is None:
                    continue
                count = np.diff(asked.offsets.to_numpy())
                row = np.repeat(np.arange(p.num_rows), count)
                flat = asked.flatten()
                field = lambda c, flat=flat: flat.field(c).to_numpy(zero_copy_only=False)
                ahead = p.column("ahead").to_numpy().astype(np.int64)[row]
                core = field("grp").view(np.uint64)
                cell, at, hashed = windows(p.column("context").to_pylist(), row, field("first").astype(np.int64), field("n").astype(np.int64), ahead, core, depth)
                of = row[cell]
                yield pa.RecordBatch.from_arrays(
                    [signed(core[cell]), signed(hashed), *(pa.array(p.column(c).to_numpy()[of]) for c in ("t1", "t2")), pa.array(p.column("lo").to_numpy()[of] + at), pa.array(field("open").astype(bool)[cell])],
                    ["grp", "cls", "t1", "t2", "lo", "open"],
                )

    joined = contexts.select("t1", "t2", "lo", "ahead", "context").join(per, ["t1", "t2", "lo"])
    return joined.mapInArrow(run, "grp long, cls long, t1 long, t2 long, lo long, open boolean")


def repeated_spans(docs: DataFrame, text: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """t1, t2, lo, n: suffixes lo .. lo + n - 1 of the text with this key repeat in ``depth`` bytes somewhere else."""
    ws = Workspace(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    place = ["t1", "t2", "lo", "n", "ahead"]

    digit1 = ws.save(shared_groups(ws, scan_runs(texts, depth, gram)), "runs")
    whole_runs, open_runs = resolve(ws, digit1, place)
    contexts = ws.save(cut_contexts(packed_texts(texts, once=True), open_runs.drop("cls"), depth), "contexts")

    digit2 = ws.save(shared_groups(ws, cell_rows(contexts, depth)), "cells")
    whole_cells, open_cells = resolve(ws, digit2, ["t1", "t2", "lo", "first", "n", "open"])
    digit3 = ws.save(window_rows(contexts, open_cells, depth), "windows")
    again = ws.save(digit3.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("grp", "cls"), "again")
    whole_windows = digit3.filter("open").join(again, ["grp", "cls"], "left_semi")

    span = lambda lo, n: ["t1", "t2", lo.cast("long").alias("lo"), n.cast("long").alias("n")]
    return (
        whole_runs.select(*span(F.col("lo"), F.col("n")))
        .unionByName(whole_cells.filter("open").select(*span(F.col("lo") + F.col("first"), F.col("n"))))
        .unionByName(whole_windows.select(*span(F.col("lo"), F.lit(1))))
    )


def removed(n_bytes: int, spans: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by repeated windows."""
    out: list[list[int]] = []
    for lo, n in sorted(spans):
        hi = min(lo + n - 1 + depth, n_bytes)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, z) for a, z in out]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, removed (array of byte ranges), kept (binary: the text without them) for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = packed_texts(rows, once=False)
    found = repeated_spans(docs, text, depth, gram)
    # A text that occurs more than once repeats as a whole; -1 stands for all of its suffixes.
    copies = packed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("t1", "t2", F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("n"))
    per = found.unionByName(copies).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cut, kept, sizes = [], [], []
            for packed_text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = zstandard.decompress(packed_text)
                spans = [(s["lo"], s["n"]) for s in found or []]
                if any(n < 0 for _, n in spans):
                    spans = [(0, len(t) - depth + 1)] if len(t) >= depth else []
                gone = removed(len(t), spans, depth)
                ends = [0, *(x for r in gone for x in r), len(t)]
                cut.append([{"start": a, "stop": z} for a, z in gone])
                kept.append(b"".join(t[a:z] for a, z in zip(ends[::2], ends[1::2])))
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"]
            )

    joined = packed.join(per, ["t1", "t2"], "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
