"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``width`` consecutive words of one text.  Every word is removed that lies in a window which also starts in a document
with a smaller id; windows are judged on the input.

1. Confirm.  Each window has an anchor: of its grams of ``gram`` words the one with the least hash.  Equal windows have equal
   anchors, so only windows whose anchor occurs in two texts can recur.  The stretches of such windows are cut
   out of their texts, their windows are hashed, and of each hash the stretch with the smallest id owns it.  A text whose window is
   owned by a smaller id asks for the owner's stretch.
2. Compile.  Texts are dealt to shards of about ``SHARD_WORDS`` words.  A shard gathers the stretches its texts asked for, each
   once, and compiles those of their windows whose hash some text of the shard has into Aho-Corasick automata over words, with the
   owner's id as output; an automaton holds at most ``AUTOMATON`` windows.
3. Stream.  Every text runs through its shard's automata.  An occurrence of a window whose owner has a smaller id
   removes its words.

Hashes only route: the automata compare the words themselves, so equal hashes of different windows never remove a word.  They
could hide a smaller owner, at a chance of (recurring windows) / 2^64 for a window.

Copies of a text are one class with the smallest id; the others are removed whole (from ``width`` words on) without being read again.
Grams and windows that a batch of texts holds several times are settled in the batch and leave it as one row, so a passage
that very many documents share makes up one row a batch in its group.  Nothing is gathered but the grams of one text,
and the phrases of a shard, of which there are no more than its texts have windows.

Defined cases: null, empty and blank texts have no words and stay empty.  Fewer than ``width`` words stay as they are.  Ids are cast to
long; a null id counts as larger than all others, and two null ids do not remove each other.  Rows that repeat an id do not
remove each other either, their texts are told apart; equal rows give equal results.  Very long texts are judged whole.  Other columns
are ignored and may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm.base import chunks, small_batches, utf8
from ledgerlink.session import Workspace

WIDTH, GRAM = 13, 4
CHUNK = 4 << 20
SHARD_WORDS = 400_000
AUTOMATON = 1 << 16
DIGITS = 256
STRETCH = 32  # windows of a stretch; a longer one is cut
KNOWN = 1 << 20  # texts that a task remembers
LAST = (1 << 63) - 1
HIGH = np.uint64(0xFFFFFFFF00000000)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbouring words."""
    size = max(len(codes) - n + 1, 0)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + size]
    return mix(h)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    n, done = len(x) - width + 1, 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string start and stop."""
    word = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_codes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes as digits, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)]))
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    digits = mix(np.arange(1, 257, dtype=np.uint64))[raw[place + np.repeat(start, size)]]
    return mix(np.add.reduceat(digits * powers[place], first))


class Words:
    """The words of several texts end to end, and the first words of their windows."""

    def __init__(self, texts: list[bytes], width: int):
        self.width = width
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        self.start, self.stop = word_places(raw)
        self.codes = word_codes(raw, self.start, self.stop)
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.searchsorted(self.start, np.cumsum(length) - length)  # the first word of each text
        size = np.diff(np.append(self.begin, len(self.start)))
        n = np.maximum(size - width + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), n)
        self.at = np.repeat(self.begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def cut(self, a: int, z: int) -> bytes:
        """The words a to z - 1, as they stand in the text."""
        return self.data[self.start[a] : self.stop[z - 1]]

    def anchors(self, gram: int) -> np.ndarray:
        """48 bits of the anchor of each window."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        grams = rolled(self.codes, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = least_of(grams & HIGH | place, self.width - gram + 1)[self.at]
        return grams[(least & ~HIGH).astype(np.int64)] >> np.uint64(16)

    def hashes(self) -> np.ndarray:
        """64 bits of each window."""
        return rolled(self.codes, self.width)[self.at]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before in one of the keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def grouped(key: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys and the rows of each."""
    head = np.flatnonzero(firsts(key)) if len(key) else np.zeros(0, np.int64)
    return key[head].tolist(), np.split(rows, head[1:]) if len(head) else []


# ---------------------------------------------------------------- texts and their classes


def text_key(text: bytes) -> tuple[int, int]:
    d = hashlib.sha256(text).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


def described(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, t1, t2 (the text's key), n_words, and the joined words of a text too short for a window."""

    def run(batches):
        for b in batches:
            texts = utf8(b.column(1))
            key = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
            words = [t.split() for t in texts]
            short = [b" ".join(w) if len(w) < width else None for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([len(w) for w in words], pa.int64()), pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "t1", "t2", "n_words", "short"]
            )

    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, n_words long, short string")


def text_classes(told: DataFrame) -> DataFrame:
    """t1, t2, n_words, low (the smallest id of the text), rank (it, or ``LAST``), times (rows with that id)."""
    each = told.groupBy("t1", "t2", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.max("n_words").alias("n_words"))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "times")).alias("low")
    least = each.groupBy("t1", "t2").agg(low, F.max("n_words").alias("n_words"))
    return least.select("t1", "t2", "n_words", F.col("low.doc_id").alias("low"), F.coalesce("low.doc_id", F.lit(LAST)).alias("rank"), F.col("low.times").alias("times"))


def packed_texts(texts: DataFrame) -> DataFrame:
    """t1, t2, packed: the texts under their keys, each at most once a task while the task remembers it."""

    def run(batches):
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            key, packed = [], []
            for t in utf8(b.column(0)):
                k = text_key(t)
                if k not in seen:
                    seen.add(k)
                    key.append(k)
                    packed.append(press.compress(t))
            if len(seen) > KNOWN:
                seen.clear()
            key = np.array(key, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(packed, pa.binary())], ["t1", "t2", "packed"])

    return texts.mapInArrow(run, "t1 long, t2 long, packed binary")


# ---------------------------------------------------------------- confirm


def anchor_rows(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """lot, g, t1, t2, n: texts of this batch that hold the anchor ``g``.

    One row a batch and anchor goes to the anchor's lot and says whether one or more texts hold it (n of 1 or 2); if
    more do, the other rows need no count any more and go to lots of their own (n of 0).
    """

    def run(batches):
        seen: set = set()
        for b in batches:
            for _, texts in chunks(utf8(b.column(0)), CHUNK):
                fresh: dict = {}
                for i, t in enumerate(texts):
                    k = text_key(t)
                    if k not in seen:
                        seen.add(k)
                        fresh[k] = i
                if len(seen) > KNOWN:
                    seen.clear()
                w = Words([texts[i] for i in fresh.values()], width)
                g = w.anchors(gram)
                one = firsts(g, w.text)
                g, text = g[one], w.text[one]
                by = np.lexsort((text, g))
                g, text = g[by], text[by]
                one = firsts(g, text)
                g, text = g[one], text[one]
                head = firsts(g)
                many = np.bincount(np.cumsum(head) - 1, minlength=1)[np.cumsum(head) - 1] > 1
                key = np.array(list(fresh), np.int64).reshape(-1, 2)[text]
                lot = np.where(head, g, mix(g ^ key[:, 0].view(np.uint64)))
                n = np.where(head, 1 + many, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lot.view(np.int64)), pa.array(g.view(np.int64)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(n)], ["lot", "g", "t1", "t2", "n"])

    return texts.mapInArrow(run, "lot long, g long, t1 long, t2 long, n int")


def cut_stretches(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """t1, k, rank, stretch (zstd): the k-th stretch of windows of a text (t1, rank, grams, packed) with one of the grams as anchor."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for first, texts in chunks(map(zstandard.decompress, b.column(3).to_pylist()), CHUNK):
                part = b.slice(first, len(texts))
                lists = part.column(2)
                of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy()).astype(np.uint64)
                spread = lambda g, i: mix(g + i * np.uint64(0x9E3779B97F4A7C15))
                asked = spread(lists.flatten().to_numpy().view(np.uint64), of)
                w = Words(texts, width)
                g = w.anchors(gram)
                head = firsts(g, w.text)  # neighbouring windows mostly share their anchor
                hit = np.isin(spread(g[head], w.text[head].astype(np.uint64)), asked)[np.cumsum(head) - 1]
                at, text = w.at[hit], w.text[hit]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(at)))
                cut = -(-n // STRETCH)
                head = np.repeat(head - STRETCH * (np.cumsum(cut) - cut), cut) + STRETCH * np.arange(int(cut.sum()))
                start, of = at[head], text[head]
                n = np.diff(np.append(head, len(at)))
                k = np.arange(len(head)) - np.searchsorted(of, of)
                bodies = [press.compress(w.cut(a, a + m + width - 1)) for a, m in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(k.astype(np.int32)), part.column(1).take(pa.array(of)), pa.array(bodies, pa.binary())], ["t1", "k", "rank", "stretch"])

    return texts.select("t1", "rank", "grams", "packed").mapInArrow(run, "t1 long, k int, rank long, stretch binary")


def window_rows(stretches: DataFrame, width: int) -> DataFrame:
    """lot, rank, t1, k, o1, ok: windows of the stretches, as in ``anchor_rows``.

    Of the texts of a batch that hold a window, the smallest go to the window's lot; the others know a smaller owner
    (text o1, stretch ok) already and go to lots of their own, once for each owner's stretch.
    """

    def run(batches):
        for b in batches:
            for first, texts in chunks(map(zstandard.decompress, b.column(3).to_pylist()), CHUNK):
                part = b.slice(first, len(texts))
                t1, k, rank = (part.column(c).to_numpy() for c in range(3))
                w = Words(texts, width)
                h, row = w.hashes(), w.text
                by = np.lexsort((row, t1[row], rank[row], h))
                h, row = h[by], row[by]
                one = firsts(h, t1[row], rank[row])
                h, row = h[one], row[one]
                group = np.cumsum(firsts(h)) - 1
                head = np.flatnonzero(firsts(h)) if len(h) else np.zeros(0, np.int64)
                owner = row[head][group] if len(h) else row
                direct = rank[row] > rank[owner]
                pair = np.unique(np.stack([row[direct], owner[direct]]), axis=1)
                lot = np.concatenate([h[~direct], mix(mix(t1[pair[0]].view(np.uint64)) ^ t1[pair[1]].view(np.uint64))])
                rows = np.concatenate([row[~direct], pair[0]])
                told = np.arange(len(rows)) >= int((~direct).sum())
                owners = np.concatenate([row[~direct], pair[1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lot.view(np.int64)), pa.array(rank[rows]), pa.array(t1[rows]), pa.array(k[rows]), pa.array(t1[owners], mask=~told), pa.array(k[owners], mask=~told)],
                    ["lot", "rank", "t1", "k", "o1", "ok"],
                )

    return stretches.mapInArrow(run, "lot long, rank long, t1 long, k int, o1 long, ok int")


# ---------------------------------------------------------------- compile and stream


class Automaton:
    """An Aho-Corasick automaton over words for windows, with the smallest rank that holds each.

    A word is two symbols, a high and a low digit from alphabets of their own: windows are found at whole words only, and no node has
    more than ``DIGITS`` children, which the automaton searches one by one.
    """

    OTHER = chr(3 * DIGITS) * 2

    def __init__(self):
        self.symbols: dict[str, str] = {}
        self.windows: dict[str, int] = {}
        self.found = None

    def full(self, words: int) -> bool:
        """Whether a phrase of so many words may not fit."""
        return bool(self.windows) and (len(self.windows) + words > AUTOMATON or len(self.symbols) + words > DIGITS * DIGITS)

    def line(self, words: list[bytes]) -> str:
        symbols, out = self.symbols, []
        for w in words:
            symbol = symbols.get(w)
            if symbol is None:
                n = len(symbols)
                symbol = symbols[w] = chr(DIGITS + n // DIGITS) + chr(n % DIGITS)
            out.append(symbol)
        return "".join(out)

    def add(self, words: list[bytes], starts: list[int], width: int, rank: int):
        """The windows at ``starts`` of a phrase."""
        line = self.line(words)
        for a in starts:
            w = line[2 * a : 2 * (a + width)]
            if rank < self.windows.get(w, rank + 1):
                self.windows[w] = rank

    def compile(self) -> Automaton:
        self.found = ahocorasick.Automaton()
        for w, rank in self.windows.items():
            self.found.add_word(w, rank)
        self.found.make_automaton()
        return self

    def ends(self, words: list[bytes], rank: int) -> np.ndarray:
        """The last words of the windows that a smaller rank holds."""
        get, other = self.symbols.get, self.OTHER
        line = "".join([get(w, other) for w in words])
        return np.array([end >> 1 for end, owner in self.found.iter(line) if owner < rank], np.int64)


class Shard:
    """The texts of a shard, read once for the hashes of their windows and once, when the phrases are known, by each automaton."""

    def __init__(self, width: int):
        self.width, self.classes, self.texts, self.phrases = width, {}, {}, []

    def automata(self):
        """One automaton at a time, over all windows of the phrases that the texts may hold."""
        if not self.phrases:
            return
        known, rank = self.asked()
        out = Automaton()
        self.phrases.sort()
        for first, part in chunks([p for _, p in self.phrases], CHUNK >> 1):
            w = Words(list(map(zstandard.decompress, part)), self.width)
            of = np.array([r for r, _ in self.phrases[first : first + len(part)]], np.int64)[w.text]
            h = w.hashes()
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero((known[place] == h) & (of < rank[place])) if len(known) else np.zeros(0, np.int64)
            by = hit[np.argsort(h[hit], kind="stable")]  # phrases come by rank, so the first of equal hashes has the smallest
            hit = np.sort(by[firsts(h[by])])
            ends = np.append(w.begin[1:], len(w.start))
            for k, at in zip(*grouped(w.text[hit], w.at[hit])):
                begin, end = int(w.begin[k]), int(ends[k])
                if out.full(end - begin):
                    yield out.compile()
                    out = Automaton()
                out.add(w.cut(begin, end).split(), (at - begin).tolist(), self.width, self.phrases[first + k][0])
        if out.windows:
            yield out.compile()

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the texts' windows, and the largest rank of a text that has each."""
        hashes, ranks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        keys = list(self.texts)
        for first, part in chunks(self.texts.values(), CHUNK >> 1):
            w = Words(list(map(zstandard.decompress, part)), self.width)
            rank = np.array([self.classes[k][0] for k in keys[first : first + len(part)]], np.int64)
            hashes.append(w.hashes())
            ranks.append(rank[w.text])
        h, rank = np.concatenate(hashes), np.concatenate(ranks)
        by = np.lexsort((-rank, h))
        one = by[firsts(h[by])]
        return h[one], rank[one]

    def judged(self):
        """low, number of words, removed ranges, kept text and times of each text."""
        words = {key: zstandard.decompress(packed).split() for key, packed in self.texts.items()}
        change = {key: np.zeros(len(w) + 1, np.int64) for key, w in words.items()}
        for automaton in self.automata():
            for key, w in words.items():
                ends = automaton.ends(w, self.classes[key][0])
                np.add.at(change[key], ends - self.width + 1, 1)
                np.add.at(change[key], ends + 1, -1)
        for key, w in words.items():
            _, low, times = self.classes[key]
            gone = np.cumsum(change[key][:-1]) > 0
            kept = b" ".join(w if not gone.any() else [x for x, g in zip(w, gone.tolist()) if not g])
            yield low, len(w), ranges(gone), kept, times


def ranges(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))).tolist()
    return [{"start": a, "stop": z} for a, z in zip(edge[::2], edge[1::2])]


RESULT = "doc_id long, n_words long, removed array<struct<start:long,stop:long>>, kept string"


def stream(dealt: DataFrame, width: int) -> DataFrame:
    """``RESULT`` and times of the texts of sorted rows (shard, kind, t1, t2, rank, low, times, body).

    Of each shard come the classes of its texts (kind 0) first, then the texts (1, body), then the phrases (2, body).
    """
    removed_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        number, shard = None, Shard(width)
        for b in batches:
            small = [b.column(c).to_pylist() for c in range(7)]
            for i, (s, kind, t1, t2, rank, low, times) in enumerate(zip(*small)):
                if s != number:
                    yield from records(shard)
                    number, shard = s, Shard(width)
                if kind == 0:
                    shard.classes[t1, t2] = rank, low, times
                elif kind == 1:  # copies from other tasks are equal
                    shard.texts.setdefault((t1, t2), b.column(7)[i].as_py())
                else:
                    shard.phrases.append((rank, b.column(7)[i].as_py()))
        yield from records(shard)

    def records(shard):
        out, size = [[], [], [], [], []], 0
        for row in shard.judged():
            for column, value in zip(out, row):
                column.append(value)
            size += len(row[3])
            if size > CHUNK:
                yield record(out)
                out, size = [[], [], [], [], []], 0
        yield record(out)

    def record(out):
        kinds = (pa.int64(), pa.int64(), removed_type, pa.binary(), pa.int64())
        arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
        arrays[3] = arrays[3].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "removed", "kept", "times"])

    return dealt.mapInArrow(run, f"{RESULT}, times long")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, removed (array of word ranges), kept (the other words, joined by one space) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = ws.save(described(rows, width), "rows")
    classes = ws.save(text_classes(told), "classes")
    texts = packed_texts(rows.select("text"))

    lot = Window.partitionBy("lot")
    held = anchor_rows(rows.select("text"), width, gram).withColumn("holders", F.sum("n").over(lot))
    grams = held.filter("n = 0 or holders > 1").groupBy("t1", "t2").agg(F.collect_set("g").alias("grams"))  # of one text
    asked = classes.select("t1", "t2", "rank").join(grams, ["t1", "t2"])
    stretches = ws.save(cut_stretches(texts.dropDuplicates(["t1", "t2"]).join(asked, ["t1", "t2"]), width, gram), "stretches")

    owned = window_rows(stretches, width).withColumn("owner", F.min(F.struct("rank", "t1", "k")).over(lot))
    n_words = classes.agg(F.sum("n_words")).first()[0] or 0
    shard = lambda t1: F.pmod(F.xxhash64(t1), F.lit(n_words // SHARD_WORDS + 1))
    requests = (
        owned.filter("o1 is not null or rank > owner.rank")
        .select(shard(F.col("t1")).alias("shard"), F.coalesce("o1", "owner.t1").alias("t1"), F.coalesce("ok", "owner.k").alias("k"))
        .distinct()
    )
    phrases = requests.join(stretches, ["t1", "k"])

    def lay(kind: int, df: DataFrame, where: Column, **given: Column) -> DataFrame:
        names = {"t1": "long", "t2": "long", "rank": "long", "low": "long", "times": "long", "body": "binary"}
        return df.select(where.alias("shard"), F.lit(kind).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in names.items()])

    key = {"t1": F.col("t1"), "t2": F.col("t2")}
    dealt = (
        lay(2, phrases, F.col("shard"), rank=F.col("rank"), body=F.col("stretch"))
        .unionByName(lay(0, classes, shard(F.col("t1")), **key, rank=F.col("rank"), low=F.col("low"), times=F.col("times")))
        .unionByName(lay(1, texts, shard(F.col("t1")), **key, body=F.col("packed")))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = stream(dealt.repartition(n, "shard").sortWithinPartitions("shard", "kind", "t1", "t2"), width)
    judged = judged.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("row", "times")

    none = F.array().cast("array<struct<start:long,stop:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    copies = told.join(classes.select("t1", "t2", "low"), ["t1", "t2"]).filter(~F.col("doc_id").eqNullSafe(F.col("low")))
    long_enough = F.col("short").isNull()
    return judged.unionByName(copies.select("doc_id", "n_words", F.when(long_enough, whole).otherwise(none).alias("removed"), F.coalesce("short", F.lit("")).alias("kept")))
