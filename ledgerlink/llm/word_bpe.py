"""Word-level BPE encoding with the public vocabulary ``word_bpe_49k.json``, and decoding.

Normalising and splitting never look across white space, so a text's ids are those of its white-space separated
pieces in a row.  Each distinct piece is resolved once per worker and then only looked up:

1. the piece is lower-cased and cut into words, digits and runs of other signs;
2. frequent words come out of the memory-mapped transducer (``lexicon``);
3. other words are merged exactly, lowest rank first and leftmost first, many words at a time;
4. pieces with characters beyond Latin-1, special tokens' marks or very long words go through the tokenizers library, whose
   Unicode tables then hold.

Frequent words are counted over all texts.  Their number is bounded by ``LEXICON_WORDS``; which words are in the
lexicon never changes a result.

Defined cases: a null text equals the empty one and has no ids.  Rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import lexicon as lx
from ledgerlink.llm.base import chunks, small_batches, utf8, worker_cache
from ledgerlink.session import Workspace, shared_dir

LEXICON_WORDS = 65_536
LEXICON_WORD_BYTES = 48
LONG_WORD = 48
KNOWN_PIECES = 200_000
RUN_BYTES = 2 << 20
END = "</w>"

# Latin-1 letters and numbers by Unicode category; what is neither (nor white space) is a sign.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼-¾"
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|\n|[^\s{_LETTERS}{_NUMBERS}]+")
BEYOND = re.compile(r"[\x1c-\x1f\x80-\xa0Ā-\U0010ffff]|<\|")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """Tables of a vocabulary file for merging and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.path = path
        signs = _byte_signs()
        self.first = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + END] for s in signs], np.int64)
        pairs = spec["model"]["merges"]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.spelled = np.array([self.token.get(i, "").encode() for i in range(max(self.token) + 1)], object)
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((b >= 0) & (self.key[at] == key), self.rank[at], self.none)

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each); words are not empty and at most LONG_WORD bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        n = np.zeros(len(words), np.int64)
        parts = []
        order = np.argsort(sizes, kind="stable")
        for rows in np.array_split(order, len(order) // 8192 + 1):
            if len(rows):
                ids, n[rows] = self._merge_block(text, start[rows], sizes[rows])
                parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return flat[lx.spans(at, n)], n

    def _merge_block(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        cols = np.arange(width)
        inside = cols < size[:, None]
        byte = text[np.where(inside, start[:, None] + cols, start[:, None])]
        sym = np.where(inside, self.first[byte], -1)
        rows = np.arange(len(size))
        sym[rows, size - 1] = self.last[byte[rows, size - 1]]
        sym = np.concatenate([sym, np.full((len(size), 2), -1)], axis=1)
        rank = self.ranks(sym[:, :-1], sym[:, 1:])
        live, done = rows, sym
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            on = best < self.none
            if not on.all():
                done[live[~on]] = sym[~on]
                live, sym, rank, at, best = live[on], sym[on], rank[on], at[on], best[on]
                if not len(live):
                    break
            i = np.arange(len(at))
            sym[i, at] = self.merged[best]
            past = np.arange(sym.shape[1] - 1) > at[:, None]
            sym[:, :-1] = np.where(past, sym[:, 1:], sym[:, :-1])
            rank[:, :-1] = np.where(past[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            rank[i, at] = self.ranks(sym[i, at], sym[i, at + 1])
            left = at > 0
            rank[i[left], at[left] - 1] = self.ranks(sym[i[left], at[left] - 1], sym[i[left], at[left]])
        keep = done >= 0
        return done[keep], keep.sum(axis=1)


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """Ids of texts, with a bounded memory of the pieces seen so far."""

    def __init__(self, vocabulary: Vocabulary, lexicon: lx.Lexicon | None = None, known: int = KNOWN_PIECES):
        self.vocabulary, self.lexicon, self.most = vocabulary, lexicon, known
        self._forget()

    def _forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(0, np.int32), 0

    def encode(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        pieces = [t.split() for t in texts]
        words = [w for p in pieces for w in p]
        if len(self.code) > self.most:
            self._forget()
        fresh = list(set(words).difference(self.code))
        if fresh:
            self._learn(fresh)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        n = self.size[codes]
        ids = self.flat[lx.spans(self.start[codes], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        per = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return ids, np.diff(ends[np.concatenate([[0], per])])

    def _learn(self, fresh: list[bytes]) -> None:
        odd, plain = [], []
        for w in fresh:
            (odd if len(w) > LONG_WORD else plain).append(w)
        text = b"\n".join(plain).decode()
        if BEYOND.search(text):
            split = text.split("\n")
            odd += [w for w, s in zip(plain, split) if BEYOND.search(s)]
            kept = [(w, s) for w, s in zip(plain, split) if not BEYOND.search(s)]
            plain, text = [w for w, _ in kept], "\n".join(s for _, s in kept)
        if plain:
            cuts = CUT.findall(text.lower())
            index = {"\n": 0}
            at = np.array([index.setdefault(c, len(index)) for c in cuts], np.int64)
            words = [c.encode() for c in index][1:]
            ids, n = self._words(words)
            start, n = np.concatenate([[0], np.cumsum(n) - n]), np.concatenate([[0], n])
            ends = np.concatenate([[0], np.cumsum(n[at])])
            breaks = np.concatenate([np.flatnonzero(at == 0), [len(at)]])
            self._add(plain, ids[lx.spans(start[at], n[at])], np.diff(np.concatenate([[0], ends[breaks]])))
        if odd:
            found = [self.vocabulary.library.encode(w.decode(), add_special_tokens=False).ids for w in odd]
            self._add(odd, np.array([i for f in found for i in f], np.int64), np.fromiter(map(len, found), np.int64, len(found)))

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.lexicon is None:
            return self.vocabulary.merge(words)
        rank = self.lexicon.ranks(words)
        seen = rank >= 0
        new = np.flatnonzero(~seen)
        merged, m = self.vocabulary.merge([words[i] for i in new])
        out, k = self.lexicon.outputs(rank[seen])
        n, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n[seen], n[new] = k, m
        start[seen], start[new] = np.cumsum(k) - k, np.cumsum(m) - m + len(out)
        return np.concatenate([out, merged])[lx.spans(start, n)], n

    def _add(self, pieces: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        first = len(self.size)
        self.code.update(zip(pieces, range(first, first + len(pieces))))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.used += len(ids)


def worker_encoder(vocabulary: str, lexicon: str | None = None) -> Encoder:
    """The worker's encoder of this vocabulary and lexicon; later tasks find its pieces again."""
    cache = worker_cache()
    if (v := ("vocabulary", vocabulary)) not in cache:
        cache[v] = Vocabulary(vocabulary)
    if (e := ("encoder", vocabulary, lexicon)) not in cache:
        cache[e] = Encoder(cache[v], lx.Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return cache[e]


def id_lists(encoder: Encoder, texts: list[bytes], run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, ids in a row, number of ids of each) for runs of texts of bounded size."""
    for first, run in chunks(texts, run_bytes):
        if len(run) == 1 and len(run[0]) > 2 * run_bytes:
            yield first, *_long(encoder, run[0], run_bytes)
        else:
            yield first, *encoder.encode(run)


def _long(encoder: Encoder, text: bytes, step: int) -> tuple[np.ndarray, np.ndarray]:
    """A very long text in segments cut at white space."""
    parts, at = [], 0
    while at < len(text):
        cut = re.compile(rb"\s").search(text, at + step)
        end = cut.end() if cut else len(text)
        parts.append(encoder.encode([text[at:end]])[0])
        at = end
    ids = np.concatenate(parts)
    return ids, np.array([len(ids)])


# ---------------------------------------------------------------- lexicon of a corpus


def word_counts(docs: DataFrame, text: str = "text", most: int = 100_000) -> DataFrame:
    """word (lower-case letters only), n over all texts.  Each task counts its own texts first."""
    small_batches(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in utf8(b.column(0)):
                seen.update(t.split())
                if len(seen) > most:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    def flush(seen):
        pieces = {w: n for w, n in seen.items() if len(w) <= LEXICON_WORD_BYTES}
        text = b"\n".join(pieces).decode().lower()
        counts, at = Counter(), 0
        sizes = list(pieces.values())
        for c in CUT.findall(text):
            if c == "\n":
                at += 1
            elif c[0].isalpha() and not BEYOND.search(c):
                counts[c] += sizes[at]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, text: str = "text", vocabulary: str | None = None, size: int = LEXICON_WORDS) -> str:
    """Counts words over all texts, compiles the most frequent (at most ``size``) and gives every executor the file.

    Frequency bands of an eighth of a power of two decide, so the driver sees a few hundred band sizes and then
    only the words of whole bands that fit.  Returns the file's name among Spark's files.
    """
    spark = docs.sparkSession
    words = Workspace(spark).save(word_counts(docs, text).filter("n > 1").withColumn("band", F.floor(F.log2("n") * 8)), "words")
    bands = sorted(map(tuple, words.groupBy("band").count().collect()), reverse=True)
    total, lowest = 0, None
    for band, n in bands:
        total += n
        if total > size:
            break
        lowest = band
    rows = [] if lowest is None else words.filter(F.col("band") >= lowest).select("word").collect()
    frequent = sorted(r[0].encode() for r in rows)
    ids, n = Vocabulary(vocabulary or default_vocabulary()).merge(frequent) if frequent else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    data = lx.build(frequent, [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if frequent else [])
    return share_file(spark, data, "lexicon")


def share_file(spark: SparkSession, data: bytes, kind: str) -> str:
    """Writes bytes to the shared folder; every executor, also a later one, fetches its copy from there."""
    name = f"{kind}-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toUri().toString())
    return name


# ---------------------------------------------------------------- operators


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, lexicon: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) for each row."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        encoder = worker_encoder(vocabulary, lexicon)
        for b in batches:
            for first, ids, n in id_lists(encoder, utf8(b.column(1))):
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), lists], ["doc_id", "ids"])

    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The decoded text in UTF-8: without a decoder in the vocabulary file, tokens joined by a space."""
    return b" ".join(vocabulary.spelled[ids].tolist())


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, ids)."""
    small_batches(encoded.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = worker_encoder(vocabulary).vocabulary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(table, x).decode() for x in lists(b.column(1))], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each list of an Arrow column as an array, null as empty."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:]))
