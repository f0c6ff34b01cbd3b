"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1.  One binary classifier per bit is learned on hashed byte n-grams; a text
is given the language whose codeword has the least weighted loss against the bits' margins.  A bit's loss is weighed
for each language by how often that bit was right on the language's training rows.

* Up to ``EXHAUSTIVE`` languages the code is exhaustive, every split of the languages once; for more, the best of
  several seeded random codes by its least distance between codewords.
* The classifiers are fitted on every language, on at most about ``ROWS_PER_LANGUAGE`` rows of each (chosen by a hash of the
  id); with many languages on fewer rows of each, about ``FIT_ROWS`` in all, and always at least one.  Every document is
  judged over its whole text.

Defined cases: a text that is null or without a letter is ``und`` with score 0.  Rows without lang or id are not used for
learning.  Without training rows everything is ``und``.  One learned language is always predicted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import chunks, held_out, small_batches, utf8

FOLDS, HELD = 5, 0
SIZE = 2048
ROWS_PER_LANGUAGE = 800
FIT_ROWS = 64 * ROWS_PER_LANGUAGE
EXHAUSTIVE = 5
AMBIGUOUS = 0.2
RUN_BYTES = 1 << 20
GROUP = 256
DRAWS = 200
LETTER = re.compile(rb"[A-Za-z]")
PRIMES = (2_654_435_761, 2_246_822_519, 3_266_489_917)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weigh: np.ndarray  # languages x bits
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray  # features x bits
    bias: np.ndarray


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of byte 1-, 2- and 3-grams, hashed, one row per text; a very long text is counted in segments."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for first, run in chunks(texts, RUN_BYTES):
        for i, t in enumerate(run) if len(run[0]) > RUN_BYTES else [(None, None)]:
            if t is None:
                out[first : first + len(run)] = _count(run)
            else:
                for at in range(0, len(t), RUN_BYTES):
                    out[first + i] += _count([t[at : at + RUN_BYTES + 2]])[0]
    return out


def _count(run: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(t.lower() + b"\n" for t in run), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(run)) * SIZE, [len(t) + 1 for t in run])
    total = np.zeros(len(run) * SIZE, np.int64)
    gram = np.zeros(len(data), np.uint32)
    for n, prime in enumerate(PRIMES):
        gram = gram[: len(data) - n] * np.uint32(257) + data[n:]
        slot = (gram * np.uint32(prime)) >> np.uint32(21)
        total += np.bincount(doc[: len(slot)] + slot, minlength=len(total))
    return total.reshape(len(run), SIZE)


def vectors(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    if n <= EXHAUSTIVE:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if lang == 0 or (b >> (lang - 1)) & 1 == 0 else -1 for b in range(1, bits + 1)] for lang in range(n)])
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    draws = (rng.choice([-1, 1], (n, bits)) for _ in range(DRAWS if n <= 256 else 8))
    return max(draws, key=least_distance)


def least_distance(code: np.ndarray, rows: int = 256) -> float:
    """The least distance between two codewords, some rows at a time."""
    c, most = code.astype(np.float32), -code.shape[1]
    for at in range(0, len(c), rows):
        alike = c[at : at + rows] @ c.T
        alike[np.arange(len(alike)), np.arange(at, at + len(alike))] = -code.shape[1]
        most = max(most, int(alike.max()))
    return (code.shape[1] - most) / 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(doc_id), FOLDS, HELD))
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("fit")), F.lit(1_000_000))
    sizes = rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()
    if not sizes:
        return None
    most = min(ROWS_PER_LANGUAGE, FIT_ROWS / len(sizes))
    shares = [(r["lang"], max(int(1_000_000 * min(1.0, most / r["n"])), r["least"] + 1)) for r in sizes]
    share = docs.sparkSession.createDataFrame(shares, "_fit_lang string, _fit_share long")  # one row a language
    pick = rows.join(F.broadcast(share), F.col(lang) == F.col("_fit_lang")).filter(draw < F.col("_fit_share"))

    def count(batches):
        for b in batches:
            x = vectors(gram_counts(utf8(b.column(1)))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    data = pick.select(F.col(lang).alias("lang"), F.col(text).cast("string")).mapInArrow(count, "lang string, x binary").collect()
    languages = sorted({r["lang"] for r in data})
    if not languages:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in data]).astype(np.float32)
    y = np.searchsorted(languages, [r["lang"] for r in data])
    return train(x, y, languages)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 120, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Logistic classifiers of all bits at once, by Adam; each language has the same weight."""
    code = codewords(len(languages))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    t = (code[y] > 0).astype(np.float32)
    each = (1 / np.bincount(y, minlength=len(languages)))[y][:, None].astype(np.float32) / len(languages)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for k in range(1, steps + 1):
        g = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - t) * each
        gw, gb = z.T @ g + decay * w, g.sum(axis=0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (mw / (1 - 0.9**k)) / (np.sqrt(vw / (1 - 0.999**k)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    right = ((z @ w + b > 0) == (t > 0)).astype(np.float64)
    weigh = np.stack([right[y == i].mean(axis=0) for i in range(len(languages))]) + 1e-3
    return Model(languages, code, weigh / weigh.sum(axis=1, keepdims=True), mean, scale, w, b)


def decide(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of each row: least weighted logistic loss over the bits."""
    margin = ((x - model.mean) / model.scale) @ model.coef + model.bias
    loss = np.logaddexp(0, -margin) @ (model.weigh * (model.code > 0)).T + np.logaddexp(0, margin) @ (model.weigh * (model.code < 0)).T
    best = loss.argmin(axis=1)
    p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    order = np.sort(p, axis=1)
    ambiguous = (order[:, -1] - order[:, -2] < AMBIGUOUS) if p.shape[1] > 1 else np.zeros(len(p), bool)
    return best, p[np.arange(len(p)), best], ambiguous


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = utf8(b.column(1))
            for at in range(0, len(texts), GROUP):
                part = texts[at : at + GROUP]
                known = np.array([model is not None and has_letter(t) for t in part], bool)
                if model is None:
                    lang, p, unsure = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part), bool)
                else:
                    lang, p, unsure = decide(model, vectors(gram_counts(part)))
                names = [model.languages[i] if k else "und" for i, k in zip(lang, known)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(names, pa.string()), pa.array(np.where(known, p, 0.0).astype(np.float64)), pa.array(np.where(known, unsure, True))],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    out = docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "lang_pred", "score", "ambiguous")
