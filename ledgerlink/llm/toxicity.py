"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

Confirmed toxic documents are the positives; every other training text counts as unlabelled, whatever its label.
With prior p of toxic text, a loss l and the sampled risks of positives and unlabelled texts,

    risk = p * E_pos[l(f, 1)] + max(0, E_unl[l(f, 0)] - p * E_pos[l(f, 0)])

where a negative second term turns its step around, so that the classifier cannot fit the unlabelled
texts below what the prior allows.  f is a linear function of whether a text holds a word or word beginning.

* Features are chosen by their share among positives (less one standard error) against their share among unlabelled
  texts, then weighed; a weight is never negative.
* ``MAX_POSITIVES`` and ``MAX_UNLABELLED`` bound the rows the classifier is fitted on (chosen by a hash of the id);
  the prior is the toxic share of all training labels, and every document is scored over its whole text.

Defined cases: a null text is scored as the empty one, by the bias alone.  A null id is never used for learning.
Several labels of one id count as toxic if one of them does.  Without positives every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.base import held_out, small_batches, utf8

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
MAX_POSITIVES = 4_000
MAX_UNLABELLED = 12_000
MAX_FEATURES = 4_096
LEAST_POSITIVES = 3
LIFT_SHARE = 0.35  # of the way from no lift to 1 / prior, the lift of a feature that only toxic texts have
BEGINNINGS = (4, 5, 6, 7)
SEGMENT = 1 << 20
WORD = re.compile(r"[^\W_]+")
BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    prior: float


def words(text: bytes) -> set[str]:
    """Distinct lower-case words of a whole text, read in segments cut at white space."""
    found: set[str] = set()
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + SEGMENT)
        end = cut.end() if cut else len(text)
        found.update(WORD.findall(text[at:end].decode().lower()))
        at = end
    return found


def features(text: bytes) -> set[str]:
    """Words, and word beginnings marked with a leading ``^``."""
    found = words(text)
    return found | {"^" + w[:n] for w in found for n in BEGINNINGS if len(w) >= n}


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, float]:
    """Training rows (text, positive, unlabelled), and the prior."""
    truth = labels.filter("toxic is not null").filter(~held_out(F.col("doc_id"), FOLDS, HELD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = truth.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not n_pos:
        return None, 0.0
    share = lambda most, of: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(of, 1)))
    positives = truth.filter("toxic = 1").filter(share(MAX_POSITIVES, n_pos)).select("doc_id", F.lit(True).alias("positive"))
    pool = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter(~held_out(F.col("doc_id"), FOLDS, HELD))
    rows = pool.join(F.broadcast(positives), "doc_id", "left")  # about MAX_POSITIVES ids
    rows = rows.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), share(MAX_UNLABELLED, pool.count()).alias("unlabelled"))
    return rows.filter("positive or unlabelled"), n_pos / n


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    rows, prior = sampled(docs, labels, doc_id, text)
    if rows is None:
        return Model({}, -50.0, 0.0)
    small_batches(docs.sparkSession)

    def count(batches):
        pos, unl, n_pos, n_unl = Counter(), Counter(), 0, 0
        for b in batches:
            for t, p, u in zip(utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = features(t)
                if p:
                    pos.update(found)
                    n_pos += 1
                if u:
                    unl.update(found)
                    n_unl += 1
            if len(pos) + len(unl) > 400_000:
                yield flush(pos, unl, n_pos, n_unl)
                pos, unl, n_pos, n_unl = Counter(), Counter(), 0, 0
        yield flush(pos, unl, n_pos, n_unl)

    def flush(pos, unl, n_pos, n_unl):
        pos[""], unl[""] = n_pos, n_unl  # the empty feature counts the rows
        keys = list(pos.keys() | unl.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([unl[k] for k in keys], pa.int64())], ["feature", "p", "u"])

    counts = rows.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(f"p >= {LEAST_POSITIVES}").persist()
    total = counts.filter("feature = ''").first()
    n_pos, n_unl = (total["p"], max(total["u"], 1)) if total else (0, 1)
    lift = 1 + LIFT_SHARE * (1 / prior - 1)
    lifted = counts.filter("feature <> ''").filter((F.col("p") - F.sqrt("p")) * n_unl >= F.col("u") * lift * n_pos)
    chosen = [r[0] for r in lifted.orderBy(F.desc("p"), "u", "feature").limit(MAX_FEATURES).select("feature").collect()]
    counts.unpersist()

    index = {f: i for i, f in enumerate(chosen)}

    def project(batches):
        for b in batches:
            found = [sorted(index[f] for f in features(t) & index.keys()) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2)], ["found", "positive", "unlabelled"])

    data = rows.mapInArrow(project, "found array<int>, positive boolean, unlabelled boolean").collect()
    weights, bias = train([r["found"] for r in data], np.array([r["positive"] for r in data], bool), np.array([r["unlabelled"] for r in data], bool), len(chosen), prior)
    return Model({f: float(w) for f, w in zip(chosen, weights) if w}, float(bias), prior)


def train(found: list[list[int]], positive: np.ndarray, unlabelled: np.ndarray, size: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-5):
    """(weights, bias) that minimise the non-negative risk by Adam over all rows.

    The loss is the sigmoid of the wrong side's margin.  It is bounded, so that positives far on their side do not
    outweigh the difference between the stated prior and the sample's own share of toxic text.
    """
    n = np.fromiter(map(len, found), np.int64, len(found))
    row = np.repeat(np.arange(len(found)), n)
    col = np.array([i for f in found for i in f], np.int64)
    p, u = positive / max(positive.sum(), 1), unlabelled / max(unlabelled.sum(), 1)
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        f = np.bincount(row, w[col], len(found)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # the loss as a negative; 1 - s is the loss as a positive
        rest = (u * s).sum() - prior * (p * s).sum()
        slope = (u - prior * p) * s * (1 - s)
        g = -prior * p * s * (1 - s) + slope if rest >= 0 else -slope
        grad = np.concatenate([np.bincount(col, g[row], size), [g.sum()]])
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # a chosen feature only speaks for toxicity
    return w[:-1], w[-1]


class Scorer:
    """Scores whole texts by a model."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias
        self.heads = sorted({len(f) - 1 for f in model.weights if f[0] == "^"})

    def __call__(self, text: bytes) -> float:
        weights, heads = self.weights, self.heads
        hits = set()
        for w in words(text):
            if w in weights:
                hits.add(w)
            for n in heads:
                if len(w) >= n and (k := "^" + w[:n]) in weights:
                    hits.add(k)
        f = self.bias + sum(weights[h] for h in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(f, -500, 500))))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    scorer = Scorer(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer(t) for t in utf8(b.column(1))], pa.float64())], ["doc_id", "score"])

    out = docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not judged toxic, with all their columns, in one pass without a join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    scorer = Scorer(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([scorer(t) < THRESHOLD for t in utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
