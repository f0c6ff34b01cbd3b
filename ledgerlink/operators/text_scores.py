"""Fuzzy ratios of names with narrations, scored once for each two texts that meet and looked up by pairs (UDF-1).

Names are dealt to chunks: those of a merchant go together, and a name that several merchants have lies in the chunk of the
first.  A text is scored with the chunks that its merchants have, in blocks of bounded size, and keeps one array a chunk, by
the places of the names.  No pair of a transaction and an invoice runs through Python.

Digits of a narration cannot match a name without digits, so narrations that differ in digits only have the same ratios with
such names, provided that the words of each keep their order: then they share one text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlink.functions.fuzzy import name_points
from ledgerlink.functions.textratio import partial_ratios, token_set_ratios, token_sort_ratios
from ledgerlink.operators.candidates import CELL, candidate_pairs
from ledgerlink.params import DEFAULT, Params
from ledgerlink.session import Workspace, spread

NAMES = 1024  # names of a chunk, about
TEXTS = 256  # texts of a block, about
CLASSES = 50_000  # (text, day) classes of a block, about
STRIPE = 32  # names counted at once


def shape(c: Column) -> Column:
    """The text with each digit as 0, or as it is where the order of its distinct words would change."""
    zero = lambda x: F.regexp_replace(x, "[0-9]", "0")
    words = F.array_sort(F.array_distinct(F.split(c, r"(?U)[\s\x1c-\x1f]+")))
    plain = F.transform(words, zero)
    return F.when(plain == F.array_sort(F.array_distinct(plain)), zero(c)).otherwise(c)


def levels(names: list[str], texts: list[str]) -> np.ndarray:
    """The linkage name signals: 2 for name_strong, 1 for name_weak alone, 0 for neither."""
    ratio = np.maximum(partial_ratios(names, texts), token_set_ratios(names, texts))
    return (ratio >= 60).astype(np.int16) + (ratio >= 85)


def points(names: list[str], texts: list[str]) -> np.ndarray:
    """The name points of pass 2 in hundredths."""
    ratio = partial_ratios(names, texts)
    rest = np.flatnonzero(ratio < 100.0)
    ratio[rest] = np.maximum(ratio[rest], token_sort_ratios([names[k] for k in rest], [texts[k] for k in rest]))
    return np.array([round(100 * name_points(r)) for r in ratio.tolist()], dtype=np.int16)


def places(i: DataFrame, names: int = NAMES) -> DataFrame:
    """cp, _chunk, _place: every name of the invoices has one place in one chunk."""
    home = i.groupBy("cp").agg(F.min(F.struct(*CELL)).alias("_home"))
    parts = home.groupBy("_home").agg(F.ceil(F.count("*") / names).alias("_parts"))
    dealt = home.join(parts, "_home").select("cp", F.xxhash64("_home", F.pmod(F.xxhash64("cp"), F.col("_parts"))).alias("_chunk"))
    return dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_chunk").orderBy("cp")) - 1)


class TextScores:
    """names: CELL, cp, _chunk, _place;  texts: CELL, narr, text;  scores: text, _chunk, _scores (by place)."""

    def __init__(self, t: DataFrame, i: DataFrame, score=levels, read=None, names: int = NAMES, texts: int = TEXTS):
        """``score`` maps lists of names and texts to whole numbers; ``read`` prepares the narration."""
        ws = Workspace(t.sparkSession)
        due = i.where("status = 'open'")
        own = due.select(*CELL, "cp").distinct()
        self.names = ws.save(own.join(places(due, names), "cp"), "names")
        coded = self.names.groupBy(*CELL).agg(F.bool_or(F.col("cp").rlike("[0-9]")).alias("_coded"))
        plain = F.col("narr") if read is None else read(F.col("narr"))
        self.texts = ws.save(
            t.select(*CELL, "narr").distinct().join(coded, CELL).select(*CELL, "narr", F.when(F.col("_coded"), plain).otherwise(shape(plain)).alias("text")), "texts"
        )
        chunks = self.names.select(*CELL, "_chunk").distinct()
        wanted = ws.save(self.texts.select(*CELL, "text").distinct().join(chunks, CELL).select("text", "_chunk").distinct(), "wanted")
        blocks = wanted.groupBy("_chunk").agg(F.ceil(F.count("*") / texts).cast("int").alias("_blocks"))
        left = wanted.join(blocks, "_chunk").withColumn("_block", F.pmod(F.xxhash64("text"), F.col("_blocks")).cast("int"))
        right = self.names.select("_chunk", "_place", "cp").distinct().join(blocks, "_chunk").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        key = ["_chunk", "_block"]

        def meet(k, ts: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
            if not (len(ts) and len(ns)):  # no text fell into this block
                return pd.DataFrame()
            cps = ns.sort_values("_place")["cp"].tolist()
            rows, lines = [], max(1, 16384 // len(cps))
            for s in range(0, len(ts), lines):
                some = ts["text"].iloc[s : s + lines].tolist()
                rows += list(score(cps * len(some), [x for x in some for _ in cps]).astype(np.int16).reshape(len(some), len(cps)))
            return pd.DataFrame({"text": ts["text"].tolist(), "_chunk": k[0], "_scores": rows})

        right = right.toDF(*right.columns)  # names of its own, as both sides come from the same tables
        left, right = spread(left.drop("_blocks"), key), spread(right.drop("_blocks"), key)
        made = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "text string, _chunk long, _scores array<short>")
        self.scores = ws.save(made, "scores")


    def paid(self, t: DataFrame) -> DataFrame:
        """Transactions with the scores of their text, one row for each chunk of their merchant."""
        held = self.names.select(*CELL, "_chunk").distinct()
        return t.join(self.texts, [*CELL, "narr"]).join(held, CELL).join(self.scores, ["text", "_chunk"]).drop("text")

    def owed(self, i: DataFrame) -> DataFrame:
        """Open invoices with the place of their name."""
        return i.where("status = 'open'").join(self.names, [*CELL, "cp"])


def scored_pairs(t: DataFrame, i: DataFrame, score=levels, read=None, params: Params = DEFAULT, **sizes) -> DataFrame:
    """The candidate pairs with the score of their two texts as name_score."""
    s = TextScores(t, i, score, read, **sizes)
    return candidate_pairs(s.paid(t), s.owed(i), params, also=["_chunk"]).withColumn("name_score", F.get("_scores", F.col("_place"))).drop("_scores", "_place", "_chunk")


def name_counts(t: DataFrame, i: DataFrame, params: Params = DEFAULT, classes: int = CLASSES, **sizes) -> DataFrame:
    """One row: strong and weak, the candidate pairs with these name signals, counted by texts and days without being made."""
    s = TextScores(t, i, **sizes)
    day = lambda c: F.unix_date(c).cast("int").alias("day")
    paid = t.join(s.texts, [*CELL, "narr"]).groupBy(*CELL, "text", day("txn_date")).agg(F.count("*").alias("n")).where("day is not null")
    rows = paid.groupBy(*CELL, "text").agg(F.collect_list(F.struct("day", "n")).alias("_d"))
    size = rows.groupBy(*CELL).agg(F.ceil(F.sum(F.size("_d")) / classes).cast("int").alias("_blocks"))
    chunks = s.names.select(*CELL, "_chunk").distinct()
    key = [*CELL, "_chunk", "_block"]
    left = rows.join(size, CELL).join(chunks, CELL).join(s.scores, ["text", "_chunk"])
    left = left.select(*CELL, "_chunk", F.pmod(F.xxhash64("text"), F.col("_blocks")).cast("int").alias("_block"), F.col("_d.day").alias("days"), F.col("_d.n").alias("ns"), "_scores")
    owed = i.where("status = 'open'").groupBy(*CELL, "cp", day("invoice_date")).agg(F.count("*").alias("n")).where("day is not null")
    right = owed.join(s.names, [*CELL, "cp"]).join(size, CELL).select(*CELL, "_chunk", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_place", "day", "n")
    back, forward = params.window_back_days, params.window_forward_days

    def count(k, ts: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        strong = weak = 0
        if len(ts) and len(ns):
            days, at = np.unique(ns["day"].to_numpy(), return_inverse=True)
            place, n = ns["_place"].to_numpy(), ns["n"].to_numpy()
            paid_on, paid_n = np.concatenate(ts["days"].tolist()), np.concatenate(ts["ns"].tolist()).astype(np.int64)
            first = np.cumsum([0, *map(len, ts["days"])])[:-1]
            low, high = np.searchsorted(days, paid_on - back, "left"), np.searchsorted(days, paid_on + forward, "right")
            level = np.stack(ts["_scores"].tolist())
            for s in range(0, level.shape[1], STRIPE):
                part = level[:, s : s + STRIPE]
                mine = (place >= s) & (place < s + STRIPE)
                until = np.zeros((len(days) + 1, part.shape[1]), dtype=np.int64)
                np.add.at(until, (at[mine] + 1, place[mine] - s), n[mine])
                until = until.cumsum(axis=0)
                pairs = np.add.reduceat((until[high] - until[low]) * paid_n[:, None], first, axis=0)
                strong, weak = strong + int(pairs[part >= 2].sum()), weak + int(pairs[part >= 1].sum())
        return pd.DataFrame({"strong": [strong], "weak": [weak]})

    right = right.toDF(*right.columns)  # names of its own, as both sides come from the same tables
    cells = spread(left, key).groupBy(*key).cogroup(spread(right, key).groupBy(*key))
    return cells.applyInPandas(count, "strong long, weak long").agg(F.coalesce(F.sum("strong"), F.lit(0)).alias("strong"), F.coalesce(F.sum("weak"), F.lit(0)).alias("weak"))
