"""Fellegi-Sunter record linkage (SCO-13/14, FS-1..3)."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlink.functions import scalars as fx
from ledgerlink.functions.fuzzy import evidence_ratio
from ledgerlink.operators import candidates as cand, text_scores
from ledgerlink.operators.candidates import CELL
from ledgerlink.params import DEFAULT, Params

# Prior agreement probabilities (field, among matches, among non-matches).
PRIORS = [
    ("reference_number", 0.92, 0.02),
    ("amount_exact", 0.88, 0.04),
    ("amount_tds", 0.90, 0.02),
    ("amount_gst", 0.85, 0.06),
    ("name_strong", 0.90, 0.08),
    ("name_weak", 0.70, 0.25),
    ("date_close", 0.80, 0.20),
    ("date_window", 0.75, 0.35),
]
FIELDS = [p[0] for p in PRIORS]


@dataclass(frozen=True)
class Weights:
    """Agreement probabilities per field; a run takes them as literals."""

    rows: tuple[tuple[str, float, float], ...] = tuple(PRIORS)

    def __post_init__(self):
        for name, m, u in self.rows:
            if not 0 < u < m < 1:  # FS-3
                raise ValueError(f"{name}: need 0 < u < m < 1, got m={m}, u={u}")

    @staticmethod
    def from_table(df: DataFrame) -> "Weights":
        """Reads a weight table (one row per comparison field, eight in all)."""
        per = df.groupBy("field").agg(F.count("*").alias("n"), F.min("m_prob").alias("m_prob"), F.min("u_prob").alias("u_prob")).where(F.col("field").isin(FIELDS))
        rows = per.collect()
        if len(rows) != len(FIELDS) or any(r["n"] != 1 for r in rows):
            raise ValueError("a weight table holds exactly one row for each comparison field")
        got = {r["field"]: (r["m_prob"], r["u_prob"]) for r in rows}
        return Weights(tuple((f, *got[f]) for f in FIELDS))

    def llr(self) -> dict[str, tuple[float, float]]:
        return {n: (math.log(m / u), math.log((1 - m) / (1 - u))) for n, m, u in self.rows}


def signals(pairs: DataFrame, params: Params = DEFAULT, names: bool = True) -> DataFrame:
    """SCO-13: eight nullable booleans g_<field>; null means 'not comparable'.

    Needs amount_p, net_p, total_p, tds_p, gst_p, t_ref, i_ref, cp, narr, gap.  Pairs with a name_score
    (``text_scores.levels``) are not compared again.
    """
    tol = params.tolerance_paise
    exact = F.abs(F.col("amount_p") - F.col("net_p")) <= tol
    unknown = F.lit(None).cast("boolean")
    out = pairs
    scored = "name_score" in pairs.columns
    if names and not scored:
        out = out.withColumn("e_ratio", evidence_ratio("cp", "narr"))
    closer = lambda level, floor: F.col("name_score") >= level if scored else F.col("e_ratio") >= floor
    both = F.col("t_ref").isNotNull() & F.col("i_ref").isNotNull()
    made = {
        "reference_number": F.when(both, F.col("t_ref") == F.col("i_ref")),
        "amount_exact": exact,
        "amount_tds": F.when(F.col("tds_p") > 0, exact),
        "amount_gst": F.when(F.col("gst_p") > 0, F.abs(F.col("amount_p") - F.col("total_p")) <= tol),
        "name_strong": closer(2, 85) if names else unknown,
        "name_weak": closer(1, 60) if names else unknown,
        "date_close": F.col("gap") <= 7,
        "date_window": F.col("gap") <= params.window_back_days,
    }
    return out.withColumns({f"g_{f}": c for f, c in made.items()})


def _side_counts(tag: str = "", hit: Column | None = None) -> list[Column]:
    """For each field, how many of the pairs agree (a_) and how many are comparable (c_)."""
    hit = F.lit(True) if hit is None else hit
    g = {f: F.col(f"g_{f}") for f in FIELDS}
    return [c for f in FIELDS for c in (F.count_if(g[f] & hit).alias(f"{tag}a_{f}"), F.count_if(g[f].isNotNull() & hit).alias(f"{tag}c_{f}"))]


def _day_counts(t: DataFrame, i: DataFrame, params: Params) -> DataFrame:
    """One row of what days decide: pairs, pairs with both references, with tax withheld, with GST, and near in date."""
    kinds = {"n": F.lit(True), "ref": F.col("i_ref").isNotNull(), "tds": F.col("tds_p") > 0, "gst": F.col("gst_p") > 0}
    owed = i.groupBy(*CELL, "invoice_date").agg(*[F.count_if(c).alias(f"i_{k}") for k, c in kinds.items()])
    paid = t.groupBy(*CELL, "txn_date").agg(F.count("*").alias("t_n"), F.count_if(F.col("t_ref").isNotNull()).alias("t_ref"))
    reach = F.sequence(F.date_sub("txn_date", params.window_back_days), F.date_add("txn_date", params.window_forward_days))
    met = paid.withColumn("invoice_date", F.explode(reach)).join(owed, [*CELL, "invoice_date"])
    gap = fx.day_gap(F.col("txn_date"), F.col("invoice_date"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    every = F.col("t_n") * F.col("i_n")
    return met.agg(
        total(every, "n"), total(F.col("t_ref") * F.col("i_ref"), "ref"), total(F.col("t_n") * F.col("i_tds"), "tds"), total(F.col("t_n") * F.col("i_gst"), "gst"),
        total(F.when(gap <= 7, every), "near"), total(F.when(gap <= params.window_back_days, every), "window"),
    )


def _amount_counts(t: DataFrame, i: DataFrame, amount: str, kind: Column, params: Params) -> DataFrame:
    """One row: pairs whose invoice amount is within tolerance (n), and those of them of the kind (k), counted by amounts and days."""
    tol = params.tolerance_paise
    place = lambda c: F.floor(c / F.lit(32 * (tol + 1)))
    paid = t.groupBy(*CELL, "amount_p", "txn_date").agg(F.count("*").alias("t_n"))
    paid = paid.withColumn("_at", F.explode(F.sequence(place(F.col("amount_p") - tol), place(F.col("amount_p") + tol))))
    owed = i.groupBy(*CELL, amount, "invoice_date").agg(F.count("*").alias("i_n"), F.count_if(kind).alias("i_k")).withColumn("_at", place(F.col(amount)))
    met = paid.join(owed, [*CELL, "_at"]).where((F.abs(F.col("amount_p") - F.col(amount)) <= tol) & cand.in_window(params))
    total = lambda c, name: F.coalesce(F.sum(F.col("t_n") * F.col(c)), F.lit(0)).alias(name)
    return met.agg(total("i_n", "n"), total("i_k", "k"))


def agreement_counts(txns: DataFrame, invoices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The row of ``agg(_side_counts())`` of ``signals(candidate_pairs(txns, invoices))``, counted by days, amounts, references and texts.

    Pairs are made only of rows with amounts that are not positive, for which the amount window may exclude some.
    """
    due = invoices.where("status = 'open'")
    t, i = txns.where(cand.plain_txn()), due.where(cand.plain_invoice())
    refs = t.where("t_ref is not null").groupBy(*CELL, F.col("t_ref").alias("ref"), "txn_date").agg(F.count("*").alias("t_n"))
    owned = i.where("i_ref is not null").groupBy(*CELL, F.col("i_ref").alias("ref"), "invoice_date").agg(F.count("*").alias("i_n"))
    same = refs.join(owned, [*CELL, "ref"]).where(cand.in_window(params)).agg(F.coalesce(F.sum(F.col("t_n") * F.col("i_n")), F.lit(0)).alias("same_ref"))
    net = _amount_counts(t, i, "net_p", F.col("tds_p") > 0, params).toDF("net", "net_tds")
    gross = _amount_counts(t, i, "total_p", F.col("gst_p") > 0, params).toDF("gross", "gross_gst")
    one = _day_counts(t, i, params).crossJoin(same).crossJoin(net).crossJoin(gross).crossJoin(text_scores.name_counts(t, i, params))
    found = {
        "reference_number": ("same_ref", "ref"), "amount_exact": ("net", "n"), "amount_tds": ("net_tds", "tds"), "amount_gst": ("gross_gst", "gst"),
        "name_strong": ("strong", "n"), "name_weak": ("weak", "n"), "date_close": ("near", "n"), "date_window": ("window", "n"),
    }
    parts = [one.select(*[c for f in FIELDS for c in (F.col(found[f][0]).alias(f"a_{f}"), F.col(found[f][1]).alias(f"c_{f}"))])]
    for left, right in ((txns.where(~cand.plain_txn()), due), (t, due.where(~cand.plain_invoice()))):
        if not (left.isEmpty() or right.isEmpty()):
            parts.append(signals(cand.candidate_pairs(left, right, params), params).agg(*_side_counts()))
    every = functools.reduce(DataFrame.unionByName, parts)
    return every.agg(*[F.sum(c).alias(c) for c in every.columns])


def total_llr(weights: Weights = Weights()) -> Column:
    total: Column = F.lit(0.0)
    for f, (agree, disagree) in weights.llr().items():
        g = F.col(f"g_{f}")
        total = total + F.when(g, F.lit(agree)).when(~g, F.lit(disagree)).otherwise(F.lit(0.0))
    return total


def linkage_score(params: Params = DEFAULT, weights: Weights = Weights()) -> Column:
    """SCO-14."""
    return fx.logistic_score(total_llr(weights), params.logistic_k)


def estimate(labelled: DataFrame, prior: Weights = Weights()) -> DataFrame:
    """FS-1: add-one smoothed m and u per field from rows with g_<field> columns and a boolean is_match.

    One aggregation with map-side partials.  A field keeps its prior unless the new m exceeds the new u.
    """
    hit = F.col("is_match")
    both = labelled.agg(*_side_counts("m_", hit), *_side_counts("u_", ~hit))
    return _estimated(both, prior)


def estimate_from_rows(txns: DataFrame, invoices: DataFrame, event: list[str], params: Params = DEFAULT, prior: Weights = Weights()) -> DataFrame:
    """FS-1 over all candidate pairs of the rows; a pair is a match where both sides have the same event.

    Only the matches are made as pairs.  The others are the rest of all candidate pairs, which are counted.
    """
    due = invoices.where("status = 'open'")
    matches = txns.join(due, [*CELL, *event]).where(cand.in_window(params) & cand.amount_window()).withColumn("gap", fx.day_gap(F.col("txn_date"), F.col("invoice_date")))
    m = signals(matches, params).agg(*_side_counts("m_"))
    every = agreement_counts(txns.drop(*event), invoices.drop(*event), params)
    both = every.crossJoin(m).withColumns({f"u_{c}": F.col(c) - F.col(f"m_{c}") for c in every.columns})
    return _estimated(both, prior)


def _estimated(both: DataFrame, prior: Weights) -> DataFrame:
    """Probabilities from one row with the counts of matches (m_) and others (u_)."""
    one = both.select(*[((F.col(f"{s}_a_{f}") + 1) / (F.col(f"{s}_c_{f}") + 2)).alias(f"{s}_{f}") for f in FIELDS for s in ("m", "u")])
    rows = []
    for f, m0, u0 in prior.rows:
        better = F.col(f"m_{f}") > F.col(f"u_{f}")
        rows.append(
            F.struct(
                F.lit(f).alias("field"),
                F.when(better, F.col(f"m_{f}")).otherwise(F.lit(m0)).alias("m_prob"),
                F.when(better, F.col(f"u_{f}")).otherwise(F.lit(u0)).alias("u_prob"),
                F.coalesce(better, F.lit(False)).alias("updated"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def weight_summary(table: DataFrame) -> DataFrame:
    """FS-2, with FS-3 as a column."""
    m, u = F.col("m_prob"), F.col("u_prob")
    return table.select(
        "field",
        F.round(m, 3).alias("m_prob"),
        F.round(u, 3).alias("u_prob"),
        F.round(F.log(m / u), 3).alias("agree_llr"),
        F.round(F.log((1 - m) / (1 - u)), 3).alias("disagree_llr"),
        ((u > 0) & (u < m) & (m < 1)).alias("valid"),
    )
