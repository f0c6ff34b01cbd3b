"""One frozen parameter object per run.  Nothing in the engine reads globals or environment."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Params:
    # Band cut.
    threshold_auto_accept: float = 85.0
    threshold_review: float = 50.0
    hard_floor: float = 30.0
    near_duplicate_gap: float = 15.0
    # Candidate window and amount rules.
    amount_tolerance: str = "2.00"
    window_back_days: int = 60
    window_forward_days: int = 7
    formula_tolerance: str = "2.00"
    gateway_keep_rate: str = "0.9764"
    # Noise and duplicates.
    noise_floor: str = "10.00"
    interest_noise_floor: str = "100.00"
    duplicate_days: int = 3
    duplicate_similarity: float = 85.0
    # Resolution thresholds of the scoring passes.
    pass1_resolve: float = 55.0
    pass2_resolve: float = 70.0
    pass3_resolve: float = 70.0
    # Vector pass.
    enable_embedding: bool = True
    embedding_floor: float = 0.5
    embedding_top_k: int = 5
    # Groups.
    pool_max: int = 16
    name_floor: float = 70.0
    # Linkage model and blend.
    logistic_k: float = 0.5
    blend_heuristic: float = 0.6
    blend_linkage: float = 0.4
    delta_limit: float = 20.0
    # Assignment.
    assign_min_score: float = 30.0
    # The models behind the two reply providers, as audit rows name them.
    gemini_model: str = "gemini-3.6-flash"
    groq_model: str = "groq/compound-mini"

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def tolerance_paise(self) -> int:
        return _paise(self.amount_tolerance)

    @property
    def formula_tolerance_paise(self) -> int:
        return _paise(self.formula_tolerance)

    @property
    def window_span(self) -> int:
        """Number of days a transaction's window covers; also the date bucket width."""
        return self.window_back_days + self.window_forward_days + 1

    def snapshot(self, fs_score: Column) -> Column:
        """Threshold snapshot struct stored on each match (PRJ-10)."""
        return F.struct(
            F.lit(float(self.threshold_auto_accept)).alias("threshold_auto_accept"),
            F.lit(float(self.threshold_review)).alias("threshold_review"),
            F.lit(float(self.hard_floor)).alias("hard_floor_reject"),
            F.lit(float(self.amount_tolerance)).alias("amount_tolerance_rupees"),
            F.lit(float(self.window_back_days)).alias("candidate_date_window_days"),
            F.lit(float(self.embedding_floor)).alias("embedding_similarity_floor"),
            F.lit(float(self.pool_max)).alias("split_pool_max_size"),
            F.round(fs_score, 2).alias("fs_score"),
            F.when(fs_score.isNotNull(), F.lit("0.6 × heuristic + 0.4 × fs"))
            .otherwise(F.lit("heuristic only"))
            .alias("fs_blend"),
        )


def _paise(rupees: str) -> int:
    from decimal import Decimal

    return int(Decimal(rupees) * 100)


DEFAULT = Params()
