"""Times the headline queries on local Spark and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlink.plans.catalog import QUERIES  # noqa: E402
from ledgerlink.session import build_session  # noqa: E402
from ledgerlink.sources import driver_tables as dt  # noqa: E402

HEADLINES = [
    "agg1_run_summary",
    "jn1_candidate_range_join",
    "sco6_rule_resolution",
    "sco10_second_pass_ranking",
    "sco14_linkage_score",
    "jn3_duplicate_interval_join",
    "jn4_name_relevance_join",
    "grp1_split_groups",
    "agg5_precision_recall",
    "agg11_digit_test",
    "agg12_dominant_counterparties",
    "fs1_weight_estimation",
    "full_run_matches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # Input derivation is timed apart: it stands for the upload.
    start = time.time()
    n_txns = dt.inputs(spark, sf_dir)["transactions"].count()
    took: dict[str, float] = {}
    load = time.time() - start
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    out = {"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "load_sec": round(load, 3), "transactions": n_txns}
    if "full_run_matches" in took:
        out["full_run_ms_per_transaction"] = round(took["full_run_matches"] * 1000 / max(n_txns, 1), 3)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
