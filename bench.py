"""Time the headline queries end to end and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
names given as arguments replace the headline list ("all" runs every registered query).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from knownat.session import local_session  # noqa: E402

HEADLINE = (
    "panel_label_prevalence",
    "ttm_sum_trailing_present",
    "rolling_slope_nonnull",
    "expanding_zscore",
    "peer_median_gap",
    "peer_pct_rank_avg_ties",
    "asof_backward_join",
    "vintage_window_aggregate",
    "priority_pick",
    "standalone_quarters_from_cumulative",
    "vintage_panel_latest_known",
    "longest_consecutive_run",
    "label_threshold_grid",
    "episode_cooldown_starts",
    "entity_eligibility_audit",
    "panel_certification_rules",
    "contract_key_check",
    "hash_score_sample_round_robin",
    "universe_selection",
    "expanding_folds_embargo",
    "prior_event_rate_asof",
    "panel_ranking_metrics",
    "recall_first_threshold",
    "review_queue_topk",
    "psi_drift_report",
    "reason_codes_ecdf",
    "random_walk_backtest_summary",
    "time_series_diagnostics",
    "spearman_pairwise",
    "clustered_bootstrap_ci",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registered = catalog.queries()
    chosen = sys.argv[1:] or list(HEADLINE)
    if chosen == ["all"]:
        chosen = list(registered)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format(
        "noop"
    ).mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
