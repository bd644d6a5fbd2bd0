"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times; the median of those is kept. Results
are written to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks import io_checks, paired_checks, rate_checks  # noqa: F401
from checks import views as v
from checks.registry import QUERIES
from trialstats.plans.comparison import compare_arms, domain_comparison
from trialstats.session import local_session, removing_stored

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = {
    "compare_arms": lambda spark, sf: compare_arms(v.trials(spark, sf), "owner"),
    "compare_arms_by_repo": lambda spark, sf: compare_arms(v.trials(spark, sf), "repo"),
    "domain_comparison": lambda spark, sf: domain_comparison(v.trials(spark, sf), v.domains(spark, sf)),
    **{
        name: QUERIES[name]
        for name in (
            "s9_parquet",
            "s1_csv_shards",
            "j1_repo_lookup",
            "j3_pair_arms",
            "a2_f2p_by_run",
            "a5_f2p_by_repo_run",
            "a7_domain_breakdown",
            "a10_pass_at_k",
            "a11_first_outcomes",
            "a16_price_dispersion_by_flag",
            "a18_box_plot",
            "w2_first_repeats",
            "w4_running_totals",
            "t2_exact_p_by_owner",
            "j7_all_pairs_counts",
            "l1_sampled_ids",
            "l4_stratified_sample",
            "w3_round_robin_shards",
            "s16_remaining_trials",
            "m1_run_rate_feed",
            "m3_health_by_window",
        )
    },
}


def run(spark, query) -> float:
    start = time.perf_counter()
    with removing_stored(spark):
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    chosen = sys.argv[1:] or list(HEADLINES)
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen:
        run(spark, HEADLINES[name])
        seconds[name] = round(statistics.median(run(spark, HEADLINES[name]) for _ in range(RUNS)), 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
