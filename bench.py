"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from panelkit.queries import QUERIES
from panelkit.session import local_session

HEADLINE = [
    "column_profile", "stem_groups", "feature_chunks", "median_split", "binarize_panel",
    "impute_mean", "impute_mode_by_segment", "proxy_feature", "baseline_table",
    "render_pairs_plain", "render_pairs_token", "feature_subsets", "k_sweep", "ordered_split",
    "label_fanout", "mask_numbers", "pair_rows", "prompt_pack", "author_freq", "freq_of_freq",
    "word_vocab", "encode_fixed", "mlm_mask", "truncation_audit",
    "centroid_dispersion", "same_dispersion", "mixed_dispersion", "mean_pool", "matrix_per_id",
    "residuals", "holdout_r2", "five_number", "mean_median_ensemble", "best_pick",
    "evaluate_grid", "score_grid", "pivot_chunks", "ols_baseline", "score_batches",
    "io_records_indexed", "collect_results",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the readers' machinery before the clock runs.
    spark.read.parquet(f"{sf}/region.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
