"""Headline queries, timed one after another; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import load_all  # noqa: E402
from millrace.session import clear_work, local_session  # noqa: E402

HEADLINE = (
    "stage_funnel star_join broadcast_join sort_merge_prepartition lateral_topn left_join_count grouping_sets cube percentile_linear quartile_index row_number running_total ntile "
    "dedupe_latest phase_segments streak_days profile_columns validate_schema outlier_mad missing_mechanism ks_drift two_prop_ztest rater_bias retention_curve cohort_matrix touch_linear "
    "touch_time_decay campaign_metrics health_score arr_waterfall pipeline_risk financial_ratios execution_metrics entity_zscore burn_rate mitigation_effect caseload readability burstiness "
    "sliding_ttr humanity_score pii_scan corpus_keywords tfidf_search bm25_search chunk_fixed chunk_sentence link_graph connected_components html_features scd2 cdc_apply row_checksum_diff "
    "group_checksum exact_duplicates stratified_split tumbling_window"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "millrace-bench")
    queries, _ = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in os.environ.get("BENCH_ONLY", "").split() or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    clear_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
