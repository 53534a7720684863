"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cv_summary", "fold_metrics", "metrics_full_report", "mean_posterior_pool", "ece", "decision_rules_all",
    "threshold_tune", "mcnemar_by_unit", "stratified_cluster_bootstrap", "paired_sign_flip_test", "iid_bootstrap",
    "grouped_stratified_kfold", "validation_holdout_per_fold", "exact_count_carve", "manifest_digest",
    "duplicate_groups_report", "ledger_audit", "early_stop_epoch", "near_duplicate_self_join", "leakage_audit",
    "duplicate_components", "fuse_backbones", "standardize_train_only", "knn_head",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    want = os.environ.get("BENCH_QUERIES")
    from assay.plans import catalog
    from assay.session import local_session

    spark = local_session(cores, "bench", os.environ.get("BENCH_MEMORY", "4g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = want.split(",") if want else HEADLINE
    # start the JVM's and the Python workers' code paths once
    queries["near_duplicate_self_join"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
