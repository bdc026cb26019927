"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully materialised with the ``noop`` sink (no collect to the
driver), from a fresh state: what earlier queries fitted or kept is released
first, so a query's time holds all that it needs. The whole list runs twice in
one session: the first (cold) pass pays JVM start-up, class loading and
JIT/code-generation warm-up; the second pass is the headline value. Both are
reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = ["features", "score_batch", "diag_prepared", "proc_count", "validate", "sample_exact", "split",
            "metrics_by_split", "roc_auc", "pr_auc", "onehot", "fit_medians", "overview_cost", "knn_minority",
            "oversample_embeddings", "reasons", "score_nested", "score_stream"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from claimlens.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="claimlens-bench")
    from claimlens.queries import QUERIES, feature_params
    # warm-up: JVM start, class loading, file listing (not timed)
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    from claimlens import queries as Qm

    def one_pass() -> dict:
        times = {}
        Qm.release(spark)
        t0 = time.time()
        feature_params(spark, sf_dir)
        times["fit_features"] = round(time.time() - t0, 3)
        for name in HEADLINE:
            Qm.release(spark)
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
        return times

    cold = one_pass()
    warm = one_pass()
    total = round(sum(warm.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_fresh_state", "value": total, "unit": "sec", "queries": warm,
                      "cold_total": round(sum(cold.values()), 3), "cold_queries": cold,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
