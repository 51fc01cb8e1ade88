"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a3_parquet_scan", "b2_classify_names", "b9_pool_zones", "c0_clean_frame", "c9_cleaning_report", "d2_backward_screen",
    "e1_spatial_blocks", "e6_morans_i_readings", "e8_knn_readings", "e8_knn_features", "f1_ols_lineitem", "f2_ridge_loo",
    "f3_random_forest", "f5_boosted_trees", "f8_benchmark", "f9_leakage_audit", "f11_refit_split", "g1_local_regression",
    "g7_gwr_run", "h2_importance", "h3_interactions", "h5_permutation_importance", "i7_rank_score", "i11_score",
    "i12_coverage", "i14_stress", "i15_spearman", "j5_mann_kendall", "j7_trend_table", "j9_rank_aligned_change",
    "k1_silhouette", "k5_discover_clusters", "l1_price_curve", "l2_percentile_rank", "l4_box_stats",
]


def main():
    from heatscape.plans import catalogue
    from heatscape.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session("bench", cores)
    # start the JVM's and Python's workers before the clock runs
    spark.range(100).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "cpus": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
